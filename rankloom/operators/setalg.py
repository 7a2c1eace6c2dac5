"""Set-compositional templates over a relation (entity, attr)."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.sources.scratch import kept

#: Template: number of attributes, predicate on an entity's attributes, and the texts of its query (fixed values).
SINGLE, OR2, OR3 = "_", "_ or _", "_ or _ or _"
AND2, AND3, AND_NOT, NOT = "_ that are also _", "_ that are also both _ and _", "_ that are also _ but not _", "_ that are not _"
ARITY = {SINGLE: 1, OR2: 2, OR3: 3, AND2: 2, AND3: 3, AND_NOT: 3, NOT: 2}
QUERY = {
    SINGLE: "Who likes %s?",
    OR2: "Who likes %s or %s?",
    OR3: "Who likes %s or %s or %s?",
    AND2: "Who likes %s and also likes %s?",
    AND3: "Who likes %s and also likes both %s and %s?",
    AND_NOT: "Who likes %s and also likes %s but not %s?",
    NOT: "Who likes %s but not %s?",
}
MARKED = {
    SINGLE: "<mark>%s</mark>",
    OR2: "<mark>%s</mark> or <mark>%s</mark>",
    OR3: "<mark>%s</mark> or <mark>%s</mark> or <mark>%s</mark>",
    AND2: "<mark>%s</mark> that are also <mark>%s</mark>",
    AND3: "<mark>%s</mark> that are also both <mark>%s</mark> and <mark>%s</mark>",
    AND_NOT: "<mark>%s</mark> that are also <mark>%s</mark> but not <mark>%s</mark>",
    NOT: "<mark>%s</mark> that are not <mark>%s</mark>",
}
UNORDERED = (SINGLE, OR2, OR3, AND2, AND3)


def predicate(template: str, attrs: Column, a: Column, b: Column | None = None, c: Column | None = None) -> Column:
    """Whether an entity with these attributes answers the template."""
    has = lambda x: F.array_contains(attrs, x)
    return {
        SINGLE: lambda: has(a), OR2: lambda: has(a) | has(b), OR3: lambda: has(a) | has(b) | has(c), AND2: lambda: has(a) & has(b), AND3: lambda: has(a) & has(b) & has(c),
        AND_NOT: lambda: has(a) & has(b) & ~has(c), NOT: lambda: has(a) & ~has(b),
    }[template]()


def render(template: str, *attrs: Column, marked: bool = False) -> Column:
    return F.format_string((MARKED if marked else QUERY)[template], *attrs)


def union(ea: DataFrame, attrs: list[str]) -> DataFrame:
    return ea.where(F.col("attr").isin(*attrs)).select("entity").distinct()


def intersection(ea: DataFrame, attrs: list[str]) -> DataFrame:
    own = ea.where(F.col("attr").isin(*attrs)).groupBy("entity").agg(F.count_distinct("attr").alias("n"))
    return own.where(F.col("n") == len(set(attrs))).select("entity")


def difference(ea: DataFrame, attrs: list[str], without: str) -> DataFrame:
    return intersection(ea, attrs).join(ea.where(F.col("attr") == without).select("entity"), "entity", "left_anti")


def entities_for(ea: DataFrame, template: str, attrs: list[str]) -> DataFrame | None:
    """Entities that answer a template; None if an attribute is unknown or the number of them is wrong."""
    if template not in ARITY or len(attrs) != ARITY[template] or ea.where(F.col("attr").isin(*attrs)).select("attr").distinct().count() < len(set(attrs)):
        return None
    if template in (OR2, OR3):
        return union(ea, attrs)
    if template in (AND_NOT, NOT):
        return difference(ea, attrs[:-1], attrs[-1])
    return intersection(ea, attrs)


def answers(ea: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, entity) for a table of queries (id, template, attrs): one equi-join on the attribute, one aggregate.

    As with :func:`entities_for`, a query with an unknown attribute, template or number of attributes has no answer at all.
    """
    arity = F.create_map(*(x for t, n in ARITY.items() for x in (F.lit(t), F.lit(n))))
    queries = queries.where(F.size("attrs") == F.try_element_at(arity, F.col("template")))
    known = queries.select("id", F.explode("attrs").alias("attr")).join(ea.select("attr").distinct(), "attr", "left_anti").select("id")
    queries = queries.join(known, "id", "left_anti")
    wanted = queries.select("id", "template", F.size("attrs").alias("n"), F.posexplode("attrs").alias("place", "attr"))
    met = ea.distinct().join(wanted, "attr").groupBy("id", "entity", "template", "n").agg(F.collect_set("place").alias("places"))
    inner = F.size(F.filter("places", lambda p: p < F.col("n") - 1))
    negated = F.array_contains(F.col("places"), F.col("n") - 1)
    holds = F.when(F.col("template").isin(OR2, OR3), F.lit(True)).when(F.col("template").isin(NOT, AND_NOT), (inner == F.col("n") - 1) & ~negated).otherwise(F.size("places") == F.col("n"))
    return met.where(holds).select("id", "entity")


def attribute_sets(ea: DataFrame) -> DataFrame:
    """(entity, attrs): each entity's distinct attributes, sorted; written once, as several plans read them, and over all cores, as they are small but give much work."""
    spark = ea.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return kept(ea.repartition(parts, "entity").groupBy("entity").agg(F.sort_array(F.collect_set("attr")).alias("attrs")), "sets")


def answer_counts(sets: DataFrame, sizes: DataFrame, queries: DataFrame, least: int, most: int) -> DataFrame:
    """(id, num_docs) of a bounded number of queries (id, template, attrs) with ``least`` to ``most`` answers, and one at least.

    The numbers of :func:`answers`, from the entities' sets (:func:`attribute_sets`) and the attributes' sizes (attr, n).  A query whose sizes alone put it
    outside of the range is not counted.  The others are sent to the sets: an or-query meets an entity at its first attribute there, another
    one at its rarest; tasks count before anything is shuffled.
    """
    arity = F.create_map(*(x for t, n in ARITY.items() for x in (F.lit(t), F.lit(n))))
    placed = queries.where(F.size("attrs") == F.try_element_at(arity, F.col("template"))).select("id", "template", F.posexplode("attrs").alias("place", "attr"))
    of = placed.join(sizes.select("attr", "n"), "attr").groupBy("id", "template").agg(F.sort_array(F.collect_list(F.struct("place", "n", "attr"))).alias("of"))
    of = of.where(F.size("of") == F.try_element_at(arity, F.col("template")))
    union, less = F.col("template").isin(SINGLE, OR2, OR3), F.col("template").isin(NOT, AND_NOT)
    inner = F.when(less, F.slice("of", 1, F.size("of") - 1)).otherwise(F.col("of"))
    of = of.withColumn("inner", inner).withColumn("ns", F.transform("inner", lambda x: x["n"]))
    low = F.when(union, F.array_max("ns")).when(F.col("template") == NOT, F.col("of")[0]["n"] - F.col("of")[1]["n"]).otherwise(0)
    high = F.when(union, F.aggregate("ns", F.lit(0).cast("long"), lambda acc, n: acc + n)).otherwise(F.array_min("ns"))
    may = of.where((low <= most) & (high >= least))
    names = lambda c: F.transform(c, lambda x: x["attr"])
    none = F.array().cast("array<string>")
    first = F.transform("inner", lambda x, i: F.struct(x["attr"].alias("pivot"), none.alias("need"), names(F.slice("of", F.lit(1), i)).alias("without")))
    rarest = F.array_min(F.transform("inner", lambda x: F.struct(x["n"], x["attr"])))["attr"]
    one = F.array(F.struct(rarest.alias("pivot"), names(F.col("inner")).alias("need"), F.when(less, names(F.slice("of", -1, 1))).otherwise(none).alias("without")))
    wanted = may.select("id", F.explode(F.when(union, first).otherwise(one)).alias("w")).select("id", "w.*")
    met = sets.select("attrs", F.explode("attrs").alias("pivot")).join(F.broadcast(wanted), "pivot")
    holds = F.forall("need", lambda x: F.array_contains("attrs", x)) & ~F.exists("without", lambda x: F.array_contains("attrs", x))
    return met.where(holds).groupBy("id").agg(F.count("*").alias("num_docs")).where(F.col("num_docs").between(least, most))


def upper_bound(template: str, n: int) -> int:
    """How many attribute combinations a template has at most."""
    return {SINGLE: n, OR2: comb(n, 2), AND2: comb(n, 2), OR3: comb(n, 3), AND3: comb(n, 3), NOT: n * (n - 1), AND_NOT: n * (n - 1) * (n - 2)}[template]


def singles(ea: DataFrame) -> DataFrame:
    return ea.groupBy(F.col("attr").alias("a")).agg(F.count("*").alias("na"))


#: Rows of one side that are compared with as many of the other in one group of a block product.
CHUNK = 1024


def size_pairs(left: DataFrame, right: DataFrame, may: Callable[[int, int, int, int], bool] = lambda *_: True, chunk: int = CHUNK) -> DataFrame:
    """Pairs of a row of ``left`` (its last column a size of at least 1) and one of ``right`` (likewise), in blocks.

    Rows fall into classes by size, 2^i to 2^(i+1) - 1, and classes into chunks by hash.  ``may`` (least and most size on the left, least and most on the
    right) tells which classes can meet; a chunk goes to the chunks of those alone, by an equi-join on both chunks' names.  So no task sees
    more than a block, and what sizes rule out is not compared.
    """
    sides = []
    for df in (left, right):
        size = F.col(df.columns[-1])
        df = df.withColumn("_class", F.floor(F.log2(size) + 1e-12).cast("int"))
        # at most one row for each power of two
        sides.append((df, {r["_class"]: -(-r["n"] // chunk) for r in df.groupBy("_class").agg(F.count("*").alias("n")).collect()}))
    (a, of_a), (b, of_b) = sides
    ends = lambda i: (1 << i, (1 << i + 1) - 1)
    meets = [(i, j) for i in of_a for j in of_b if may(*ends(i), *ends(j))]
    if not meets:
        return a.where("false").join(b.where("false"), "_class").drop("_class")

    def placed(df: DataFrame, own: dict[int, int], other: dict[int, int], partners: dict[int, list[int]], mine: str, theirs: str) -> DataFrame:
        number = lambda of: F.create_map(*(F.lit(x) for i, n in of.items() for x in (i, n)))
        chunk_ = F.pmod(F.xxhash64(*(c for c in df.columns if c != "_class")), F.get(F.map_values(F.map_filter(number(own), lambda k, _: k == F.col("_class"))), F.lit(0)))
        reached = F.coalesce(*(F.when(F.col("_class") == i, F.array(*(F.struct(F.lit(j).alias("c"), F.lit(other[j]).alias("n")) for j in js))) for i, js in partners.items()), F.array().cast("array<struct<c:int,n:int>>"))
        out = df.withColumn(f"_{mine}k", chunk_.cast("int")).withColumn("_r", F.explode(reached)).withColumn(f"_{theirs}k", F.explode(F.sequence(F.lit(0), F.col("_r.n") - 1)))
        return out.withColumn(f"_{theirs}c", F.col("_r.c")).withColumnRenamed("_class", f"_{mine}c").drop("_r")

    of = lambda at, other, mine: {i: [j for x in meets for j in [x[other]] if x[at] == i] for i in mine if any(x[at] == i for x in meets)}
    keys = ["_ac", "_ak", "_bc", "_bk"]
    return placed(a, of_a, of_b, of(0, 1, of_a), "a", "b").join(placed(b, of_b, of_a, of(1, 0, of_b), "b", "a"), keys).drop(*keys)


def met_pairs(ea: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """(a, b, na, nb, nab) for a < b that some entity has both of: an equi-join on the entity."""
    from rankloom.operators.joins import attribute_pairs

    n = singles(ea) if n is None else n
    both = attribute_pairs(ea).withColumnRenamed("both", "nab")
    return both.join(n, "a").join(n.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").select("a", "b", "na", "nb", "nab")


def pair_counts(ea: DataFrame, grid: bool = True) -> DataFrame:
    """(a, b, na, nb, nab) for a < b.  With ``grid`` also pairs that never meet, in blocks (see :func:`size_pairs`)."""
    ea = ea.distinct()
    n = singles(ea)
    met = met_pairs(ea, n)
    if not grid:
        return met
    return _with_unmet(n, met)


def _with_unmet(n: DataFrame, met: DataFrame) -> DataFrame:
    every = size_pairs(n, n.select(F.col("a").alias("b"), F.col("na").alias("nb"))).where("a < b")
    return every.join(met.select("a", "b", "nab"), ["a", "b"], "left").na.fill({"nab": 0}).select("a", "b", "na", "nb", "nab")


def valid_pairs(ea: DataFrame, least: int, most: int) -> DataFrame:
    """(template, a, b, num_docs) of all two-attribute combinations within the range; not-templates in both orders.

    Pairs that meet come from the join on the entity, and and-templates need no others.  For the rest the sizes are the counts, so only attributes whose sizes
    can give a count in the range are brought together.
    """
    ea = kept(ea.distinct(), "relation")
    n = singles(ea)
    met = kept(met_pairs(ea, n), "met")
    row = lambda template, x, y, size: F.struct(F.lit(template).alias("template"), F.col(x).alias("x"), F.col(y).alias("y"), size.alias("num_docs"))
    na, nb, nab = F.col("na"), F.col("nb"), F.col("nab")
    sets = F.array(row(OR2, "a", "b", na + nb - nab), row(AND2, "a", "b", nab), row(NOT, "a", "b", na - nab), row(NOT, "b", "a", nb - nab))
    rows = met.select(F.explode(sets).alias("s")).select("s.*")
    other = n.select(F.col("a").alias("b"), F.col("na").alias("nb"))
    either = size_pairs(n.where(na <= most), other.where(nb <= most), lambda l1, h1, l2, h2: l1 + l2 <= most and h1 + h2 >= least).where("a < b")
    apart = either.select(F.lit(OR2).alias("template"), F.col("a").alias("x"), F.col("b").alias("y"), (na + nb).alias("num_docs"))
    apart = apart.unionAll(size_pairs(n.where(na.between(least, most)), other).where("a <> b").select(F.lit(NOT), "a", "b", "na"))
    if least <= 0 <= most:
        apart = apart.unionAll(size_pairs(n, other).where("a < b").select(F.lit(AND2), "a", "b", F.lit(0).cast("long")))
    apart = apart.where(F.col("num_docs").between(least, most)).withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(met.select("a", "b"), ["a", "b"], "left_anti")
    rows = rows.where(F.col("num_docs").between(least, most)).unionByName(apart.select("template", "x", "y", "num_docs"))
    return rows.select("template", F.col("x").alias("a"), F.col("y").alias("b"), "num_docs")


def valid_triples(ea: DataFrame, least: int, most: int, attrs: list[str] | None = None) -> DataFrame:
    """(template, a, b, c, num_docs) within the range, by inclusion and exclusion.

    And-templates come from the join on the entity alone.  For the or-template only pairs and attributes whose sizes are within the range are brought
    together, for and-not only pairs that meet often enough with attributes that can take enough away (see :func:`size_pairs`).
    """
    ea = ea.distinct() if attrs is None else ea.where(F.col("attr").isin(*attrs)).distinct()
    ea = kept(ea, "relation")
    n = singles(ea)
    met = kept(met_pairs(ea, n), "met")
    every = _with_unmet(n, met)
    third = n.select(F.col("a").alias("c"), F.col("na").alias("nc"))
    e = lambda name: ea.select("entity", F.col("attr").alias(name))
    three = e("a").join(e("b"), "entity").where("a < b").join(e("c"), "entity").where("b < c").groupBy("a", "b", "c").agg(F.count("*").alias("nabc"))
    three = kept(three, "triples")
    c = F.col
    within = c("num_docs").between(least, most)
    out = three.select(F.lit(AND3).alias("template"), "a", "b", "c", c("nabc").alias("num_docs")).where(within)
    if least <= 0 <= most:
        grid = size_pairs(every.select("a", "b", "na"), third).where("b < c").select("a", "b", "c")
        out = out.unionAll(grid.join(three, ["a", "b", "c"], "left_anti").select(F.lit(AND3), "a", "b", "c", F.lit(0).cast("long")))
    # or: the union of a and b, then c
    unions = every.select("a", "b", (c("na") + c("nb") - c("nab")).alias("nu")).where(c("nu") <= most)
    t = size_pairs(unions, third.where(c("nc") <= most), lambda l1, h1, l2, h2: max(l1, l2) <= most and h1 + h2 >= least).where("b < c")
    other = lambda x, y, name: met.select(c("a").alias(x), c("b").alias(y), c("nab").alias(name))
    t = t.join(other("a", "c", "nac"), ["a", "c"], "left").join(other("b", "c", "nbc"), ["b", "c"], "left").join(three, ["a", "b", "c"], "left").na.fill(0, ["nac", "nbc", "nabc"])
    # |a or b or c| = |a or b| + |c| - |(a or b) and c|
    out = out.unionAll(t.select(F.lit(OR3), "a", "b", "c", (c("nu") + c("nc") - (c("nac") + c("nbc") - c("nabc"))).alias("num_docs")).where(within))
    # and-not: pairs that meet, less a third
    pairs = met.select("a", "b", "nab").where(c("nab") >= least)
    u = size_pairs(pairs, third, lambda l1, h1, l2, h2: l1 - h2 <= most).where((c("c") != c("a")) & (c("c") != c("b")))
    x, y, z = (F.array_sort(F.array("a", "b", "c"))[i].alias(k) for i, k in enumerate(("s0", "s1", "s2")))
    u = u.select("*", x, y, z).join(three.select(c("a").alias("s0"), c("b").alias("s1"), c("c").alias("s2"), "nabc"), ["s0", "s1", "s2"], "left").na.fill(0, ["nabc"])
    out = out.unionAll(u.select(F.lit(AND_NOT), "a", "b", "c", (c("nab") - c("nabc")).alias("num_docs")).where(within))
    if least <= 0 <= most:
        unmet = every.where("nab = 0").select("a", "b", "na")
        out = out.unionAll(size_pairs(unmet, third).where((c("c") != c("a")) & (c("c") != c("b"))).select(F.lit(AND_NOT), "a", "b", "c", F.lit(0).cast("long")))
    return out


def depth(template: Column, attrs: Column | None = None) -> Column:
    """How many constraints a query combines: its attributes, else the places of its template."""
    places = F.size(F.regexp_extract_all(template, F.lit("_"), 0))
    return places if attrs is None else F.coalesce(F.nullif(F.size(attrs), F.lit(-1)), places)


def covers(gold: Column, predicted: Column) -> Column:
    return F.size(F.array_except(gold, predicted)) == 0


def differences(gold: Column, predicted: Column) -> tuple[Column, Column]:
    """(extra, missing)."""
    return F.array_except(predicted, gold), F.array_except(gold, predicted)
