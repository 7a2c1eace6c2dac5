"""Random instances of all seven templates, and their ordered acceptance with quotas.

A try is a row; its choices are numbers by md5 of seed, template, try and place, so that draws repeat and other engines can draw alike.
All tries of a round are built by joins: attributes and entities are numbered, and a draw from what is allowed is a place in
that numbering.  The relation is written once as sets of attributes; pairs and counts come from the sets, without a join on the entity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import setalg
from rankloom.operators.sampling import BUCKETS, _number, bucket
from rankloom.sources.scratch import kept

#: Draws of an attribute pair before a template falls back to any attributes; failures in a row that end a phase.
PAIR_TRIES = 1_000
FAILURES_WITH_QUOTAS, FAILURES_AT_LAST = 8_000, 3_000
#: Tries of a round.
ROUND = 4_096


def pick(seed: int, template: str, place: int | str, of: Column) -> Column:
    """A number from 0 to ``of`` - 1 for the row's try."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(template), F.col("try").cast("string"), F.lit(str(place)))
    return F.pmod(_number(text), F.greatest(of.cast("long"), F.lit(1).cast("long")))


class Relation:
    """A relation (entity, attr) with what draws need: numbered attributes by class (those of equal entity sets), numbered entities and their attributes."""

    def __init__(self, ea: DataFrame):
        self.sets = setalg.attribute_sets(ea.where("entity is not null and attr is not null"))
        self.ea = self.sets.select("entity", F.explode("attrs").alias("attr"))
        # attributes of equal entity sets follow one another: sums of two hashes and the size tell the sets
        sign = [F.sum(F.xxhash64("entity", F.lit(i)).cast("decimal(38,0)")).cast("string") for i in (1, 2)]
        self.attrs = kept(self.ea.groupBy("attr").agg(F.count("*").alias("n"), F.concat_ws("|", *sign, F.count("*").cast("string")).alias("same")), "attributes")
        # one row for each attribute: numbered as a whole, their number does not grow with the entities
        self.listed = kept(self._counted(self.attrs), "listed")
        self.n = self.attrs.count()

    @staticmethod
    def _counted(attrs: DataFrame) -> DataFrame:
        """(attr, at, first, last): the attribute's number, by class and name, and the numbers of its class."""
        first = attrs.groupBy("same").agg(F.min("attr").alias("name"), F.count("*").alias("size"))
        before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
        first = first.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
        inside = F.row_number().over(Window.partitionBy("same").orderBy("attr")) - 1
        joined = attrs.join(first.drop("name"), "same").withColumn("at", F.col("first") + inside)
        return joined.select("attr", "at", "first", (F.col("first") + F.col("size") - 1).alias("last"))

    def entities(self, least: int) -> tuple[DataFrame, int]:
        """(at, entity, m) of entities with at least so many attributes, by their order, and their number."""
        own = self.sets.select("entity", F.size("attrs").cast("long").alias("m")).where(F.col("m") >= least)
        from rankloom.sources.judgments import assign_ids

        listed = assign_ids(own, "entity", "at").withColumn("at", F.col("at") - 1)
        return listed, own.count()

    def of_entities(self, entities: DataFrame) -> DataFrame:
        """(entity, attrs) of some entities."""
        return self.sets.join(entities.select("entity").distinct(), "entity", "left_semi")

    @cached_property
    def met(self) -> DataFrame:
        """(a, b, nab, differ) for a < b that some entity has both of; ``differ``: those entities do not all have the same attributes."""
        one = self.sets.select(F.xxhash64("attrs").alias("own"), "attrs", F.posexplode("attrs").alias("i", "a"))
        both = one.select("own", "a", F.explode(F.slice("attrs", F.col("i") + 2, F.size("attrs"))).alias("b"))
        pairs = both.groupBy("a", "b").agg(F.count("*").alias("nab"), (F.min("own") != F.max("own")).alias("differ"))
        return kept(pairs, "met")


def _skipping(at: Column, *taken: Column) -> Column:
    """The place that is number ``at`` among those not in ``taken`` (rising places)."""
    for place in taken:
        at = F.when(at >= place, at + 1).otherwise(at)
    return at


def _skipping_range(at: Column, first: Column, last: Column) -> Column:
    return F.when(at >= first, at + (last - first + 1)).otherwise(at)


def _named(rows: DataFrame, listed: DataFrame, place: str, name: str, more: bool = False) -> DataFrame:
    """The attribute at a place; ``more`` adds its class."""
    own = listed.select(F.col("at").alias(place), F.col("attr").alias(name), *([F.col("first").alias(f"{name}_first"), F.col("last").alias(f"{name}_last")] if more else []))
    return rows.join(own, place)


def _or(r: Relation, tries: DataFrame, seed: int, template: str, three: bool) -> DataFrame:
    """Attributes whose entity sets differ from the earlier ones', where there are such; else any others."""
    n = F.lit(r.n)
    rows = _named(tries.withColumn("ia", pick(seed, template, 0, n)), r.listed, "ia", "a", True)
    others = n - (F.col("a_last") - F.col("a_first") + 1)
    rows = rows.withColumn("ib", F.when(others > 0, _skipping_range(pick(seed, template, 1, others), F.col("a_first"), F.col("a_last"))).otherwise(_skipping(pick(seed, template, 1, n - 1), F.col("ia"))))
    rows = _named(rows, r.listed, "ib", "b", True)
    if not three:
        return rows.select("try", F.array("a", "b").alias("attrs"))
    low = lambda x, y: F.when(F.col("a_first") <= F.col("b_first"), F.col(x)).otherwise(F.col(y))
    l1, h1, l2, h2 = low("a_first", "b_first"), low("a_last", "b_last"), low("b_first", "a_first"), low("b_last", "a_last")
    one = F.col("a_first") == F.col("b_first")
    others = n - (h1 - l1 + 1) - F.when(one, 0).otherwise(h2 - l2 + 1)
    draw = pick(seed, template, 2, others)
    apart = _skipping_range(draw, l1, h1)
    apart = F.when(one, apart).otherwise(_skipping_range(apart, l2, h2))
    anyone = _skipping(pick(seed, template, 2, n - 2), F.least("ia", "ib"), F.greatest("ia", "ib"))
    rows = _named(rows.withColumn("ic", F.when(others > 0, apart).otherwise(anyone)), r.listed, "ic", "c")
    return rows.select("try", F.array("a", "b", "c").alias("attrs"))


def _also(r: Relation, tries: DataFrame, seed: int, template: str, k: int) -> DataFrame:
    """``k`` attributes of one entity that has so many."""
    listed, n = r.entities(k)
    rows = tries.withColumn("at", pick(seed, template, "entity", F.lit(n))).join(listed, "at")
    places: list[Column] = []
    for i in range(k):
        rows = rows.withColumn(f"p{i}", _skipping(pick(seed, template, i, F.col("m") - i), *places))
        places = [F.array_sort(F.array(*(F.col(f"p{j}") for j in range(i + 1))))[x] for x in range(i + 1)]
    rows = kept(rows, "drawn")
    own = rows.join(r.of_entities(rows).withColumnRenamed("attrs", "own"), "entity")
    return own.select("try", F.array(*(F.get("own", F.col(f"p{i}").cast("int")) for i in range(k))).alias("attrs"))


def _any(r: Relation, tries: DataFrame, seed: int, template: str, k: int) -> DataFrame:
    """Any ``k`` attributes."""
    rows, places = tries, []
    for i in range(k):
        rows = rows.withColumn(f"p{i}", _skipping(pick(seed, template, f"any{i}", F.lit(r.n - i)), *places))
        places = [F.array_sort(F.array(*(F.col(f"p{j}") for j in range(i + 1))))[x] for x in range(i + 1)]
    for i in range(k):
        rows = _named(rows, r.listed, f"p{i}", f"a{i}")
    return rows.select("try", F.array(*(F.col(f"a{i}") for i in range(k))).alias("attrs"))


def _unlucky(seed: int, template: str, share: float) -> Column:
    """Whether :data:`PAIR_TRIES` draws would all miss what a ``share`` of all draws is."""
    missed = (1 - share) ** PAIR_TRIES
    return pick(seed, template, "luck", F.lit(1 << 31)) < int(missed * (1 << 31))


def _chosen(rows: DataFrame, key: list[str], order: str, seed: int, template: str, place: int | str, tries: DataFrame) -> DataFrame:
    """For each try (with ``key``) one of the rows (key, order) of that key, drawn alike."""
    listed = rows.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1)
    size = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    return tries.join(size, key).withColumn("_p", pick(seed, template, place, F.col("_n"))).join(listed, [*key, "_p"]).drop("_n", "_p")


def _not(r: Relation, tries: DataFrame, seed: int, template: str) -> DataFrame:
    """A has entities with B and others without; any two where there are none."""
    p = r.met.select("a", "b", "nab").unionAll(r.met.select("b", "a", "nab"))
    both = kept(p.join(r.attrs.select(F.col("attr").alias("a"), "n"), "a").where("nab < n").select("a", "b"), "pairs")
    firsts = both.select("a").distinct()
    found, able = firsts.count(), r.attrs.where("n >= 2").count()
    share = found / able if able else 0.0
    luck = tries.withColumn("_bad", _unlucky(seed, template, share))
    good = _chosen(firsts.withColumn("_g", F.lit(0)), ["_g"], "a", seed, template, 0, luck.where(~F.col("_bad")).select("try", F.lit(0).alias("_g"))).drop("_g")
    good = _chosen(both, ["a"], "b", seed, template, 1, good).select("try", F.array("a", "b").alias("attrs"))
    return good.unionAll(_any(r, luck.where("_bad").select("try"), seed, template, 2))


def _and_not(r: Relation, tries: DataFrame, seed: int, template: str) -> DataFrame:
    """Entities with A and B, some of them with C and some without; any three where there are none.

    A pair has such a C if its entities do not all have the same attributes.
    """
    pairs = r.met.where("differ").select("a", "b", "nab")
    from rankloom.sources.judgments import assign_ids

    listed = assign_ids(pairs.withColumn("_o", F.concat_ws("|", "a", "b")), "_o", "at").select((F.col("at") - 1).alias("at"), "a", "b", "nab")
    n = pairs.count()
    share = n / (r.n * (r.n - 1) / 2) if r.n > 1 else 0.0
    luck = tries.withColumn("_bad", _unlucky(seed, template, share))
    good = kept(luck.where(~F.col("_bad")).select("try", pick(seed, template, 0, F.lit(n)).alias("at")).join(listed, "at").drop("at"), "drawn")
    asked = good.select("a", "b", "nab").distinct()  # no more than there are tries
    inside = r.sets.select("attrs", F.explode("attrs").alias("a")).join(F.broadcast(asked), "a").where(F.array_contains("attrs", F.col("b")))
    inside = inside.select("a", "b", "nab", F.explode("attrs").alias("c")).where("c <> a and c <> b")
    thirds = kept(inside.groupBy("a", "b", "nab", "c").agg(F.count("*").alias("nabc")).where("nabc < nab").select("a", "b", "c"), "thirds")
    turned = F.when(pick(seed, template, "turn", F.lit(2)) == 0, F.array("a", "b")).otherwise(F.array("b", "a"))  # which of the two comes first is drawn too
    good = _chosen(thirds, ["a", "b"], "c", seed, template, 1, good.select("try", "a", "b")).select("try", F.concat(turned, F.array("c")).alias("attrs"))
    return good.unionAll(_any(r, luck.where("_bad").select("try"), seed, template, 3))


#: Builders by template: (relation, tries, seed) to (try, attrs).
BUILDERS: dict[str, Callable[[Relation, DataFrame, int], DataFrame]] = {
    setalg.SINGLE: lambda r, tries, seed: _named(tries.withColumn("ia", pick(seed, setalg.SINGLE, 0, F.lit(r.n))), r.listed, "ia", "a").select("try", F.array("a").alias("attrs")),
    setalg.OR2: lambda r, tries, seed: _or(r, tries, seed, setalg.OR2, False),
    setalg.OR3: lambda r, tries, seed: _or(r, tries, seed, setalg.OR3, True),
    setalg.AND2: lambda r, tries, seed: _also(r, tries, seed, setalg.AND2, 2),
    setalg.AND3: lambda r, tries, seed: _also(r, tries, seed, setalg.AND3, 3),
    setalg.AND_NOT: lambda r, tries, seed: _and_not(r, tries, seed, setalg.AND_NOT),
    setalg.NOT: lambda r, tries, seed: _not(r, tries, seed, setalg.NOT),
}


def instances(relation: Relation, template: str, first: int, last: int, seed: int = 42) -> DataFrame:
    """(try, attrs) of tries ``first`` to ``last``; none where the relation has too few attributes."""
    spark = relation.ea.sparkSession
    if relation.n < setalg.ARITY[template]:
        return spark.createDataFrame([], "try long, attrs array<string>")
    return BUILDERS[template](relation, spark.range(first, last + 1).withColumnRenamed("id", "try"), seed)


@dataclass
class Acceptance:
    """The state of a scan over tries in order.

    First each range of counts has its quota; after ``with_quotas`` failures in a row any range is taken, until ``most`` are
    accepted or ``at_last`` failures in a row end it.  An attribute set is accepted once.  A success resets the failures.
    """

    most: int
    with_quotas: int = FAILURES_WITH_QUOTAS
    at_last: int = FAILURES_AT_LAST
    failures: int = 0
    quotas: bool = True
    done: bool = False
    taken: dict[tuple[str, ...], tuple[int, list[str], int]] = field(default_factory=dict)
    counts: list[int] = field(default_factory=lambda: [0] * len(BUCKETS))

    def failed(self, n: int) -> None:
        """``n`` tries fail, one after another."""
        limit = self.with_quotas if self.quotas else self.at_last
        if self.failures + n < limit:
            self.failures += n
            return
        n -= limit - self.failures
        if self.quotas:
            self.quotas, self.failures = False, 0
            self.failed(n)
        else:
            self.done = True

    def scan(self, tries: list[tuple[int, list[str], int, int]], first: int, last: int) -> None:
        """Tries ``first`` to ``last``, of which those given (try, attrs, num_docs, bucket; rising) have a count in the range."""
        at = first
        for number, attrs, num_docs, b in tries:
            self.failed(number - at)
            at = number + 1
            if self.done or len(self.taken) >= self.most:
                break
            key = tuple(sorted(attrs))
            if key in self.taken or self.quotas and (b < 0 or self.counts[b] >= max(1, self.most // len(BUCKETS))):
                self.failed(1)
                continue
            self.taken[key] = (number, attrs, num_docs)
            self.counts[b] += b >= 0
            self.failures = 0
        else:
            self.failed(last + 1 - at)
        self.done = self.done or len(self.taken) >= self.most


def rejection_sample(ea: DataFrame, template: str, most: int, least_docs: int, most_docs: int, seed: int = 42, with_quotas: int = FAILURES_WITH_QUOTAS, at_last: int = FAILURES_AT_LAST, round_: int = ROUND) -> DataFrame:
    """(try, template, attrs, num_docs) of the accepted tries, at most ``most``.

    Tries are built and counted in rounds of ``round_``; a round's valid tries, a bounded number of short rows, are scanned in order.
    """
    spark = ea.sparkSession
    relation = Relation(ea)
    state, first = Acceptance(most, with_quotas, at_last), 1
    enough = relation.n >= setalg.ARITY[template]
    while enough and not state.done:
        last = first + round_ - 1
        drawn = kept(instances(relation, template, first, last, seed).select(F.col("try").alias("id"), F.lit(template).alias("template"), "attrs"), "tries")
        counted = setalg.answer_counts(relation.sets, relation.attrs, drawn, least_docs, most_docs)
        rows = drawn.join(counted, "id").select("id", "attrs", "num_docs", bucket(F.col("num_docs")).alias("bucket")).collect()
        state.scan(sorted((r["id"], r["attrs"], r["num_docs"], r["bucket"]) for r in rows), first, last)
        first = last + 1
    return spark.createDataFrame([(n, template, attrs, docs) for n, attrs, docs in state.taken.values()], "try long, template string, attrs array<string>, num_docs long")
