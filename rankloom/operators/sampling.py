"""Stratified samples.  Draws are ordered by a hash of seed and key, so that they repeat and need no shared state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.joins import ByLabel, with_relevance
from rankloom.sources.scratch import kept

#: Ranges of document counts.
BUCKETS = ((1, 20), (21, 50), (51, 100), (101, 150), (151, 200))


def bucket(n: Column) -> Column:
    """The index of the range that holds n; -1 for none."""
    out = F.lit(-1)
    for i, (lo, hi) in reversed(list(enumerate(BUCKETS))):
        out = F.when(n.between(lo, hi), i).otherwise(out)
    return out


def draw(seed: int, *key: str) -> Column:
    """A number that orders rows at random; md5 so that other engines can draw alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def stratified(rows: DataFrame, most: int, key: list[str], count: str = "num_docs", by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """At most ``most`` rows (of each ``by``): a fifth of them from each range of counts, then topped up from the rest."""
    by = by or []
    order = draw(seed, *by, *key)
    marked = rows.withColumn("bucket", bucket(F.col(count))).where("bucket >= 0").withColumn("_o", order)
    within = Window.partitionBy(*by, "bucket").orderBy("_o", *key)
    first = marked.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= most)  # no stratum gives more
    whole = Window.partitionBy(*by).orderBy((F.col("_n") > most // len(BUCKETS)).cast("int"), "_o", *key)
    return first.withColumn("_m", F.row_number().over(whole)).where(F.col("_m") <= most).drop("_o", "_n", "_m")


def equal_by_template(rows: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """n // templates rows of each template, without replacement."""
    templates = rows.select("template").distinct().count()
    each = n // templates if templates else 0
    order = Window.partitionBy("template").orderBy(draw(seed, key), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_n")


def sample_rows(rows: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    return rows.orderBy(draw(seed, key), key).limit(n)


def enumerated_queries(combinations: DataFrame, most: int, seed: int = 42, once: bool = False) -> DataFrame:
    """A stratified sample of each template's combinations (template, attrs, num_docs); ``once`` keeps one order of each attribute set."""
    rows = combinations.withColumn("_set", F.array_join(F.sort_array("attrs"), "|"))
    if once:
        first = Window.partitionBy("template", "_set").orderBy(draw(seed, "template", "_set"), F.array_join("attrs", "|"))
        rows = rows.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    rows = rows.withColumn("_key", F.array_join("attrs", "|"))
    return stratified(rows, most, ["_key"], by=["template"], seed=seed).drop("_set", "_key")


def witnesses(ea: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) for not-templates that have an entity with a and b and one with a alone."""
    from rankloom.operators.setalg import pair_counts

    p = pair_counts(ea, grid=False)
    both = p.select(F.col("a").alias("a"), F.col("b").alias("b"), "na", "nab").unionAll(p.select(F.col("b"), F.col("a"), "nb", "nab"))
    return pairs.join(both, ["a", "b"]).where("nab > 0 and na > nab").select(*pairs.columns)


def distinct_sets(ea: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) for or-templates whose attributes have different entity sets: equal sets are as large as their intersection."""
    from rankloom.operators.setalg import pair_counts

    same = pair_counts(ea, grid=False).where("na = nab and nb = nab").select("a", "b")
    both = same.unionAll(same.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti").where("a <> b").select(*pairs.columns)


def _number(text: Column) -> Column:
    """The first 32 bits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    from rankloom.sources.judgments import assign_ids

    return assign_ids(rows, order, name)


#: Combinations that are enumerated at most; beyond, they are drawn.
ENUMERATED = 50_000


def drawn_combinations(ea: DataFrame, template: str, tries: int, least: int, most: int, seed: int = 42) -> DataFrame:
    """(template, attrs, num_docs): combinations of attributes drawn at random, of which those within the range stay.

    Each try takes its attributes by a hash of seed, template, try and place; tries that repeat an attribute, or a set where
    order doesn't matter, are rejected.  Those that their attributes' sizes do not rule out are counted in one pass over the entities.
    """
    from rankloom.operators import setalg

    spark = ea.sparkSession
    ea = kept(ea.distinct(), "relation")
    sizes = kept(ea.groupBy("attr").agg(F.count("*").alias("n")), "sizes")
    listed = _numbered(sizes.select("attr"), "attr", "_at")
    n = listed.count()
    places = range(setalg.ARITY[template])
    draws = spark.range(1, tries + 1).withColumnRenamed("id", "try")
    for i in places:
        draws = draws.withColumn("_at", F.pmod(_number(F.concat_ws("|", F.lit(str(seed)), F.lit(template), F.col("try").cast("string"), F.lit(str(i)))), F.lit(max(1, n))) + 1)
        draws = draws.join(listed.withColumnRenamed("attr", f"a{i}"), "_at").drop("_at")
    attrs = F.array(*(F.col(f"a{i}") for i in places))
    if template in setalg.UNORDERED:
        attrs = F.sort_array(attrs)
    own = draws.withColumn("attrs", attrs).where(F.size(F.array_distinct("attrs")) == len(places)).groupBy("attrs").agg(F.min("try").alias("id"))
    queries = kept(own.select("id", F.lit(template).alias("template"), "attrs"), "tries")
    counted = setalg.answer_counts(setalg.attribute_sets(ea), sizes, queries, least, most)
    return queries.join(counted, "id").select("template", "attrs", "num_docs")


def combinations(ea: DataFrame, template: str, least: int, most: int, tries: int = 8_000, seed: int = 42) -> DataFrame:
    """(template, attrs, num_docs) of a template: all valid ones where there are at most ``ENUMERATED`` combinations, else those of random tries."""
    from rankloom.operators import setalg

    ea = ea.distinct()
    if setalg.upper_bound(template, ea.select("attr").distinct().count()) > ENUMERATED:
        return drawn_combinations(ea, template, tries, least, most, seed)
    names = "abc"[: setalg.ARITY[template]]
    if len(names) == 1:
        rows = setalg.singles(ea).select(F.lit(template).alias("template"), "a", F.col("na").alias("num_docs")).where(F.col("num_docs").between(least, most))
    else:
        rows = (setalg.valid_pairs if len(names) == 2 else setalg.valid_triples)(ea, least, most).where(F.col("template") == template)
    return rows.select("template", F.array(*names).alias("attrs"), "num_docs")


def training_pairs(gold: DataFrame, predicted: DataFrame, docs: DataFrame, positives: int = 50, negatives: int = 250, seed: int = 42) -> DataFrame:
    """(query, title, label): gold repeated, the first wrong predictions, and ``negatives`` random documents less those that are gold.

    Random documents come from one list of titles in the order of a hash, of which each query takes a stretch of its own.
    """
    pos = gold.select("query", "title", F.explode(F.sequence(F.lit(1), F.lit(positives))).alias("_c")).drop("_c").withColumn("label", F.lit("relevant"))
    wrong = predicted.join(gold, ["query", "title"], "left_anti")
    order = Window.partitionBy("query").orderBy("rank")
    wrong = wrong.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= negatives).select("query", "title", F.lit("not relevant").alias("label"))
    titles = docs.select("title").distinct()
    n = titles.count()
    listed = _numbered(titles.withColumn("_o", F.concat(draw(seed, "title"), "title")), "_o", "_at").select("title", (F.col("_at") - 1).alias("slot"))
    start = _number(F.concat_ws("|", F.lit(str(seed)), F.col("query").cast("string")))
    stretch = F.explode(F.sequence(F.lit(0), F.lit(min(negatives, n) - 1))) if min(negatives, n) else F.explode(F.array().cast("array<int>"))
    wanted = gold.select("query").distinct().select("query", stretch.alias("i")).select("query", F.pmod(start + F.col("i"), F.lit(max(1, n))).alias("slot"))
    random = wanted.join(listed, "slot").select("query", "title").join(gold, ["query", "title"], "left_anti").select("query", "title", F.lit("not relevant").alias("label"))
    return pos.unionAll(wrong).unionAll(random)


def training_inputs(pairs: DataFrame, docs: DataFrame, seed: int = 42) -> DataFrame:
    """(query, title, label, input) of training pairs with their documents' texts (empty where there is none), in an order fixed by the seed."""
    from rankloom.functions.text import cross_encoder_input, titled

    joined = pairs.join(docs.groupBy("title").agg(F.first("text").alias("text")), "title", "left")
    full = joined.select("query", "title", "label", cross_encoder_input(F.col("query"), titled(F.col("title").cast("string"), F.coalesce("text", F.lit("")))).alias("input"))
    return full.orderBy(draw(seed, "query", "title", "label"), "query", "title")


def curated_candidates(gold: DataFrame | ByLabel, scored: DataFrame, irrelevant: int = 5, noise: int = 5) -> DataFrame:
    """(qid, docid, kind): gold, the lowest-scored documents, and the highest-scored that are not gold."""
    others = with_relevance(scored, gold).where("not rel").drop("rel")
    gold = gold.pairs() if isinstance(gold, ByLabel) else gold
    low = Window.partitionBy("qid").orderBy("score", "docid")
    high = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    worst = others.withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= irrelevant).select("qid", "docid", F.lit("irrelevant").alias("kind"))
    best = others.withColumn("_n", F.row_number().over(high)).where(F.col("_n") <= noise).select("qid", "docid", F.lit("noise").alias("kind"))
    return gold.select("qid", "docid", F.lit("gold").alias("kind")).unionAll(worst).unionAll(best)


def inference_pairs(predictions: DataFrame, docs: DataFrame, k: int = 100) -> DataFrame:
    """(line_no, pos, query, title, input, label) of the first k predictions of each query."""
    from rankloom.functions.text import cross_encoder_input
    from rankloom.operators.joins import texts_of_predictions

    items = predictions.select("line_no", "query", F.posexplode("docs").alias("pos", "title")).where(F.col("pos") < k)
    full = texts_of_predictions(items, docs)
    return full.select("line_no", "pos", "query", "title", cross_encoder_input(F.col("query"), F.col("text")).alias("input"), F.lit("relevant").alias("label"))
