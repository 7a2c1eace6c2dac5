"""Extension points: parsers, probability estimators, reasoners, encoders and generators given as functions.

Models and services are outside the engine.  It moves data to them in Arrow batches and takes tables
back, so that a run can also start from values computed elsewhere.
"""

from __future__ import annotations

import resource
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.boolean import atoms_of, parse
from rankloom.operators.sampling import distinct_sets, witnesses


def parsed_queries(queries: DataFrame, parse_query: Callable[[str], dict], key: str = "qid", text: str = "query") -> DataFrame:
    """(qid, query, atoms, expr) by a parser of texts; its expression is checked on the way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [parse_query(q) for q in rows[text]]
            for f in found:
                atoms_of(parse(f["expr"], f["atoms"]))
            yield pd.DataFrame({"qid": rows[key].astype(str), "query": rows[text], "atoms": [f["atoms"] for f in found], "expr": [f["expr"] for f in found]})

    return queries.select(key, text).mapInPandas(run, "qid string, query string, atoms array<string>, expr string")


def estimated(pairs: DataFrame, probabilities: Callable[[list[str], dict], dict[str, float]]) -> DataFrame:
    """(qid, docid, atom, p) by an estimator, for rows (qid, docid, atoms, and what it is told of the document)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(r["qid"], r["docid"], a, float(p)) for r in rows.to_dict("records") for a, p in probabilities(list(r["atoms"]), r).items()]
            yield pd.DataFrame(out, columns=["qid", "docid", "atom", "p"])

    return pairs.mapInPandas(run, "qid string, docid string, atom string, p double")


def reasoned(entries: DataFrame, rank: Callable[[pd.DataFrame], list[tuple[str, float]]], key: str = "qid") -> DataFrame:
    """(qid, docid, p) by a reasoner that sees one query's bounded candidate list at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = rank(rows)
        return pd.DataFrame({"qid": [str(rows[key].iloc[0])] * len(out), "docid": [d for d, _ in out], "p": [float(p) for _, p in out]})

    return entries.groupBy(key).applyInPandas(run, "qid string, docid string, p double")


def encoded(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], key: str = "docid", text: str = "text", batch: int = 64) -> DataFrame:
    """(docid, embedding) by an encoder of batches of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lo in range(0, len(rows), batch):
                part = rows.iloc[lo : lo + batch]
                yield pd.DataFrame({key: part[key], "embedding": [[float(x) for x in v] for v in encode(part[text].tolist())]})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def generated(prompts: DataFrame, answers: DataFrame, key: str = "key") -> DataFrame:
    """Prompts with answers computed elsewhere; those without one have a null answer."""
    return prompts.join(answers.select(key, "answer", "in_tokens", "out_tokens"), key, "left")


def by_key(rows: DataFrame, key: Callable[[DataFrame], Column], values: list[str]) -> DataFrame:
    """Means by a key that is any function of the row."""
    from rankloom.operators.aggregates import mean_by_key

    return mean_by_key(rows, key(rows), values)


#: Builders of candidate filters by template: each takes (relation, pairs) and gives the pairs it lets pass.
BUILDERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"_ or _": distinct_sets, "_ that are not _": witnesses, "_ that are also _": lambda ea, pairs: pairs.where("num_docs > 0")}


def candidates(ea: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of all templates, each filtered by its builder."""
    out = pairs.where(~F.col("template").isin(*BUILDERS))
    for template, build in BUILDERS.items():
        out = out.unionByName(build(ea, pairs.where(F.col("template") == template)))
    return out


def timed(name: str, action: Callable[[], object]) -> dict:
    """Wall time of a step and the driver's peak memory, for a table of steps."""
    begin = time.perf_counter()
    action()
    return {"step": name, "seconds": time.perf_counter() - begin, "driver_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024}


def append_steps(spark: SparkSession, steps: list[dict], path: str) -> None:
    """Add measured steps to a CSV table."""
    rows = spark.createDataFrame([(x["step"], x["seconds"], x["driver_mb"]) for x in steps], "step string, seconds double, driver_mb double")
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)
