"""State machines over characters and lines, as folds of built-in functions: statements split outside of quotes and brackets, and logic blocks of replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.lexing import trimmed

#: What a block of logic begins with, and what ends one.
FOL = "FOL;"
ENDS = r"^(FOL;|TEXT;|TEXT:|(?i:<\s*/?\s*(EVALUATE|CONCLUSION|PREMISES|Entity)\s*>)|$)"
CURLY = ("\u201c\u201d\u2018\u2019", "\"\"''")


def split_outside(text: Column, brackets: str = "()[]") -> Column:
    """array<string>: the trimmed parts between commas that stand in no quotes and no brackets, at any depth.

    One pass over the marks, and over what stands between them as a whole, keeps which quote is open, how deep brackets are, and whether the character before was a backslash, which takes its
    meaning from the next one.  Quotes of the other kind and brackets mean nothing within quotes; a closing bracket that opens nowhere is passed over.  Nothing
    after the last comma gives no part.
    """
    opening, closing = brackets[::2], brackets[1::2]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("quote"), F.lit(0).alias("depth"), F.lit(False).alias("escaped"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, c: Column) -> Column:
        plain = ~s["escaped"]
        free = plain & (s["quote"] == "")
        is_quote = plain & c.isin("'", '"')
        quote = F.when(is_quote & (s["quote"] == ""), c).when(is_quote & (s["quote"] == c), F.lit("")).otherwise(s["quote"])
        depth = F.when(free & c.isin(*opening), s["depth"] + 1).when(free & c.isin(*closing), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cuts = F.when(free & (s["depth"] == 0) & (c == ","), F.concat(s["cuts"], F.array(s["at"] + 1))).otherwise(s["cuts"])
        return F.struct((s["at"] + F.char_length(c)).alias("at"), quote.alias("quote"), depth.alias("depth"), (plain & (c == "\\")).alias("escaped"), cuts.alias("cuts"))

    marks = "'\",\\\\" + re.escape(brackets)
    tokens = F.regexp_extract_all(text, F.lit(f"[^{marks}]+|[{marks}]"), 0)
    cuts = F.aggregate(tokens, start, step)["cuts"]
    begins, ends = F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(F.char_length(text) + 1))
    parts = F.zip_with(begins, ends, lambda b, e: F.struct(F.substring(text, b + 1, e - b - 1).alias("part"), (e > F.char_length(text)).alias("last")))
    return F.transform(F.filter(parts, lambda p: ~p["last"] | (p["part"] != "")), lambda p: trimmed(p["part"]))


def logic_blocks(text: Column) -> Column:
    """array<string>: what follows each ``FOL;``, with the lines up to the next heading; curly quotes are made straight, backslashes dropped."""
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<string>").alias("done"))
    ended = lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))

    def step(s: Column, line: Column) -> Column:
        begins = line.startswith(FOL)
        now = F.when(begins, trimmed(F.substring(line, len(FOL) + 1, F.length(line)))).when(s["now"].isNull() | line.rlike(ENDS), F.lit(None).cast("string")).otherwise(F.concat(s["now"], F.lit(" "), line))
        return F.struct(now.alias("now"), F.when(line.rlike(ENDS), ended(s)).otherwise(s["done"]).alias("done"))

    plain = F.replace(F.translate(text, *CURLY), F.lit("\\"), F.lit(""))
    return ended(F.aggregate(F.transform(F.split(plain, "\n"), trimmed), start, step))


def logic_expressions(text: Column) -> Column:
    """array<string>: the expressions of all logic blocks of a reply, without quotes around them; empty ones are left out."""
    parts = F.flatten(F.transform(logic_blocks(text), lambda b: split_outside(b, "()")))
    bare = F.transform(parts, lambda p: F.when((F.length(p) > 1) & (F.left(p, F.lit(1)) == F.right(p, F.lit(1))) & F.left(p, F.lit(1)).isin("'", '"'), F.substring(p, F.lit(2), F.length(p) - 2)).otherwise(p))
    return F.filter(bare, lambda p: p != "")
