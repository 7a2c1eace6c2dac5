"""Text functions of the retrieval pipelines: ids, names, prompts, answers, chunks and estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.lexing import trimmed
from rankloom.functions.states import split_outside

#: Property names that carry no evidence for a query (those of ids are known by their names).
USELESS_PROPERTIES = (
    "MPA film rating", "Plex media key", "IGAC rating", "review score", "official website", "box office", "EIRIN film rating", "title", "cast", "ISAN", "cost", "duration",
)


def md5_prefix(text: Column, size: int = 16) -> Column:
    return F.substring(F.md5(text), 1, size)


def cache_key(*parts: Column) -> Column:
    """sha1 over the parts as JSON, so that (a, bc) and (ab, c) differ."""
    return F.sha1(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("\0")) for p in parts))))


def content_hash(ordered: Column, size: int = 24) -> Column:
    """sha256 over texts in order, each followed by a new line."""
    return F.substring(F.sha2(F.array_join(F.transform(ordered, lambda t: F.concat(t, F.lit("\n"))), ""), 256), 1, size)


def predicate_name(text: Column) -> Column:
    """Lower case, runs of all but letters and digits as one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._\-]+", "_")


def clean_title(title: Column) -> Column:
    """A title without its bracketed qualifier, spaces as ``_``."""
    return F.regexp_replace(trimmed(F.regexp_replace(title, r"\s*\([^)]*\)", "")), r"\s+", "_")


def first_year(dates: Column) -> Column:
    """The part before the first ``-`` of the first date; null without dates."""
    return F.split(F.try_element_at(dates, F.lit(1)), "-")[0]


def flat_properties(properties: Column) -> Column:
    """``name: v1,v2.`` for each property, joined by spaces."""
    return F.array_join(F.transform(F.map_entries(properties), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ","), F.lit("."))), " ")


def kept_properties(properties: Column, useless: tuple[str, ...] = USELESS_PROPERTIES, prefixes: tuple[str, ...] = ()) -> Column:
    """Properties but those listed, those of ids and ISBNs, those of given prefixes, and statement values."""
    named = F.map_filter(properties, lambda k, v: ~k.isin(*useless) & ~k.contains("ID") & ~k.contains("ISBN"))
    for p in prefixes:
        named = F.map_filter(named, lambda k, v, p=p: ~k.startswith(p))
    return F.transform_values(named, lambda k, v: F.filter(v, lambda x: ~x.startswith("statement/")))


def underscored_properties(properties: Column) -> Column:
    return F.transform_keys(properties, lambda k, v: F.replace(k, F.lit(" "), F.lit("_")))


def premises(properties: Column) -> Column:
    """array<struct<property, values>>, with spaces as ``_`` and publication dates cut to the year."""
    def one(e: Column) -> Column:
        name = F.replace(e["key"], F.lit(" "), F.lit("_"))
        values = F.when(name == "publication_date", F.array(first_year(e["value"]))).otherwise(e["value"])
        return F.struct(name.alias("property"), F.transform(values, lambda v: F.replace(v, F.lit(" "), F.lit("_"))).alias("values"))

    return F.transform(F.map_entries(properties), one)


def marked(query: Column) -> Column:
    """All ``<mark>`` spans."""
    return F.regexp_extract_all(query, F.lit("<mark>(.*?)</mark>"), 1)


def kept_categories(categories: Column, query: Column) -> Column:
    """Categories, without their prefix, that the query marks."""
    return F.array_intersect(F.transform(categories, lambda c: F.replace(c, F.lit("Category:"), F.lit(""))), marked(query))


def single_attribute(query: Column) -> Column:
    """X of ``Who likes X?``; null for other texts."""
    return F.nullif(F.regexp_extract(query, r"^Who likes (.*)\?$", 1), F.lit(""))


def token_estimate(text: Column) -> Column:
    """A token for each four characters, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")


def likes(text: Column) -> Column:
    """Attributes listed after the first ``likes``: the distinct items between commas, the last of several also cut at `` and ``."""
    after = F.get(F.split(text, "likes", 2), F.lit(1))
    items = F.transform(F.split(after, ","), lambda x: F.regexp_replace(trimmed(x), r"\.+$", ""))
    bare = lambda x: trimmed(F.regexp_replace(x, r"(?i)^and ", ""))
    last = F.element_at(items, -1)
    parts = F.when((F.size(items) > 1) & last.contains(" and "), F.transform(F.split(last, " and "), lambda x: bare(trimmed(x)))).otherwise(F.array(bare(last)))
    found = F.concat(F.transform(F.slice(items, F.lit(1), F.size(items) - 1), bare), parts)
    return F.when(after.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(found, lambda x: x != "")))


def chunks(text: Column, whole_below: int = 6144, size: int = 8192, overlap: int = 800) -> Column:
    """array<string>: a short text whole, a long one in windows that overlap; the last one may be overlap alone."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(text) < whole_below, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))))


def first_pieces(text: Column, n: int = 384) -> Column:
    """The first n pieces, a piece being a word or a mark of punctuation."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0), 1, n), " ")


def encoder_input(encoder: str, text: Column, role: str = "query", instruction: str = "") -> Column:
    """A text with what an encoder wants before it."""
    if encoder == "e5":
        return F.concat(F.lit("query: " if role == "query" else "passage: "), text)
    if encoder == "spaced":
        return F.concat(F.lit("query:  " if role == "query" else "passage:  "), text, F.lit(f" {instruction}" if instruction and role == "query" else ""))
    if encoder == "instruct":
        return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text) if role == "query" else text
    if encoder == "embed":
        return F.concat(F.lit(f"<|user|>\n{instruction}\n<|embed|>\n" if instruction else "<|embed|>\n"), text)
    if encoder == "raw":
        return trimmed(text)
    raise ValueError(f"unknown encoder {encoder}")


def titled(title: Column, text: Column) -> Column:
    """``title. text`` without white space at the ends."""
    return trimmed(F.concat(title, F.lit(". "), text))


def cross_encoder_input(query: Column, document: Column) -> Column:
    return F.format_string("query: %s, doc: %s", query, document)


def tsv_clean(text: Column) -> Column:
    """Tabs and new lines as spaces, triple quotes removed."""
    return F.translate(F.replace(text, F.lit("'''"), F.lit("")), "\t\n", "  ")


def context(mode: str, atom: Column, article: Column, properties: Column) -> Column:
    """What a prompt tells about an entity: ``atom``, ``wiki``, ``wd`` or ``full``."""
    parts = {"atom": [atom], "wiki": [atom, article], "wd": [atom, flat_properties(properties)], "full": [atom, article, flat_properties(properties)]}
    if mode not in parts:
        raise ValueError(f"unknown context {mode}")
    return F.concat_ws("\n", *parts[mode])


def prompt(template: str, **values: Column) -> Column:
    """A template's ``{name}`` places filled from columns; null counts as empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def answer(text: Column) -> Column:
    """``True`` or ``False`` from a model's reply: of its first JSON object, else after ``Answer:`` or ``Answer=``; else null."""
    block = F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0)
    parsed = F.coalesce(F.get_json_object(block, "$.Answer"), F.get_json_object(F.translate(block, "'", '"'), "$.Answer"))
    spoken = F.regexp_extract(text, r"(?i)answer[\"']?\s*[:=]\s*[\"']?(true|false)", 1)
    found = F.initcap(F.coalesce(F.when(F.lower(parsed).isin("true", "false"), parsed), F.nullif(spoken, F.lit(""))))
    return F.when(found.isin("True", "False"), found)


def verdict_score(text: Column) -> Column:
    return F.when(answer(text) == "True", 1.0).otherwise(0.0)


def fenced(text: Column, language: str, last: bool = True) -> Column:
    """The body of the last (or first) fenced block of a language; null without one."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?si)```{language}\s*(.*?)```"), 1)
    return F.try_element_at(blocks, F.lit(-1 if last else 1))


def balanced_split(text: Column) -> Column:
    """Parts between commas that stand in no quotes and no brackets, at any depth."""
    return split_outside(text)


def section_header(line: Column) -> Column:
    """Whether a line is a heading: it ends in a colon, or starts with ``#``."""
    return trimmed(line).rlike(r"^(#+\s*\S.*|[A-Za-z][A-Za-z _\-]*:)$")


def sections(text: Column) -> Column:
    """array<struct<header, lines>> of a text with headings; lines before the first one have the header ''."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")
    start = F.array().cast("array<struct<header:string,lines:array<string>>>")

    def step(acc: Column, line: Column) -> Column:
        header = F.regexp_replace(line, r"^#+\s*|:$", "")
        last = F.element_at(acc, -1)
        longer = F.struct(last["header"].alias("header"), F.concat(last["lines"], F.array(line)).alias("lines"))
        first = F.struct(F.lit("").alias("header"), F.array(line).alias("lines"))
        more = F.when(F.size(acc) == 0, F.array(first)).otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer)))
        return F.when(section_header(line), F.concat(acc, F.array(F.struct(header.alias("header"), F.array().cast("array<string>").alias("lines"))))).otherwise(more)

    return F.aggregate(lines, start, step)


def percent_difference(new: Column, old: Column) -> Column:
    """(new - old) / old * 100; 0 where old is 0."""
    return F.when(old == 0, 0.0).otherwise((new - old) / old * 100)
