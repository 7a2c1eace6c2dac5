"""DuckDB SQL for those queries that SQL can express over whole tables."""

from __future__ import annotations

from rankloom.llm import decontaminate, topk, url_filter

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_WORD}'), []) w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_WORD}'), []) w FROM benchmark),
t AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') win FROM (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) size, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM t),
p AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) i FROM d JOIN z ON size <= len(w))),
m AS (SELECT doc_id, item_id, i, p.size FROM p JOIN t USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) j FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) n_items, string_agg(k, ',' ORDER BY k) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR k FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id a, y.doc_id b, count(*) met FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * met >= 85 * (na.n + nb.n - met)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0) n_shingles, min(b) component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""

TOPK = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT score FROM e q JOIN e d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= {topk.K_BEST}
"""


def url_sql() -> str:
    model = url_filter.NgramLogistic().fit(url_filter.LABELLED)
    fits = sorted(url_filter.RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h + p)}'" for v, h, p in fits) + " END"
    rest = "coalesce(CASE WHEN contains(url, '://') THEN split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) END, '')"
    grams = " UNION ALL ".join(f"SELECT page_id, substr(x, i, {n}) g FROM (SELECT page_id, x, unnest(range(1, length(x) - {n - 2})) i FROM t)" for n in model.n)
    weights = "[" + ", ".join(f"{w:.9g}::DOUBLE" for w in model.weights) + "]"
    return f"""
WITH a AS (SELECT page_id, {rest} rest FROM pages), h AS (SELECT page_id, {_LOWER.format("split_part(rest, '/', 1)")} host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM a),
t AS (SELECT page_id, '^' || host || path || '$' x FROM h), w AS (SELECT {weights} w), g AS ({grams}),
z AS (SELECT page_id, sum(w[('0x' || substr(md5(g), 1, 6))::BIGINT % {model.dims} + 1]) / sqrt(count(*)) s FROM g, w GROUP BY page_id)
SELECT page_id, host, path, {case(lambda v, r: r)} AS rule, coalesce({case(lambda v, r: v)}, CASE WHEN 1 / (1 + exp(-(coalesce(s, 0) + {model.bias!r}))) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN z USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": DECONTAMINATION, "op6_url_filter": url_sql(), "op7_ngram_jaccard_join": JACCARD, "op12_exact_topk": TOPK}
