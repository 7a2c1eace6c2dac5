"""Registered queries of random template instances and of their ordered acceptance; SQL draws the same numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import drawing, setalg
from rankloom.plans.catalog import EA_SQL, entity_attributes, query

TRIES = 200


def _pick(template: str, place: str, of: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}|{template}|' || try || '|{place}'), 1, 8))::BIGINT % greatest(({of})::BIGINT, 1))"


#: A place among those that are not taken: one place, or a range of them, is passed over.
_skip = lambda at, place: f"({at} + CASE WHEN {at} >= {place} THEN 1 ELSE 0 END)"
_skip_range = lambda at, lo, hi: f"({at} + CASE WHEN {at} >= {lo} THEN {hi} - {lo} + 1 ELSE 0 END)"

#: Attributes numbered by class (equal entity sets, in the order of their first names) and name.
NUMBERED_SQL = EA_SQL + """, sets AS (SELECT attr, list(entity ORDER BY entity) es, count(*) n FROM ea GROUP BY attr), cls AS (SELECT es, min(attr) name, count(*) size FROM sets GROUP BY es),
clb AS (SELECT es, size, coalesce(sum(size) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT f FROM cls),
num AS (SELECT attr, s.n, f, f + size - 1 l, f + row_number() OVER (PARTITION BY s.es ORDER BY attr) - 1 AS i FROM sets s JOIN clb ON s.es = clb.es), na AS (SELECT count(*) n FROM num)"""


def _or_sql(template: str, tries: str) -> str:
    """Two attributes with their places and classes, of different entity sets where there are such."""
    a = f"SELECT try, attr a, i ia, f af, l al, na.n FROM {tries}, na JOIN num ON i = {_pick(template, '0', 'na.n')}"
    b = f"CASE WHEN n - (al - af + 1) > 0 THEN {_skip_range(_pick(template, '1', 'n - (al - af + 1)'), 'af', 'al')} ELSE {_skip(_pick(template, '1', 'n - 1'), 'ia')} END"
    return f"(SELECT x.*, num.attr b, num.i ib, num.f bf, num.l bl FROM (SELECT *, {b} jb FROM ({a})) x JOIN num ON num.i = jb)"


def _third_sql(template: str) -> str:
    one = "af = bf"
    others = f"n - (lh - ll + 1) - CASE WHEN {one} THEN 0 ELSE hh - hl + 1 END"
    apart = _skip_range(_pick(template, "2", others), "ll", "lh")
    anyone = _skip(_skip(_pick(template, "2", "n - 2"), "least(ia, ib)"), "greatest(ia, ib)")
    at = f"CASE WHEN {others} <= 0 THEN {anyone} WHEN {one} THEN {apart} ELSE {_skip_range(apart, 'hl', 'hh')} END"
    rows = f"(SELECT *, least(af, bf) ll, CASE WHEN af <= bf THEN al ELSE bl END lh, greatest(af, bf) hl, CASE WHEN af <= bf THEN bl ELSE al END hh FROM {_or_sql(template, 't')})"
    return f"(SELECT y.try, [a, b, num.attr] attrs FROM (SELECT *, {at} jc FROM {rows}) y JOIN num ON num.i = jc)"


def _also_sql(template: str, k: int) -> str:
    """Attributes of one entity: places in its sorted list, each among those not taken."""
    own = f"SELECT entity, list(attr ORDER BY attr) l, row_number() OVER (ORDER BY entity) - 1 i, count(*) OVER () ne FROM ea GROUP BY entity HAVING count(*) >= {k}"
    rows = f"SELECT try, l, len(l) m FROM t, (SELECT count(*) ne FROM (SELECT entity FROM ea GROUP BY entity HAVING count(*) >= {k})) c JOIN ({own}) e ON e.i = {_pick(template, 'entity', 'c.ne')}"
    p0 = f"SELECT *, {_pick(template, '0', 'm')} p0 FROM ({rows})"
    p1 = f"SELECT *, {_skip(_pick(template, '1', 'm - 1'), 'p0')} p1 FROM ({p0})"
    if k == 2:
        return f"(SELECT try, [l[p0 + 1], l[p1 + 1]] attrs FROM ({p1}))"
    p2 = f"SELECT *, {_skip(_skip(_pick(template, '2', 'm - 2'), 'least(p0, p1)'), 'greatest(p0, p1)')} p2 FROM ({p1})"
    return f"(SELECT try, [l[p0 + 1], l[p1 + 1], l[p2 + 1]] attrs FROM ({p2}))"


_UNLUCKY = lambda template, share: f"{_pick(template, 'luck', str(1 << 31))} < floor(power(1 - ({share}), {drawing.PAIR_TRIES}) * {1 << 31})"
_ANY2 = lambda t: f"(SELECT try, [x.attr, y.attr] attrs FROM (SELECT try, p0, {_skip(_pick(t, 'any1', 'n - 1'), 'p0')} p1 FROM (SELECT try, n, {_pick(t, 'any0', 'n')} p0 FROM bad, na)) z JOIN num x ON x.i = p0 JOIN num y ON y.i = p1)"

_NOT_SQL = f"""both_ AS (SELECT x.attr a, y.attr b FROM ea x JOIN ea y ON x.entity = y.entity AND x.attr <> y.attr JOIN sets s ON s.attr = x.attr GROUP BY x.attr, y.attr, s.n HAVING count(*) < s.n),
fst AS (SELECT a, row_number() OVER (ORDER BY a) - 1 i FROM (SELECT DISTINCT a FROM both_)), snd AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) - 1 i, count(*) OVER (PARTITION BY a) n FROM both_),
nbad AS (SELECT try, {_UNLUCKY(setalg.NOT, "CASE WHEN able > 0 THEN found / able ELSE 0 END")} bad FROM t, (SELECT (SELECT count(*) FROM fst) found, (SELECT count(*) FROM sets WHERE n >= 2) able)),
nots AS (SELECT try, [g.a, snd.b] attrs FROM (SELECT try, fst.a FROM nbad, (SELECT count(*) n FROM fst) c JOIN fst ON fst.i = {_pick(setalg.NOT, "0", "c.n")} WHERE NOT bad) g JOIN snd ON snd.a = g.a AND snd.i = {_pick(setalg.NOT, "1", "snd.n")})"""

_AND_NOT_SQL = f"""own AS (SELECT entity, list(attr ORDER BY attr) l FROM ea GROUP BY entity),
prs AS (SELECT a, b, nab, row_number() OVER (ORDER BY a || '|' || b) - 1 i FROM (SELECT x.attr a, y.attr b, count(*) nab FROM ea x JOIN ea y ON x.entity = y.entity AND x.attr < y.attr JOIN own ON own.entity = x.entity GROUP BY ALL HAVING count(DISTINCT l) > 1)),
abad AS (SELECT try, {_UNLUCKY(setalg.AND_NOT, "found / (n * (n - 1) / 2)")} bad FROM t, na, (SELECT count(*) found FROM prs)),
apr AS (SELECT try, a, b, nab FROM abad, (SELECT count(*) n FROM prs) c JOIN prs ON prs.i = {_pick(setalg.AND_NOT, "0", "c.n")} WHERE NOT bad),
thr AS (SELECT a, b, c, row_number() OVER (PARTITION BY a, b ORDER BY c) - 1 i, count(*) OVER (PARTITION BY a, b) n FROM (SELECT a, b, z.attr c FROM (SELECT DISTINCT a, b, nab FROM apr) p JOIN ea x ON x.attr = a JOIN ea y ON y.attr = b AND y.entity = x.entity JOIN ea z ON z.entity = x.entity AND z.attr NOT IN (a, b) GROUP BY a, b, nab, z.attr HAVING count(*) < nab)),
ands AS (SELECT try, CASE WHEN {_pick(setalg.AND_NOT, "turn", "2")} = 0 THEN [apr.a, apr.b, c] ELSE [apr.b, apr.a, c] END attrs FROM apr JOIN thr ON thr.a = apr.a AND thr.b = apr.b AND thr.i = {_pick(setalg.AND_NOT, "1", "thr.n")})"""


@query(f"""WITH {NUMBERED_SQL}, t AS (SELECT unnest(range(1, {TRIES + 1})) try), {_NOT_SQL}, {_AND_NOT_SQL}, drawn AS (
SELECT '{setalg.SINGLE}' AS template, try, [attr] attrs FROM t, na JOIN num ON i = {_pick(setalg.SINGLE, "0", "na.n")}
UNION ALL SELECT '{setalg.OR2}', try, [a, b] FROM {_or_sql(setalg.OR2, "t")} UNION ALL SELECT '{setalg.OR3}', * FROM {_third_sql(setalg.OR3)}
UNION ALL SELECT '{setalg.AND2}', * FROM {_also_sql(setalg.AND2, 2)} UNION ALL SELECT '{setalg.AND3}', * FROM {_also_sql(setalg.AND3, 3)}
UNION ALL SELECT '{setalg.NOT}', * FROM nots UNION ALL SELECT '{setalg.AND_NOT}', * FROM ands) SELECT template, try, array_to_string(attrs, '|') attrs FROM drawn""")
def template_instances(spark, sf):
    """Random instances of all seven templates; in these tables no draw needs the fallback to any attributes."""
    r = drawing.Relation(entity_attributes(spark, sf))
    rows = [drawing.instances(r, template, 1, TRIES).select(F.lit(template).alias("template"), "try", F.array_join("attrs", "|").alias("attrs")) for template in setalg.ARITY]
    return reduce(DataFrame.unionAll, rows)


MOST, WITH_QUOTAS, AT_LAST = 40, 300, 150


@query(f"""WITH RECURSIVE {NUMBERED_SQL}, t AS (SELECT unnest(range(1, 16385)) try), nab AS (SELECT x.attr a, y.attr b, count(*) nab FROM ea x JOIN ea y ON x.entity = y.entity AND x.attr < y.attr GROUP BY ALL),
d AS (SELECT try, a, b, least(a, b) x, greatest(a, b) y FROM {_or_sql(setalg.OR2, "t")}),
v AS (SELECT try, a, b, x || '|' || y AS k, num_docs, CASE WHEN num_docs <= 20 THEN 1 WHEN num_docs <= 50 THEN 2 WHEN num_docs <= 100 THEN 3 WHEN num_docs <= 150 THEN 4 ELSE 5 END g FROM (SELECT d.*, p.n + q.n - coalesce(nab, 0) num_docs FROM d JOIN num p ON p.attr = d.a JOIN num q ON q.attr = d.b LEFT JOIN nab ON nab.a = d.x AND nab.b = d.y) WHERE num_docs BETWEEN 1 AND 200),
r(step, base, phase, counts, seen, try) AS (SELECT 0, 0::BIGINT, 1, [0, 0, 0, 0, 0], []::VARCHAR[], NULL::BIGINT UNION ALL
SELECT step + 1, CASE WHEN ok THEN nxt.try ELSE base + lim END, CASE WHEN ok THEN phase ELSE phase + 1 END, CASE WHEN ok THEN list_transform(counts, lambda c, i: c + (i = nxt.g)::INT) ELSE counts END, CASE WHEN ok THEN list_append(seen, nxt.k) ELSE seen END, CASE WHEN ok THEN nxt.try END
FROM (SELECT *, coalesce(nxt.try - 1 - base < lim, FALSE) ok FROM (SELECT step, base, phase, counts, seen, CASE phase WHEN 1 THEN {WITH_QUOTAS} ELSE {AT_LAST} END lim, arg_min({{'try': v.try, 'g': v.g, 'k': v.k}}, v.try) FILTER (v.try > base AND NOT list_contains(seen, v.k) AND (phase = 2 OR counts[v.g] < {MOST // 5})) nxt
FROM r, v WHERE len(seen) < {MOST} AND phase <= 2 GROUP BY step, base, phase, counts, seen)))
SELECT r.try, a || '|' || b AS attrs, num_docs FROM r JOIN v ON v.try = r.try""")
def sample_accepted_in_order(spark, sf):
    """Tries of an or-template accepted one after another: quotas first, then whatever comes, until failures in a row end it."""
    rows = drawing.rejection_sample(entity_attributes(spark, sf), setalg.OR2, MOST, 1, 200, with_quotas=WITH_QUOTAS, at_last=AT_LAST)
    return rows.select("try", F.array_join("attrs", "|").alias("attrs"), "num_docs")
