import pytest

from rankloom.operators import drawing, setalg
from rankloom.operators.sampling import BUCKETS


def relation(spark, own):
    return spark.createDataFrame([(e, a) for e, attrs in own.items() for a in attrs], "entity long, attr string")


OWN = {1: "abc", 2: "abd", 3: "abcd", 4: "ef", 5: "ef", 6: "a", 7: "cdgh", 8: "bgh", 9: "z"}


def drawn(spark, own, template, n=150):
    r = drawing.Relation(relation(spark, own))
    return r, [row["attrs"] for row in drawing.instances(r, template, 1, n).orderBy("try").collect()]


def sets(own):
    of = {}
    for e, attrs in own.items():
        for a in attrs:
            of.setdefault(a, set()).add(e)
    return of


@pytest.mark.parametrize("template", list(setalg.ARITY))
def test_every_try_has_distinct_attributes_and_repeats(spark, template):
    r, got = drawn(spark, OWN, template)
    assert len(got) == 150 and all(len(set(a)) == setalg.ARITY[template] == len(a) for a in got)
    assert [row["attrs"] for row in drawing.instances(r, template, 1, 150).orderBy("try").collect()] == got
    assert [row["attrs"] for row in drawing.instances(r, template, 101, 150).orderBy("try").collect()] == got[100:]
    assert len({tuple(a) for a in got}) > 5


def test_or_templates_take_attributes_of_different_sets(spark):
    of = sets(OWN)
    assert of["e"] == of["f"] and of["g"] == of["h"]
    for template in (setalg.OR2, setalg.OR3):
        _, got = drawn(spark, OWN, template, 400)
        assert all(of[b] != of[a] for a, b in [(x[0], y) for x in got for y in x[1:]])
        assert all(of[x[2]] != of[x[1]] for x in got if len(x) == 3)
        assert {a for x in got for a in x} == set(of)  # all attributes are reached
    _, same = drawn(spark, {1: "ab", 2: "ab"}, setalg.OR2, 20)
    assert {tuple(sorted(x)) for x in same} == {("a", "b")}  # no others are there


def test_and_templates_take_attributes_of_one_entity(spark):
    for template in (setalg.AND2, setalg.AND3):
        _, got = drawn(spark, OWN, template, 300)
        assert all(any(set(x) <= set(attrs) for attrs in OWN.values()) for x in got)


def test_not_templates_have_witnesses_on_both_sides(spark):
    of = sets(OWN)
    _, got = drawn(spark, OWN, setalg.NOT, 300)
    assert all(of[a] & of[b] and of[a] - of[b] for a, b in got)
    _, got = drawn(spark, OWN, setalg.AND_NOT, 300)
    assert all((of[a] & of[b]) & of[c] and (of[a] & of[b]) - of[c] for a, b, c in got)
    assert any(a > b for a, b, _ in got) and any(a < b for a, b, _ in got)


def test_templates_without_witnesses_fall_back_to_any_attributes(spark):
    own = {1: "a", 2: "b", 3: "c", 4: "d"}
    for template in (setalg.NOT, setalg.AND_NOT):
        _, got = drawn(spark, own, template, 60)
        assert len(got) == 60 and all(len(set(x)) == setalg.ARITY[template] for x in got) and {a for x in got for a in x} == set("abcd")
    _, got = drawn(spark, own, setalg.AND2, 10)
    assert got == []  # no entity has two
    for few in ({1: "a"}, {}):
        assert drawn(spark, few, setalg.OR2, 5)[1] == []


def by_loop(tries, most, with_quotas, at_last):
    """The acceptance as one loop over every try; ``tries`` gives (attrs, num_docs, bucket), or None for one out of range."""
    seen, counts, phase, failures, out = set(), [0] * len(BUCKETS), 1, 0, []
    for n, x in enumerate(tries, 1):
        if len(seen) >= most:
            break
        if phase == 1 and failures >= with_quotas:
            phase, failures = 2, 0
        if phase == 2 and failures >= at_last:
            break
        key = tuple(sorted(x[0])) if x else None
        if x is None or key in seen or phase == 1 and counts[x[2]] >= max(1, most // len(BUCKETS)):
            failures += 1
            continue
        seen.add(key)
        counts[x[2]] += 1
        failures = 0
        out.append(n)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_acceptance_equals_a_loop_over_tries(seed):
    import random

    rng = random.Random(seed)
    share, names, most = rng.choice([0.02, 0.3, 0.9]), rng.choice([4, 12]), rng.choice([1, 7, 30])
    limits = rng.choice([(30, 10), (5, 5), (1, 1), (200, 3)])
    tries = [None if rng.random() > share else ([f"a{rng.randrange(names)}", f"b{rng.randrange(names)}"], 1, rng.choice([0, 0, 0, 1, 4])) for _ in range(3000)]
    state = drawing.Acceptance(most, *limits)
    for first in range(1, 3001, 250):
        if not state.done:
            state.scan([(n, *tries[n - 1]) for n in range(first, first + 250) if tries[n - 1]], first, first + 249)
    assert [n for n, *_ in state.taken.values()] == by_loop(tries, most, *limits)


def test_sample_is_the_same_in_rounds_of_any_length(spark):
    ea = relation(spark, OWN)
    runs = [[tuple(r) for r in drawing.rejection_sample(ea, setalg.NOT, 12, 1, 3, with_quotas=60, at_last=30, round_=n).orderBy("try").collect()] for n in (50, 1000)]
    assert runs[0] == runs[1] and 0 < len(runs[0]) <= 12
    of = sets(OWN)
    assert all(len(of[a] - of[b]) == n and 1 <= n <= 3 for _, _, (a, b), n in runs[0])
    assert drawing.rejection_sample(ea.limit(0), setalg.NOT, 12, 1, 3).collect() == []
