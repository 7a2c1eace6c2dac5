"""Boolean query expressions: parser, and probability as a column expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Atom:
    name: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


Node = Atom | Not | And | Or


def balanced(text: str) -> str:
    """Parentheses that miss their partner get one: at the end for open ones, at the start for closed ones."""
    depth = missing = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            missing, depth = missing + 1, 0
    return "(" * missing + text + ")" * depth


def parse(text: str, atoms: list[str]) -> Node:
    """OR binds weakest, then AND, then NOT; operators of a kind group to the left.

    Keywords are found in any case, atoms (the longest first) as they are written; other text is skipped.
    """
    text = balanced(text.strip().removesuffix("."))
    names = "|".join(re.escape(a) for a in sorted(set(atoms), key=len, reverse=True))
    pattern = (rf"(?P<atom>(?<!\w)(?:{names})(?!\w))|" if names else "") + r"(?P<word>\b(?i:and|or|not)\b)|(?P<bracket>[()])"
    tokens = [("atom", m["atom"]) if m.groupdict().get("atom") is not None else ("op", (m["word"] or m["bracket"]).upper()) for m in re.finditer(pattern, text)]
    place = 0

    def at(op: str) -> bool:
        return place < len(tokens) and tokens[place] == ("op", op)

    def one() -> Node:
        nonlocal place
        if place >= len(tokens):
            raise ValueError(f"expression ends early: {text}")
        kind, value = tokens[place]
        place += 1
        if kind == "atom":
            return Atom(value)
        if value == "NOT":
            return Not(one())
        if value == "(":
            inner = chain("OR")
            if not at(")"):
                raise ValueError(f"no closing bracket: {text}")
            place += 1
            return inner
        raise ValueError(f"unexpected {value}: {text}")

    def chain(op: str) -> Node:
        nonlocal place
        below = (lambda: chain("AND")) if op == "OR" else one
        node = below()
        while at(op):
            place += 1
            node = (Or if op == "OR" else And)(node, below())
        return node

    out = chain("OR")
    if place < len(tokens):
        raise ValueError(f"unexpected {tokens[place][1]}: {text}")
    return out


def negated_atoms(text: str, atoms: list[str]) -> str:
    """Where an atom says ``... not ...`` itself, ``NOT(its positive form)`` becomes that atom."""
    for a in atoms:
        if " not " in a:
            positive = re.escape(a.replace(" not ", " "))
            text = re.sub(rf"(?i:not)\s*\(\s*{positive}\s*\)|(?i:\bnot)\s+{positive}", lambda m, a=a: a, text)
    return text


def atoms_of(node: Node) -> list[str]:
    """Atoms in order of appearance, repeated ones repeated."""
    if isinstance(node, Atom):
        return [node.name]
    return atoms_of(node.of) if isinstance(node, Not) else atoms_of(node.left) + atoms_of(node.right)


def _given(node: Node | bool, name: str, value: bool) -> Node | bool:
    """The expression with an atom set, simplified."""
    if isinstance(node, bool):
        return node
    if isinstance(node, Atom):
        return value if node.name == name else node
    if isinstance(node, Not):
        inner = _given(node.of, name, value)
        return (not inner) if isinstance(inner, bool) else Not(inner)
    left, right = _given(node.left, name, value), _given(node.right, name, value)
    stop = isinstance(node, Or)  # the value that decides
    for x, y in ((left, right), (right, left)):
        if isinstance(x, bool):
            return stop if x == stop else y
    return type(node)(left, right)


def probability(node: Node | bool, p: dict[str, Column]) -> Column:
    """P(node) for independent atoms, an atom being one variable wherever it stands.

    Where sub-expressions share no atom the product rules hold; a repeated atom is expanded
    (Shannon): P(f) = p P(f | a) + (1 - p) P(f | not a).
    """
    if isinstance(node, bool):
        return F.lit(1.0 if node else 0.0)
    names = atoms_of(node)
    twice = next((n for n in names if names.count(n) > 1), None)
    if twice is not None:
        return p[twice] * probability(_given(node, twice, True), p) + (1 - p[twice]) * probability(_given(node, twice, False), p)
    if isinstance(node, Atom):
        return p[node.name]
    if isinstance(node, Not):
        return 1 - probability(node.of, p)
    left, right = probability(node.left, p), probability(node.right, p)
    return left * right if isinstance(node, And) else 1 - (1 - left) * (1 - right)


def score(rows: DataFrame, expression: str, columns: dict[str, str], name: str = "p") -> DataFrame:
    """``rows`` with the expression's probability; ``columns`` names each atom's probability (rounded to 6 decimals).

    Atoms that are one predicate once their names are cleaned are joined by noisy-or.
    """
    node = parse(negated_atoms(expression, list(columns)), list(columns))
    clean = lambda a: re.sub(r"[^a-z0-9]+", "_", a.lower()).strip("_")
    grouped: dict[str, list[Column]] = {}
    for atom, c in columns.items():
        grouped.setdefault(clean(atom), []).append(F.round(F.col(c), 6))
    p = {}
    for atom in columns:
        off = F.lit(1.0)
        for c in grouped[clean(atom)]:
            off = off * (1 - c)
        p[atom] = grouped[clean(atom)][0] if len(grouped[clean(atom)]) == 1 else 1 - off

    def named(n: Node) -> Node:
        return Atom(clean(n.name)) if isinstance(n, Atom) else Not(named(n.of)) if isinstance(n, Not) else type(n)(named(n.left), named(n.right))

    return rows.withColumn(name, probability(named(node), {clean(a): c for a, c in p.items()}))


def score_long(facts: DataFrame, queries: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(qid, docid, p) from long facts (qid, docid, atom, p) for parsed queries (qid, expression, atoms); a fact that is missing has p = 0.

    Queries of one shape (that differ in their atoms alone) are one expression, so the plan grows with the shapes and not
    with the queries: one join that gives each fact its place, and two aggregates.
    """
    if not queries:
        raise ValueError("no queries")
    shapes: dict[Node, int] = {}
    places = []
    for qid, expression, atoms in queries:
        clean = {a: re.sub(r"[^a-z0-9]+", "_", a.lower()).strip("_") for a in atoms}
        order = {name: i for i, name in enumerate(dict.fromkeys(clean.values()))}

        def placed(n: Node, clean=clean, order=order) -> Node:
            return Atom(str(order[clean[n.name]])) if isinstance(n, Atom) else Not(placed(n.of)) if isinstance(n, Not) else type(n)(placed(n.left), placed(n.right))

        shape = shapes.setdefault(placed(parse(negated_atoms(expression, list(atoms)), list(atoms))), len(shapes))
        places += [(qid, a, order[clean[a]], shape) for a in atoms]
    table = facts.sparkSession.createDataFrame(places, "qid string, atom string, place int, shape int")
    table = table.withColumn("qid", F.col("qid").cast(facts.schema["qid"].dataType))
    shape_of = table.select("qid", "shape").distinct()
    most = max(place for _, _, place, _ in places) + 1
    # every atom of a document once; atoms that are one predicate meet in one place by noisy-or
    once = facts.join(table.drop("shape"), ["qid", "atom"], "left").groupBy("qid", "docid", "atom", "place").agg(F.round(F.max("p"), 6).alias("p"))
    at = lambda i: F.col("place") == i
    joint = lambda i: F.when(F.count_if(at(i)) > 1, 1 - F.product(F.when(at(i), 1 - F.col("p")))).otherwise(F.max(F.when(at(i), F.col("p"))))
    wide = once.groupBy("qid", "docid").agg(*(F.coalesce(joint(i), F.lit(0.0)).alias(f"_{i}") for i in range(most))).join(shape_of, "qid")
    p = F.lit(None).cast("double")
    for node, shape in shapes.items():
        p = F.when(F.col("shape") == shape, probability(node, {str(i): F.col(f"_{i}") for i in range(most)})).otherwise(p)
    return wide.select("qid", "docid", p.alias("p"))


def true_probability(true_logit: Column, false_logit: Column) -> Column:
    """Softmax over the two answers."""
    return 1 / (1 + F.exp(false_logit - true_logit))


def likelihood(loss: Column) -> Column:
    return F.exp(-loss)
