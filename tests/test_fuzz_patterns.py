"""Random patterns against an evaluation in plain Python."""

import random
import re

import pytest

from sightline.operators.pattern import Both, Compiler, parse

NAMES = ["a", "ab", "b", "ba", "c"]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    rows = {
        "directory": [{"id": f"directory--{i}", "path": rng.choice([*NAMES, None])} for i in range(4)],
        "file": [{"id": f"file--{i}", "name": rng.choice([*NAMES, None]), "parent_directory_ref": rng.choice([None, *(f"directory--{k}" for k in range(5))])} for i in range(8)],
        "process": [{"id": f"process--{i}", "name": rng.choice([*NAMES, None]), "pid": rng.choice([None, *range(5)]), "binary_ref": rng.choice([None, *(f"file--{k}" for k in range(9))])} for i in range(40)],
    }
    types = {"directory": "id string, path string", "file": "id string, name string, parent_directory_ref string", "process": "id string, name string, pid long, binary_ref string"}
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rs], types[t]).cache() for t, rs in rows.items()}
    return rows, frames


def comparison(rng):
    path = rng.choice(["process:name", "process:pid", "process:binary_ref.name", "process:binary_ref.parent_directory_ref.path", "file:name"])
    if path.endswith("pid"):
        return f"{path} {rng.choice(['=', '!=', '<', '>='])} {rng.randrange(5)}"
    return path + " " + rng.choice([f"= '{rng.choice(NAMES)}'", f"!= '{rng.choice(NAMES)}'", f"IN ('a', '{rng.choice(NAMES)}')", f"NOT IN ('b', '{rng.choice(NAMES)}')", "LIKE 'a%'", "NOT LIKE '%b'", "MATCHES 'b$'", "NOT MATCHES '^a'"])


def inside(rng, depth):
    if not depth or rng.random() < 0.4:
        return comparison(rng)
    text = f"{inside(rng, depth - 1)} {rng.choice(['AND', 'OR'])} {inside(rng, depth - 1)}"
    return f"({text})" if rng.random() < 0.5 else text


def pattern(rng, depth=2):
    if not depth or rng.random() < 0.5:
        return f"[{inside(rng, 2)}]"
    text = f"{pattern(rng, depth - 1)} {rng.choice(['AND', 'OR'])} {pattern(rng, depth - 1)}"
    return f"({text})" if rng.random() < 0.5 else text


def holds(c, value):
    """Three-valued: None for unknown."""
    if c.op == "MATCHES":
        found = value is not None and bool(re.search(c.value, value))
    elif value is None:
        return None
    elif c.op == "LIKE":
        found = bool(re.fullmatch(c.value.replace("%", ".*"), value))
    elif c.op == "IN":
        found = value in c.value
    else:
        found = {"=": value == c.value, "!=": value != c.value, "<": value < c.value if isinstance(value, int) else False, ">=": value >= c.value if isinstance(value, int) else False}[c.op]
    return found != c.negated


def truth(tree, row, rows):
    """True, False, None (unknown) or "nothing" for what another type's comparison leaves."""
    if isinstance(tree, Both):
        a, b = truth(tree.left, row, rows), truth(tree.right, row, rows)
        if "nothing" in (a, b):
            return b if a == "nothing" else a
        if tree.op == "AND":
            return False if a is False or b is False else None if a is None or b is None else True
        return True if a is True or b is True else None if a is None or b is None else False
    if tree.sco_type != "process":
        return "nothing"
    *refs, last = tree.prop.split(".")
    here = row
    for ref in refs:
        here = next((r for t in rows.values() for r in t if r["id"] == here[ref]), None)
        if here is None:
            return False
    found = holds(tree, here[last])
    return found if not refs else found is True


@pytest.mark.parametrize("seed", range(30))
def test_patterns(world, seed):
    rows, frames = world
    text = pattern(random.Random(seed))
    tree = parse(text)
    want = {r["id"] for r in rows["process"] if truth(tree, r, rows) in (True, "nothing")}
    got = [r["id"] for r in Compiler(frames.get).apply(frames["process"], "process", text).collect()]
    assert len(got) == len(set(got)) and set(got) == want, text
