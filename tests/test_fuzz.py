"""Random queries: the DataFrame plan against the rendered SQL, run by DuckDB."""

import random

import duckdb
import pandas as pd
import pytest

from sightline.operators.query import Aggregation, Column, Count, CountUnique, Filter, Group, Join, Limit, Offset, Order, Predicate, Projection, Query, Table, Unique

WORDS = ["a", "ab", "b", "ba", "abc", "", "x%", None]


def table(rng, n):
    return [(i, rng.choice([None, *range(-3, 6)]), rng.choice(WORDS), rng.choice([None, -1.5, 0.0, 2.25, 7.0])) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    rows = {"t": table(rng, 60), "u": table(rng, 25)}
    db = duckdb.connect()
    for name, r in rows.items():
        frame = pd.DataFrame(r, columns=["id", "n", "s", "v"]).astype({"id": "int64", "n": "Int64", "s": "string", "v": "Float64"})
        db.register(f"raw_{name}", frame)
        db.sql(f"CREATE TABLE {name} AS SELECT * FROM raw_{name}")
    made = {name: spark.createDataFrame(r, "id long, n long, s string, v double").cache() for name, r in rows.items()}
    return db, made.__getitem__


def predicate(rng, depth=2):
    if depth and rng.random() < 0.5:
        return Predicate(predicate(rng, depth - 1), rng.choice(["AND", "OR"]), predicate(rng, depth - 1))
    kind = rng.randrange(6)
    if kind == 0:
        return Predicate("n", rng.choice(["=", "!=", "<", ">", "<=", ">="]), rng.randrange(-3, 6))
    if kind == 1:
        return Predicate("s", rng.choice(["=", "<>", "<", ">="]), rng.choice(WORDS[:-1]))
    if kind == 2:
        return Predicate(rng.choice(["n", "s", "v"]), rng.choice(["=", "!="]), None)
    if kind == 3:
        return Predicate("n", rng.choice(["IN", "NOT IN"]), rng.sample(range(-3, 6), rng.randrange(1, 4)))
    if kind == 4:
        return Predicate("s", rng.choice(["LIKE", "NOT LIKE"]), rng.choice(["a%", "%b%", "_b", "%", ""]))
    return Predicate("n", rng.choice(["<", "=", ">"]), Column("v"))


def query(rng):
    stages = [Table("t")]
    if rng.random() < 0.3:
        inner = Query([Table("u"), Filter([predicate(rng, 1)]), Projection(["n"])])
        some = Predicate("n", rng.choice(["IN", "NOT IN"]), inner)
        stages.append(Filter([some, predicate(rng, 0)], Filter.OR) if rng.random() < 0.5 else Filter([some]))
    stages += [Filter([predicate(rng)], rng.choice(["AND", "OR"])) for _ in range(rng.randrange(1, 3))]
    kind = rng.randrange(5)
    if kind == 0:
        stages += [Group(["s"]), Aggregation([("COUNT", "*", "c"), ("SUM", "n", "total"), ("MIN", "v", "low"), ("NUNIQUE", "n", "kinds")])]
        if rng.random() < 0.6:
            stages.append(Filter([Predicate("c", ">", rng.randrange(1, 6))]))
    elif kind == 1:
        stages += [Projection(["n", "s"]), rng.choice([Unique(), CountUnique()]) if rng.random() < 0.5 else Unique()]
        if isinstance(stages[-1], CountUnique):
            stages[-2] = Projection(["n"])
    elif kind == 2:
        stages.append(Count())
    elif kind == 3:
        stages += [Projection(["id", "n"]), Order([("id", rng.choice(["ASC", "DESC"]))]), Limit(rng.randrange(1, 20))] + ([Offset(rng.randrange(0, 10))] if rng.random() < 0.5 else [])
    else:
        stages = [Table("t"), Join("u", "n", rng.choice(["=", "<"]), "n", how=rng.choice(["INNER", "LEFT OUTER"])), Projection([Column("id", "t", "a"), Column("id", "u", "b")])]
    return Query(stages)


@pytest.mark.parametrize("seed", range(60))
def test_plan_and_text_agree(data, seed):
    db, relation = data
    q = query(random.Random(seed))
    text, values = q.render()
    want = db.execute(text, values).fetchall()
    got = [tuple(r) for r in q.to_df(relation).collect()]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    plain = lambda rows: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows]
    got, want = plain(got), plain(want)
    assert (got if q.order else sorted(got, key=key)) == (want if q.order else sorted(want, key=key)), text
