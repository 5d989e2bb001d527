import pytest

from sightline.errors import InvalidAggregateFunction, InvalidAttr, InvalidComparisonOperator, InvalidJoinOperator, InvalidPredicateOperand, InvalidPredicateOperator, InvalidQuery, InvalidStixPath, InvalidViewname
from sightline.operators.query import Aggregation, BinnedColumn, CoalescedColumn, Column, Count, CountUnique, Filter, Group, Join, Limit, Offset, Order, Predicate, Projection, Query, Table, Unique


@pytest.fixture(scope="module")
def rel(spark):
    a = spark.createDataFrame([(1, "x", 5.0, None), (2, "y", -7.0, "q"), (3, None, 2.5, "%"), (4, "x", 0.0, "a\nb")], "id int, k string, v double, `ref.value` string")
    b = spark.createDataFrame([("x", 10, 1), ("y", 20, 2), ("z", 30, None)], "k string, w int, id int")
    t = spark.createDataFrame([("2020-06-30T19:25:06.002Z", 7), ("2020-06-30T19:29:59Z", -7), ("2020-06-30T19:30:00Z", 13)], "first_observed string, n int")
    return {"a": a, "b": b, "t": t}.__getitem__


def run(rel, *stages):
    return [tuple(r) for r in Query(list(stages)).to_df(rel).collect()]


def test_predicates(rel):
    ids = lambda *p: [r[0] for r in run(rel, Table("a"), Filter([Predicate(*p)]), Projection(["id"]), Order(["id"]))]
    assert ids("k", "=", "x") == [1, 4] and ids("k", "!=", "x") == [2] and ids("k", "=", None) == [3] and ids("k", "<>", "NULL") == [1, 2, 4]
    assert ids("v", "<", 0) == [2] and ids("v", ">=", "2.5") == [1, 3] and ids("v", "=", "abc") == []
    assert ids("k", "IN", ["x", "q"]) == [1, 4] and ids("k", "NOT IN", ["x"]) == [2] and ids("id", "IN", (2, "3")) == [2, 3]
    assert ids("ref.value", "LIKE", "a%") == [4] and ids("ref.value", "NOT LIKE", "a%") == [2, 3] and ids("ref.value", "MATCHES", "a.b") == [4]
    assert ids("k", "=", Column("ref.value")) == [] and ids("id", "<", Column("v")) == [1]
    assert ids("k[*]", "=", "x") == [1, 4]
    both = Predicate(Predicate("k", "=", "x"), "AND", Predicate("v", ">", 1))
    assert [r[0] for r in run(rel, "a", Predicate(both, "OR", Predicate("id", "=", 3)), Projection(["id"]), Order(["id"]))] == [1, 3]


def test_subqueries(rel):
    inner = Query([Table("b"), Filter([Predicate("w", ">", 10)]), Projection(["k"])])
    ids = lambda f: [r[0] for r in run(rel, Table("a"), f, Projection(["id"]), Order(["id"]))]
    assert ids(Filter([Predicate("k", "IN", inner)])) == [2]
    assert ids(Filter([Predicate("k", "NOT IN", inner)])) == [1, 4]
    assert ids(Filter([Predicate("k", "IN", inner), Predicate("id", "=", 3)], Filter.OR)) == [2, 3]
    assert ids(Filter([Predicate("k", "NOT IN", inner), Predicate("id", "=", 3)], Filter.OR)) == [1, 3, 4]
    with_null = Query([Table("b"), Projection(["id"])])
    assert ids(Filter([Predicate("id", "NOT IN", with_null)])) == []


def test_joins(rel):
    assert run(rel, Table("a"), Join("b", "k", "=", "k"), Projection([Column("id", "a"), "w"]), Order([Column("id", "a")])) == [(1, 10), (2, 20), (4, 10)]
    assert len(run(rel, Table("a"), Join("b", "k", "=", "k", how="LEFT OUTER"))) == 4
    assert len(run(rel, Table("a"), Join("b", "k", "=", "k", how="OUTER"))) == 5
    assert len(run(rel, Table("a"), Join("b", how="CROSS"))) == 12
    assert run(rel, Table("a"), Join("b", "id", "<", "id", preds=[Predicate("w", "<", 30)]), Projection([Column("id", "a", "l"), Column("id", "b", "r")])) == [(1, 2)]
    both = Query([Table("a"), Join("b", "k", "=", "k", alias="c"), Projection([CoalescedColumn(["c.id", "a.id"], "i")])]).to_df(rel)
    assert sorted(r.i for r in both.collect()) == [1, 1, 2]
    assert Query([Table("a"), Join("b", "k", "=", "k")]).to_df(rel).columns == ["id", "k", "v", "ref.value", "w"]


def test_groups(rel):
    stages = [Table("a"), Group(["k"]), Aggregation([("COUNT", "*", "n"), ("sum", "v"), ("NUNIQUE", "ref.value", "u")])]
    assert sorted(run(rel, *stages), key=str) == sorted([("x", 2, 5.0, 1), ("y", 1, -7.0, 1), (None, 1, 2.5, 1)], key=str)
    assert run(rel, *stages, Filter([Predicate("n", ">", 1)])) == [("x", 2, 5.0, 1)]
    assert run(rel, Table("a"), Aggregation([("COUNT", None), ("MAX", "v", "m")])) == [(4, 5.0)]
    bins = [Table("t"), Projection([BinnedColumn("first_observed", 5, "m")]), Group([BinnedColumn("first_observed", 5, "m")]), Aggregation([("COUNT", "*", "n")]), Order(["first_observed"])]
    assert run(rel, *bins) == [("2020-06-30T19:25:00Z", 2), ("2020-06-30T19:30:00Z", 1)]
    assert run(rel, Table("t"), Projection([BinnedColumn("n", 5, alias="bin")])) == [(5,), (-5,), (10,)]


def test_rest(rel):
    assert run(rel, Table("a"), Order([("id", Order.DESC)]), Limit(2), Offset(1), Projection(["id"])) == [(3,), (2,)]
    assert len(run(rel, Table("a"), Offset(3))) == 4
    assert run(rel, Table("a"), Order(["k", ("id", "DESC")]), Projection(["id"]))[0] == (3,)
    assert len(run(rel, Table("a"), Projection(["k"]), Unique())) == 3
    assert run(rel, Table("a"), Projection(["k"]), CountUnique()) == [(2,)] and run(rel, Table("a"), Count()) == [(4,)]
    assert run(rel, Query([Table("a"), Projection(["id"])]), Filter([Predicate("id", ">", 3)])) == [(4,)]


def test_errors(rel):
    for error, make in [
        (InvalidComparisonOperator, lambda: Predicate("a", "~", 1)),
        (InvalidComparisonOperator, lambda: Predicate("a", "<", None)),
        (InvalidPredicateOperand, lambda: Predicate("a", "AND", 1)),
        (InvalidPredicateOperator, lambda: Predicate(Predicate("a", "=", 1), "XOR", Predicate("a", "=", 1))),
        (InvalidPredicateOperator, lambda: Filter([], "NOT")),
        (InvalidStixPath, lambda: Predicate("a; DROP TABLE b", "=", 1)),
        (InvalidStixPath, lambda: Projection(['x" FROM y'])),
        (InvalidViewname, lambda: Table("a b")),
        (InvalidJoinOperator, lambda: Join("b", "k", "=", "k", how="SIDE")),
        (InvalidAggregateFunction, lambda: Aggregation([("MEDIAN", "v", "m")])),
        (InvalidQuery, lambda: Query([Join("b", "k", "=", "k")])),
        (InvalidQuery, lambda: Query([]).to_df(rel)),
        (InvalidQuery, lambda: Query([3])),
        (ValueError, lambda: Limit("ten")),
        (InvalidAttr, lambda: run(rel, Table("a"), Projection(["nothing"]))),
        (InvalidAttr, lambda: run(rel, Table("a"), Filter([Predicate("nothing", "=", 1)]))),
    ]:
        with pytest.raises(error):
            make()


def test_render():
    q = Query([Table("a"), Join("b", "k", "=", "id", how="LEFT OUTER", alias="c"), Filter([Predicate("v", ">", 1), Predicate("k", "IN", ["x", "y"])], Filter.OR), Group(["k"]), Aggregation([("COUNT", "*", "n"), ("NUNIQUE", "v", "u")]), Filter([Predicate("n", ">", 2)]), Order([("n", "DESC")]), Limit(3), Offset(1)])
    text, values = q.render("%s")
    assert text == 'SELECT "k", COUNT(*) AS "n", COUNT(DISTINCT "v") AS "u" FROM "a" LEFT OUTER JOIN "b" AS "c" ON "a"."k" = "c"."id" WHERE (("v" > %s) OR ("k" IN (%s, %s))) GROUP BY "k" HAVING ("n" > %s) ORDER BY "n" DESC LIMIT 3 OFFSET 1'
    assert values == [1, "x", "y", 2]
    assert Query([Table("a"), Projection(["k"]), Unique()]).render()[0] == 'SELECT DISTINCT "k" FROM "a"'
    inner = Query([Table("b"), Filter([Predicate("w", "=", 3)]), Projection(["k"])])
    assert Query([Table("a"), Filter([Predicate("k", "NOT IN", inner), Predicate("x", "=", None)])]).render() == ('SELECT * FROM "a" WHERE (("k" NOT IN (SELECT "k" FROM "b" WHERE ("w" = ?))) AND ("x" IS NULL))', [3])
