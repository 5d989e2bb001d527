"""The queries that apply the engine's operators to the driver's tables, each beside its SQL.

Where an operator is about observations, orders stand for observations (one each, at their date), line items for what they contain, and parts for the objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.ids import NAMESPACE
from ..knowledge import auto_agg
from ..operators.paths import dereference
from ..operators.pattern import Compiler
from ..operators.query import (
    Aggregation,
    BinnedColumn,
    CoalescedColumn,
    Column,
    Count,
    CountUnique,
    Filter,
    Group,
    Join,
    Limit,
    Offset,
    Order,
    Predicate,
    Projection,
    Query,
    Table,
    Unique,
)
from ..plans import bundle_tools, session_catalog, upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TIME = "%Y-%m-%dT%H:%M:%SZ"


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo(sql: str):
    """Registers a query, given the tables, under its name, with its SQL."""

    def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame | Query]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = tables(spark, sf_dir)
            out = f(t)
            return out.to_df(t) if isinstance(out, Query) else out

        QUERIES[f.__name__] = run
        SQL[f.__name__] = sql
        return f

    return keep


@demo(f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '{TIME}') AS ts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def bin_time_events(t):
    return Query([Table("events"), Projection([BinnedColumn("ts", 1, "h"), "event_type"]), Group(["ts", "event_type"]), Aggregation([("COUNT", "*", "n")])])


@demo(f"SELECT strftime(time_bucket(INTERVAL '15 minutes', ts), '{TIME}') AS bin, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def bin_time_minutes(t):
    return Query([Table("events"), Projection([BinnedColumn("ts", 15, "m", alias="bin")]), Group([BinnedColumn("ts", 15, "m", alias="bin")]), Aggregation([("COUNT", "*", "n"), ("NUNIQUE", "user_id", "users")])])


@demo("SELECT CAST(p_size // 10 * 10 AS BIGINT) AS size_bin, count(*) AS n FROM part GROUP BY 1")
def bin_int_parts(t):
    return Query([Table("part"), Projection([BinnedColumn("p_size", 10, alias="size_bin")]), Group([BinnedColumn("p_size", 10, alias="size_bin")]), Aggregation([("COUNT", "*", "n")])])


@demo("SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) OR c_nationkey = 3")
def filter_and_or(t):
    both = Predicate(Predicate("c_mktsegment", "=", "BUILDING"), "AND", Predicate("c_acctbal", ">", 5000))
    return Query([Table("customer"), Filter([Predicate(both, "OR", Predicate("c_nationkey", "=", 3))]), Projection(["c_custkey", "c_name"])])


@demo("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup') AND NOT (user_id IN (1, 2, 3))")
def filter_in_list(t):
    return Query([Table("events"), Filter([Predicate("event_type", "IN", ["purchase", "signup"])]), Filter([Predicate("user_id", "NOT IN", [1, 2, 3])]), Projection(["event_id", "event_type"])])


@demo("SELECT event_id FROM events WHERE value IS NOT NULL AND props IS NOT NULL")
def filter_null(t):
    return Query([Table("events"), Filter([Predicate("value", "!=", None), Predicate("props", "<>", "null")]), Projection(["event_id"])])


@demo("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")
def col_vs_col(t):
    return Query([Table("lineitem"), Filter([Predicate("l_partkey", "<", Column("l_suppkey"))]), Projection(["l_orderkey", "l_linenumber"])])


@demo("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(t):
    inner = Query([Table("customer"), Filter([Predicate("c_mktsegment", "=", "BUILDING")]), Projection(["c_custkey"])])
    return Query([Table("orders"), Filter([Predicate("o_custkey", "IN", inner)]), Projection(["o_orderkey", "o_totalprice"])])


@demo("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def not_in_subquery(t):
    inner = Query([Table("orders"), Filter([Predicate("o_totalprice", ">", 400000)]), Projection(["o_custkey"])])
    return Query([Table("customer"), Filter([Predicate("c_custkey", "NOT IN", inner)]), Projection(["c_custkey"])])


@demo("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) OR o_orderstatus = 'F'")
def in_subquery_under_or(t):
    inner = Query([Table("customer"), Filter([Predicate("c_acctbal", ">", 8000)]), Projection(["c_custkey"])])
    return Query([Table("orders"), Filter([Predicate("o_custkey", "IN", inner), Predicate("o_orderstatus", "=", "F")], Filter.OR), Projection(["o_orderkey"])])


@demo("""SELECT event_id FROM events WHERE props LIKE '%"k": 7%'""")
def list_contains_text(t):
    return Query([Table("events"), Filter([Predicate("props[*]", "=", '"k": 7')]), Projection(["event_id"])])


@demo("SELECT page_id, url FROM pages WHERE url LIKE '%1%/%'")
def like_url(t):
    return Query([Table("pages"), Filter([Predicate("url", "LIKE", "%1%/%")]), Projection(["page_id", "url"])])


@demo("SELECT page_id FROM pages WHERE url NOT LIKE '%1%'")
def not_like_url(t):
    return Query([Table("pages"), Filter([Predicate("url", "NOT LIKE", "%1%")]), Projection(["page_id"])])


@demo("SELECT page_id FROM pages WHERE regexp_matches(url, '[02468]/?$', 's')")
def matches_url(t):
    return Query([Table("pages"), Filter([Predicate("url", "MATCHES", "[02468]/?$")]), Projection(["page_id"])])


def _payload(t):
    return t("documents").select("doc_id", F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "").alias("payload_bin"))


@demo("SELECT doc_id FROM documents WHERE text LIKE '%License%'")
def payload_like(t):
    return Query([Table("p"), Filter([Predicate("payload_bin", "LIKE", "%License%")]), Projection(["doc_id"])]).to_df(lambda _: _payload(t))


@demo("SELECT doc_id FROM documents WHERE regexp_matches(text, 'the.{1,20}of the', 's')")
def payload_match(t):
    return Query([Table("p"), Filter([Predicate("payload_bin", "MATCHES", "the.{1,20}of the")]), Projection(["doc_id"])]).to_df(lambda _: _payload(t))


def _addresses(t):
    n = F.col("user_id")
    return t("events").select("event_id", F.concat(F.lit("10."), F.pmod(F.floor(n / 65536), F.lit(256)), F.lit("."), F.pmod(F.floor(n / 256), F.lit(256)), F.lit("."), F.pmod(n, F.lit(256))).alias("value"))


@demo("SELECT event_id FROM events WHERE user_id % 16777216 BETWEEN 64 AND 127")
def in_subnet(t):
    return _addresses(t).where(scalars.in_subnet(F.col("value"), "10.0.0.64/26")).select("event_id")


@demo("SELECT event_id FROM events WHERE user_id % 16777216 BETWEEN 0 AND 127 OR user_id % 16777216 = 300")
def pattern_subset_or_equal(t):
    rows = _addresses(t).withColumn("id", F.col("event_id").cast("string"))
    return Compiler(lambda _: None).apply(rows, "ipv4-addr", "[ipv4-addr:value ISSUBSET '10.0.0.0/25' OR ipv4-addr:value = '10.0.1.44' OR url:value = 'x']").select("event_id")


@demo("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
def join_inner(t):
    return Query([Table("customer"), Join("orders", "c_custkey", "=", "o_custkey"), Filter([Predicate("o_totalprice", ">", 200000)]), Projection(["c_custkey", "c_name", "o_orderkey"])])


@demo("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left(t):
    return Query([Table("customer"), Join("orders", "c_custkey", "=", "o_custkey", how="LEFT OUTER"), Group(["c_custkey"]), Aggregation([("COUNT", "o_orderkey", "n")])])


@demo("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def join_full(t):
    return Query([Table("supplier"), Join("customer", "s_suppkey", "=", "c_custkey", how="OUTER"), Projection(["s_suppkey", "c_custkey"])])


@demo("SELECT a.r_regionkey AS low, b.r_regionkey AS high FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def join_theta(t):
    return Query([Table("region"), Join("region", "r_regionkey", "<", "r_regionkey", alias="other"), Projection([Column("r_regionkey", "region", "low"), Column("r_regionkey", "other", "high")])])


@demo("SELECT n_name, r_name FROM nation CROSS JOIN region WHERE r_name <> 'ASIA'")
def join_cross(t):
    return Query([Table("nation"), Join("region", how="CROSS"), Filter([Predicate("r_name", "!=", "ASIA")]), Projection(["n_name", "r_name"])])


@demo("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size > 40 AND l_quantity > 45")
def join_predicates(t):
    preds = [Predicate(Column("p_size", "part"), ">", 40), Predicate(Column("l_quantity", "lineitem"), ">", 45)]
    return Query([Table("lineitem"), Join("part", "l_partkey", "=", "p_partkey", preds=preds), Projection(["l_orderkey", "l_linenumber", "p_name"])])


@demo("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_three_way(t):
    return Query([Table("customer"), Join("nation", "c_nationkey", "=", "n_nationkey"), Join("region", "n_regionkey", "=", "r_regionkey"), Projection(["c_custkey", "n_name", "r_name"])])


@demo("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) s1 WHERE n > 10")
def subquery_from(t):
    return Query([Query([Table("events"), Group(["event_type"]), Aggregation([("COUNT", "*", "n")])]), Filter([Predicate("n", ">", 10)])])


@demo("SELECT o_custkey, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 1000")
def group_having(t):
    return Query([Table("orders"), Group(["o_custkey"]), Aggregation([("COUNT", "*", "n"), ("MIN", "o_totalprice", "low"), ("MAX", "o_totalprice", "high")]), Filter([Predicate("n", ">", 12), Predicate("high", ">", 1000)])])


@demo("SELECT count(*) AS count, CAST(sum(p_size) AS BIGINT) AS sum, min(p_size) AS min, max(p_size) AS max, avg(p_size) AS avg, count(DISTINCT p_brand) AS brands FROM part")
def agg_global(t):
    return Query([Table("part"), Aggregation([("COUNT", "*"), ("SUM", "p_size"), ("MIN", "p_size"), ("MAX", "p_size"), ("avg", "p_size"), ("NUNIQUE", "p_brand", "brands")])])


@demo("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def nunique(t):
    return Query([Table("events"), Group(["user_id"]), Aggregation([("NUNIQUE", "event_type", "kinds")])])


@demo("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(t):
    return Query([Table("part"), Projection(["p_brand", "p_type"]), Unique()])


@demo("SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R'")
def count_rows(t):
    return Query([Table("lineitem"), Filter([Predicate("l_returnflag", "=", "R")]), Count()])


@demo("SELECT count(*) AS count FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL)")
def count_unique(t):
    return Query([Table("lineitem"), Projection(["l_orderkey", "l_partkey"]), CountUnique()])


@demo("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def order_limit_offset(t):
    return Query([Table("orders"), Projection(["o_orderkey", "o_totalprice"]), Order([("o_totalprice", "DESC"), "o_orderkey"]), Limit(25), Offset(10)])


@demo("SELECT coalesce(c_name, s_name) AS name, n_nationkey FROM nation LEFT JOIN customer ON n_nationkey = c_custkey LEFT JOIN supplier ON n_nationkey = s_suppkey")
def mixed_coalesce(t):
    return Query([Table("nation"), Join("customer", "n_nationkey", "=", "c_custkey", how="LEFT OUTER"), Join("supplier", "n_nationkey", "=", "s_suppkey", how="LEFT OUTER", lhs="nation"), Projection([CoalescedColumn(["customer.c_name", "supplier.s_name"], "name"), "n_nationkey"])])


@demo("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 5")
def merge_union(t):
    part = lambda *p: Query([Table("customer"), Filter([Predicate(*p)]), Projection(["c_custkey", "c_mktsegment"])]).to_df(t)
    return part("c_acctbal", "<", 0).unionByName(part("c_nationkey", "=", 5)).distinct()


def _objects(t) -> Callable[[str], DataFrame | None]:
    """Customers as processes that refer to files (nations) in directories (regions)."""
    known = {
        "process": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("binary_ref")),
        "file": t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_directory_ref")),
        "directory": t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("path")),
    }
    return known.get


@demo("""SELECT c_custkey AS id, c_name AS name, n_nationkey AS "binary_ref.id", n_name AS "binary_ref.name", r_regionkey AS "binary_ref.parent_directory_ref.id", r_name AS "binary_ref.parent_directory_ref.path"
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def auto_deref(t):
    known = _objects(t)
    return dereference(known("process"), "process", known)


@demo("""SELECT c_custkey AS id, r_name AS "binary_ref.parent_directory_ref.path" FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def path_join(t):
    known = _objects(t)
    return dereference(known("process"), "process", known, ["id", "binary_ref.parent_directory_ref.path"])


@demo("SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR c_name LIKE '%7'")
def pattern_over_references(t):
    known = _objects(t)
    return Compiler(known).apply(known("process"), "process", "[process:binary_ref.parent_directory_ref.path = 'ASIA' OR process:name LIKE '%7']").select("id")


@demo("SELECT o_orderstatus, count(DISTINCT o_custkey) AS unique_o_custkey, count(DISTINCT o_orderpriority) AS unique_o_orderpriority, CAST(sum(o_orderkey % 7) AS BIGINT) AS number_observed FROM orders GROUP BY 1")
def auto_agg_group(t):
    rows = t("orders").select("o_orderstatus", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderpriority", (F.col("o_orderkey") % 7).alias("number_observed"))
    aggs = [auto_agg("x-order", c, d) for c, d in rows.dtypes if c != "o_orderstatus"]
    return Query([Table("o"), Group(["o_orderstatus"]), Aggregation(aggs)]).to_df(lambda _: rows)


def _observed(t) -> Callable[[str], DataFrame]:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    known = {
        "observed-data": t("orders").select(F.col("o_orderkey").alias("id"), day.alias("first_observed"), day.alias("last_observed"), F.lit(1).cast("long").alias("number_observed")),
        "__contains": t("lineitem").select(F.col("l_orderkey").alias("source_ref"), F.col("l_partkey").alias("target_ref")).distinct(),
        "part": t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")),
    }
    return known.__getitem__


_OBSERVED = "part JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) c ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey"
_SEEN = [Table("part"), Join("__contains", "id", "=", "target_ref"), Join("observed-data", "source_ref", "=", "id")]


@demo(f"SELECT p_brand AS brand, count(*) AS count FROM {_OBSERVED} GROUP BY 1")
def value_counts(t):
    return Query([*_SEEN, Group([Column("brand", "part")]), Aggregation([("COUNT", "*", "count")])]).to_df(_observed(t))


@demo(f"SELECT CAST(sum(1) AS BIGINT) AS count FROM {_OBSERVED} WHERE p_brand = 'Brand#1' OR p_brand LIKE 'Brand#2%'")
def number_observed(t):
    some = Predicate(Predicate("brand", "=", "Brand#1"), "OR", Predicate("brand", "LIKE", "Brand#2%"))
    return Query([*_SEEN, Filter([some]), Aggregation([("SUM", "number_observed", "count")])]).to_df(_observed(t))


@demo(f"SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_observed, strftime(max(o_orderdate), '%Y-%m-%d') AS last_observed, CAST(sum(1) AS BIGINT) AS number_observed FROM {_OBSERVED} WHERE p_brand LIKE 'Brand#1%'")
def summary(t):
    aggs = [("MIN", "first_observed", "first_observed"), ("MAX", "last_observed", "last_observed"), ("SUM", "number_observed", "number_observed")]
    return Query([*_SEEN, Filter([Predicate("brand", "LIKE", "Brand#1%")]), Aggregation(aggs)]).to_df(_observed(t))


@demo(f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS first_observed, p_brand AS brand, p_partkey AS id FROM {_OBSERVED} WHERE p_brand LIKE 'Brand#3%'")
def timestamped(t):
    return Query([*_SEEN, Filter([Predicate("brand", "LIKE", "Brand#3%")]), Projection([Column("first_observed", "observed-data"), Column("brand", "part"), Column("id", "part")]), Order([Column("first_observed", "observed-data")])]).to_df(_observed(t))


@demo(f"SELECT o_orderkey AS observation_id, CAST(1 AS BIGINT) AS number_observed, p_type AS kind FROM {_OBSERVED} WHERE p_brand LIKE 'Brand#4%'")
def obs_attr(t):
    return Query([*_SEEN, Filter([Predicate("brand", "LIKE", "Brand#4%")]), Projection([Column("id", "observed-data", "observation_id"), Column("number_observed", "observed-data"), Column("kind", "part")])]).to_df(_observed(t))


@demo("""SELECT coalesce(a.c_custkey, b.o_custkey) AS id, a.c_name AS name, least(a.c_custkey % 5, b.low) AS first_observed, greatest(a.c_custkey % 5, b.high) AS last_observed, CAST(1 + coalesce(b.n, 0) AS BIGINT) AS number_observed
FROM customer a LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS low, max(o_orderkey) AS high, sum(1) AS n FROM orders GROUP BY 1) b ON c_custkey = o_custkey""")
def upsert_merge(t):
    old = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5).alias("first_observed"), (F.col("c_custkey") % 5).alias("last_observed"), F.lit(1).cast("long").alias("number_observed"))
    new = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_observed"), F.col("o_orderkey").alias("last_observed"), F.lit(1).cast("long").alias("number_observed"))
    new = new.join(old.select("id"), "id", "left_semi")
    return upsert.merged(old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)), allowMissingColumns=True), "id", "seq")


@demo("SELECT DISTINCT 'part_refs' AS ref_name, l_orderkey AS source_ref, l_partkey AS target_ref FROM lineitem")
def explode_reflist(t):
    lists = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("part_refs"))
    return lists.select(F.lit("part_refs").alias("ref_name"), F.col("l_orderkey").alias("source_ref"), F.explode("part_refs").alias("target_ref")).distinct()


@demo(f"""WITH h AS (SELECT c_custkey, sha1(unhex('{NAMESPACE.hex}') || encode('{{"value":"' || c_name || '"}}')) AS x FROM customer)
SELECT c_custkey, 'url--' || x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab', 1 + (instr('0123456789abcdef', x[17:17]) - 1) % 4, 1) || x[18:20] || '-' || x[21:32] AS id FROM h""")
def uuid5_ids(t):
    name = F.to_json(F.struct(F.col("c_name").alias("value")))
    return t("customer").select("c_custkey", F.concat(F.lit("url--"), scalars.uuid5(name, str(NAMESPACE))).alias("id"))


@demo("""WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
SELECT event_id, CAST(floor((epoch_us(ts) - lo) / ((hi - lo) / 86400000000.0) / 1000000) AS BIGINT) AS second FROM events, b""")
def timeshift(t):
    moved = bundle_tools.shifted(t("events"), "ts", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "moved")
    return moved.select("event_id", F.floor((F.unix_micros("moved") - F.lit(1704067200000000)) / 1000000).alias("second"))


@demo("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS again FROM events")
def dedup_ids(t):
    return bundle_tools.repeats(t("events"), "user_id", "event_id").select("event_id", "again")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | session_catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | session_catalog.SQL


__all__ = ["oracle_sql", "queries"]
