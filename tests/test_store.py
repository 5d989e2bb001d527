import pytest

from sightline.errors import IncompatibleType, InvalidAttr, InvalidObject, InvalidViewname, SessionExists, SessionNotFound, StixPatternError, UnknownViewname
from sightline.operators.query import Aggregation, BinnedColumn, Filter, Group, Order, Predicate, Projection, Query, Table
from sightline.plans.store import Store

from .bundles import bundle, connections, identity, observation, traffic


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("s")), "main")
    s.cache("q1", [connections()])
    s.extract("conns", "network-traffic", "q1", "[network-traffic:dst_port < 25]")
    s.extract("addrs", "ipv4-addr", "q1", "")
    return s


def test_tables(store):
    assert store.types() == ["identity", "ipv4-addr", "network-traffic", "observed-data", "user-account"]
    assert {"conns", "addrs"} <= set(store.tables())
    assert store.count("ipv4-addr") == 7 and store.count("observed-data") == 10 and store.count("identity") == 1
    assert store.table_type("conns") == "network-traffic"


def test_extract_lookup(store):
    rows = store.lookup("conns")
    assert len(rows) == 5 and all(r["type"] == "network-traffic" for r in rows)
    assert {r["src_ref.value"] for r in rows} == {f"192.168.0.{i}" for i in range(1, 6)}
    assert "src_ref" not in rows[0] and rows[0]["protocols"] == '["ipv4","tcp"]'
    assert sorted(store.values("dst_port", "conns")) == [20, 21, 22, 23, 24]
    some = store.lookup("conns", "src_ref.value, dst_port", limit=2)
    assert len(some) == 2 and set(some[0]) == {"src_ref.value", "dst_port"}
    with pytest.raises(InvalidAttr):
        store.lookup("conns", "no;such")


def test_patterns(store):
    n = 0

    def count(pattern, kind="network-traffic"):
        nonlocal n
        n += 1
        store.extract(f"p{n}", kind, "q1", pattern)
        return store.count(f"p{n}")

    assert count("[network-traffic:src_ref.value = '192.168.0.1']") == 2
    assert count("[network-traffic:src_ref.value = '192.168.0.1' OR network-traffic:dst_port = 29]") == 3
    assert count("[network-traffic:src_ref.value IN ('192.168.0.1', '192.168.0.2') AND network-traffic:dst_port > 21]") == 2
    assert count("[network-traffic:protocols[*] = 'tcp']") == 10
    assert count("[network-traffic:protocols[*] != 'tcp']") == 0
    assert count("[ipv4-addr:value ISSUBSET '10.0.0.0/8']", "ipv4-addr") == 2
    assert count("[ipv4-addr:value NOT ISSUBSET '10.0.0.0/8']", "ipv4-addr") == 5
    assert count("[ipv4-addr:value LIKE '192.168.%'] OR [ipv4-addr:value = '10.0.0.1']", "ipv4-addr") == 6
    assert count("([ipv4-addr:value LIKE '192.168.%'] OR [ipv4-addr:value = '10.0.0.1']) AND [ipv4-addr:value MATCHES '1$']", "ipv4-addr") == 2
    assert count("[user-account:user_id = 'user1' AND ipv4-addr:value = 'x']", "user-account") == 1
    assert count("[network-traffic:dst_port = 'abc']") == 0
    assert count("[network-traffic:dst_port >= 20] START t'2020-01-01T00:00:00Z' STOP t'2021-01-01T00:00:00.000Z'") == 10
    for bad in ("[network-traffic:dst_port <]", "nonsense", "[network-traffic:dst_port = 1", "[network-traffic:dst_port ISSUBSET '10.0.0.0/8']"):
        with pytest.raises(StixPatternError):
            count(bad)


def test_views_are_late_bound(store):
    store.extract("low", "network-traffic", "q1", "[network-traffic:dst_port < 22]")
    store.assign("sorted", "low", "sort", by="dst_port", ascending=False)
    assert [r["dst_port"] for r in store.lookup("sorted")] == [21, 20]
    store.extract("low", "network-traffic", "q1", "[network-traffic:dst_port < 23]")
    assert [r["dst_port"] for r in store.lookup("sorted")] == [22, 21, 20]
    store.filter("low", "network-traffic", "low", "[network-traffic:dst_port > 20]")
    assert store.count("low") == 2
    store.merge("both", ["low", "conns"])
    store.remove_view("low")
    assert store.count("both") == 5
    with pytest.raises(UnknownViewname):
        store.lookup("low")
    with pytest.raises(IncompatibleType):
        store.merge("bad", ["conns", "addrs"])
    with pytest.raises(InvalidViewname):
        store.extract("a b", "ipv4-addr", "q1", "")


def test_join_rename(store):
    store.load("mine", [{"type": "x-note", "value": "192.168.0.1", "note": "known"}])
    store.join("noted", "addrs", "value", "mine", "value")
    rows = store.lookup("noted")
    assert len(rows) == 1 and rows[0]["note"] == "known"
    store.rename_view("noted", "named")
    assert store.count("named") == 1 and "noted" not in store.view_names()
    store.set_appdata("named", {"a": 1})
    assert store.get_appdata("named") == {"a": 1}
    assert store.get_view_data(["named"])[0]["appdata"] == {"a": 1}


def test_statistics(store):
    counts = {r["src_ref.value"]: r["count"] for r in store.value_counts("network-traffic", "src_ref.value")}
    assert counts == {f"192.168.0.{i}": 2 for i in range(1, 6)}
    assert store.number_observed("network-traffic", "src_ref.value", "192.168.0.1") == 2
    assert store.number_observed("network-traffic", "src_ref.value", "1.1.1.1") == 0
    s = store.summary("ipv4-addr", "value", "192.168.0.2")
    assert s == {"first_observed": "2020-06-30T19:01:00.000Z", "last_observed": "2020-06-30T19:06:30.000Z", "number_observed": 2}
    assert store.summary("ipv4-addr", "value", "nobody") == {"first_observed": None, "last_observed": None, "number_observed": 7}
    times = store.timestamped("conns", "src_ref.value")
    assert [t["first_observed"] for t in times] == sorted(t["first_observed"] for t in times) and len(times) == 5
    rows = store.extract_observeddata_attribute("conns", ["number_observed", "id"], ["dst_port", "src_ref.value"], limit=3)
    assert set(rows[0]) == {"number_observed", "observation_id", "dst_port", "src_ref.value"} and len(rows) == 3


def test_group(store):
    store.group("by_dst", "network-traffic", by="dst_ref.value")
    rows = store.lookup("by_dst")
    assert [r["dst_ref.value"] for r in rows] == ["10.0.0.1", "10.0.0.2"]
    assert rows[0]["unique_dst_port"] == 5 and rows[0]["mean_src_byte_count"] == 100
    store.group("counted", "network-traffic", by=["dst_ref.value", BinnedColumn("dst_port", 5, alias="bin")], aggs=[("COUNT", "src_ref.value", "n")])
    assert sum(r["n"] for r in store.lookup("counted")) == 10
    store.assign_query("q", Query([Table("network-traffic"), Group(["src_ref"])]))
    assert "unique_dst_port" in store.columns("q")
    binned = Query([Table("observed-data"), Projection([BinnedColumn("first_observed", 5, "m")]), Group(["first_observed"]), Aggregation([("COUNT", "*", "n")]), Order(["first_observed"])])
    assert store.run_query(binned) == [{"first_observed": "2020-06-30T19:00:00Z", "n": 5}, {"first_observed": "2020-06-30T19:05:00Z", "n": 5}]
    assert store.run_query(Query([Table("conns"), Filter([Predicate("dst_port", "IN", [20, 21])])]))[0]["dst_port"] in (20, 21)


def test_merge_rules(spark, tmp_path):
    s = Store(spark, str(tmp_path), "m")
    s.cache("a", [connections(3)])
    s.cache("a", [connections(3)])
    assert s.count("__contains") == 12 and s.count("__queries") == len({r["sco_id"] for r in s.run_query(Query("__queries"))})
    assert {r["number_observed"] for r in s.lookup("observed-data")} == {1}
    s.cache("b", [bundle([observation(77, {"0": {"type": "ipv4-addr", "value": "192.168.0.1", "x_extra": "kept", "x_score": 1.5}})])])
    s.cache("c", [connections(1)])
    row = [r for r in s.lookup("ipv4-addr") if r["value"] == "192.168.0.1"][0]
    assert row["x_extra"] == "kept" and row["x_score"] == 1.5
    ids = {r["value"]: r["id"] for r in s.lookup("ipv4-addr")}
    s.reassign("ipv4-addr", [{"type": "ipv4-addr", "id": ids["192.168.0.1"], "value": "192.168.0.1", "x_seen": 3}])
    assert [r for r in s.lookup("ipv4-addr") if r["value"] == "192.168.0.1"][0]["x_seen"] == 3
    again = Store(spark, str(tmp_path), "m", attach=True)
    assert again.count("ipv4-addr") == s.count("ipv4-addr")
    with pytest.raises(SessionExists):
        Store(spark, str(tmp_path), "m", attach=False)
    again.delete()
    with pytest.raises(SessionNotFound):
        Store(spark, str(tmp_path), "m", attach=True)


def test_mixed_addresses_and_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path), "x")
    s.cache("q", [connections(10, mixed=True)])
    rows = s.lookup("network-traffic")
    assert {r["src_ref.value"] for r in rows if r["dst_port"] in (24, 29)} == {"fe80::4", "fe80::9"}
    assert len(rows) == 10 and all(r["src_ref.value"] and r["dst_ref.value"] for r in rows)
    new = {"type": "bundle", "id": "bundle--2", "objects": [
        identity(2),
        {"type": "observed-data", "spec_version": "2.1", "id": "observed-data--n", "first_observed": "2021-01-01T00:00:00Z", "last_observed": "2021-01-01T00:00:00Z", "number_observed": 1, "object_refs": ["domain-name--1", "ipv4-addr--1"]},
        {"type": "domain-name", "spec_version": "2.1", "id": "domain-name--1", "value": "example.com", "resolves_to_refs": ["ipv4-addr--1"]},
        {"type": "ipv4-addr", "spec_version": "2.1", "id": "ipv4-addr--1", "value": "198.51.100.3"},
    ]}
    s.cache("q2", new)
    assert s.count("domain-name") == 1 and s.count("__reflist") == 1
    assert s.value_counts("domain-name", "value") == [{"value": "example.com", "count": 1}]
    with pytest.raises(Exception, match="type"):
        s.cache("q3", {"type": "bundle", "objects": [{"id": "nothing", "value": 1}]})
    with pytest.raises(InvalidObject):
        s.load("v", [{"value": 1}])


def test_rank(spark, tmp_path):
    s = Store(spark, str(tmp_path), "r")
    s.cache("q", [bundle([observation(1, traffic("192.168.0.1", "10.0.0.1", 80))])])
    ranked = {r["target_ref"] for r in s.run_query(Query("__contains")) if r["x_rank"] == 1}
    values = {r["id"]: r["value"] for r in s.lookup("ipv4-addr")}
    assert [values[i] for i in ranked if i in values] == ["192.168.0.1"] and len(ranked) == 3


def test_increments(spark, tmp_path, monkeypatch):
    """Merges write only what changes, read back as one table, and are compacted."""
    from sightline.plans import store as module

    s = Store(spark, str(tmp_path), "i")
    for n in range(4):
        s.cache(f"q{n}", [bundle([observation(n, traffic(f"192.168.0.{n % 2}", "10.0.0.1", 80 + n, bytes_=n))])])
    assert len(s.versions["ipv4-addr"]) == 4 and s.count("ipv4-addr") == 3 and s.count("observed-data") == 4 and s.count("network-traffic") == 4
    assert spark.read.parquet(s.versions["ipv4-addr"][-1]).count() == 2
    assert {r["src_byte_count"] for r in s.lookup("network-traffic")} == {0, 1, 2, 3}
    monkeypatch.setattr(module, "DELTAS", 4)
    s.cache("q9", [bundle([observation(9, {"0": {"type": "ipv4-addr", "value": "10.0.0.1", "x_new": 5}})])])
    assert len(s.versions["ipv4-addr"]) == 1 and s.count("ipv4-addr") == 3
    assert [r["x_new"] for r in s.lookup("ipv4-addr") if r["value"] == "10.0.0.1"] == [5]
    s.extract("late", "ipv4-addr", "q9", "")
    assert s.count("late") == 1
