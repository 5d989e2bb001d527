import asyncio
import base64
import http.server
import json
import threading
import zipfile

import pytest

from sightline.aio import AsyncStore
from sightline.cli import main
from sightline.errors import SessionExists, SessionNotFound
from sightline.functions.ids import make_id
from sightline.operators.query import Aggregation, Group, Query
from sightline.plans import bundle_tools
from sightline.plans.store import Store
from sightline.sources import bundles, logs, translate
from sightline.streaming import incremental

from .bundles import bundle, connections, identity, observation, traffic

ME = {"type": "identity", "id": "identity--me", "identity_class": "program", "name": "me"}


def objects_of(df):
    return [json.loads(r["object"]) for r in df.orderBy("seq").collect()]


def test_make_id():
    assert make_id({"type": "ipv4-addr", "value": "198.51.100.3"}) == "ipv4-addr--28bb3599-77cd-5a82-a950-b5bc3caf07c4"
    assert make_id({"type": "file", "hashes": {"SHA-256": "b", "MD5": "a"}, "name": "x"}) == make_id({"type": "file", "hashes": {"MD5": "a"}, "name": "x"})
    assert make_id({"type": "url", "value": "http://a/b"}) != make_id({"type": "url", "value": "http://a/b"}, escape_slash=False)
    assert make_id({"type": "x-any", "value": 1}) != make_id({"type": "x-any", "value": 1})
    obs = {"last_observed": "t", "objects": {"0": {"type": "process", "pid": 3}, "1": {"type": "x-oca-asset", "hostname": "h"}}}
    assert make_id(obs["objects"]["0"], obs) == make_id({"type": "process", "x_unique_id": "3_h_t"})


def test_normalize():
    got = bundles.normalize({"type": "file", "hashes": {"SHA-1": "x", "MD5": "y"}, "extensions": {"a-ext": {"b": [1, {"c": 2}]}}})
    assert got == {"type": "file", "hashes.'SHA-1'": "x", "hashes.MD5": "y", "extensions.'a-ext'.b": [1, {"c": 2}]}
    assert bundles.normalize({"type": "x-thing", "deep": {"a": {"b": 1}}}) == {"type": "x-thing", "deep": {"a": {"b": 1}}}
    assert bundles.normalize({"type": "a", "b": [1, {"c": 2}]}, flat_lists=True) == {"type": "a", "b[0]": 1, "b[1].c": 2}
    assert bundles.short_name("extensions.'windows-service-ext'.service_name") == "x_service_name"


def test_windows_events(spark, tmp_path):
    events = [
        {"EventID": 1, "TimeCreated": "2021-03-01T10:00:00.5Z", "UtcTime": "2021-03-01 10:00:00.123", "Image": "C:\\Windows\\cmd.exe", "ProcessId": "12", "ProcessGuid": "{g}", "CommandLine": "cmd /c x", "ParentImage": "C:\\Windows\\explorer.exe", "ParentProcessId": "0x10", "Hashes": "SHA1=aa,MD5=bb", "Hostname": "host1", "User": "u", "Message": "Process Create: details"},
        {"EventID": 3, "TimeCreated": "2021-03-01T10:00:01Z", "UtcTime": "2021-03-01 10:00:01", "Image": "C:\\a.exe", "ProcessId": 5, "SourceIp": "10.0.0.1", "DestinationIp": "fe80::1", "Protocol": "tcp", "SourcePort": "1000", "DestinationPort": "443", "Hostname": "host1"},
        {"EventID": 13, "TimeCreated": "2021-03-01T10:00:02Z", "Image": "C:\\a.exe", "ProcessId": 5, "TargetObject": "HKLM\\Software\\Key\\Name", "Message": "Registry value set: EventType: SetValue Details: DWORD (0x1)"},
    ]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, events)))
    made = objects_of(logs.convert(spark, str(tmp_path / "w.json")))
    assert [o["type"] for o in made] == ["identity"] + ["observed-data"] * 3
    first = {o["type"] + o.get("name", ""): o for o in made[1]["objects"].values()}
    process = first["processcmd.exe"]
    parent = made[1]["objects"][process["parent_ref"]]
    assert process["pid"] == 12 and parent["pid"] == 16 and made[1]["objects"][process["binary_ref"]]["hashes"] == {"SHA-1": "aa", "MD5": "bb"}
    event = first["x-oca-event"]
    assert event["code"] == 1 and made[1]["objects"][event["process_ref"]] is process and made[1]["objects"][event["host_ref"]]["hostname"] == "host1"
    assert base64.b64decode(first["artifact"]["payload_bin"]).decode() == "Process Create: details"
    assert made[1]["first_observed"] == "2021-03-01T10:00:00.123Z"
    second = made[2]["objects"]
    net = next(o for o in second.values() if o["type"] == "network-traffic")
    assert second[net["src_ref"]] == {"type": "ipv4-addr", "value": "10.0.0.1"} and second[net["dst_ref"]]["type"] == "ipv6-addr" and net["dst_port"] == 443
    third = next(o for o in made[3]["objects"].values() if o["type"] == "windows-registry-key")
    assert third["key"] == "HKEY_LOCAL_MACHINE\\Software\\Key" and third["values"] == [{"name": "Name"}] or third["values"] == [{"data": "(0x1)", "data_type": "DWORD"}]
    store = Store(spark, str(tmp_path / "s"), "w")
    bundle_tools.write_objects(logs.convert(spark, str(tmp_path / "w.json")), str(tmp_path / "parts"))
    store.cache("q", {"type": "bundle", "objects": made})
    assert store.count("process") >= 3 and store.count("observed-data") == 3


def test_zeek_and_others(spark, tmp_path):
    log = "#separator \\x09\n#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\n#types\ttime\taddr\tport\taddr\tport\tenum\n1617000000.5\t10.0.0.1\t99\t10.0.0.2\t53\tudp\n#close\t2021\n"
    (tmp_path / "conn.log").write_text(log)
    made = objects_of(logs.convert(spark, str(tmp_path / "conn.log")))
    net = next(o for o in made[1]["objects"].values() if o["type"] == "network-traffic")
    assert net["src_port"] == 99 and net["protocols"] == ["udp"] and made[1]["first_observed"].startswith("2021-03-29T06:40:00.5")
    dns = {"@stream": "dns", "ts": 1617000000, "id_orig_h": "10.0.0.1", "id_resp_h": "10.0.0.2", "proto": "udp", "query": "a.b", "answers": ["1.2.3.4", "c.d", "::1"]}
    got = logs.observation(logs.pairs(dns, logs.ZEEK_COMMON | logs.ZEEK_STREAMS["dns"]), "identity--1")["objects"]
    name = next(o for o in got.values() if o["type"] == "domain-name")
    assert logs.format_of(dns) == "zeek-json" and [got[k]["type"] for k in name["resolves_to_refs"]] == ["ipv4-addr", "ipv6-addr"] or len(name["resolves_to_refs"]) == 2
    pot = {"url": "/x", "user_agent": "ua", "source": "9.9.9.9", "date": "2021-01-01", "time": "00:00:01"}
    assert logs.format_of(pot) == "honeypot" and logs.observation(logs._honeypot(pot), "i")["first_observed"] == "2021-01-01T00:00:01.000Z"
    rows = 'type,name,pid,created\nprocess,a.exe,3,2021-01-01T00:00:00Z\n'
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("p.csv", rows)
    flat = objects_of(logs.convert(spark, str(tmp_path / "p.zip")))
    assert flat[1]["objects"]["0"] == {"type": "process", "name": "a.exe", "pid": 3, "created": "2021-01-01T00:00:00.000Z"} and flat[1]["first_observed"] == "2021-01-01T00:00:00.000Z"
    with pytest.raises(Exception, match="NotImplemented|p.bin"):
        (tmp_path / "p.bin").write_text("x")
        logs.convert(spark, str(tmp_path / "p.bin")).collect()


MAPPING = {
    "event": {"time": [{"key": "first_observed", "cybox": False}, {"key": "last_observed", "cybox": False}]},
    "source": {"ip": [{"key": "ipv4-addr.value", "object": "src_ip"}, {"key": "ipv6-addr.value", "object": "src_ip"}, {"key": "network-traffic.src_ref", "object": "nt", "references": "src_ip"}], "port": {"key": "network-traffic.src_port", "object": "nt", "transformer": "ToInteger"}},
    "dest": {"ip": [{"key": "ipv4-addr.value", "object": "dst_ip"}, {"key": "ipv6-addr.value", "object": "dst_ip"}, {"key": "network-traffic.dst_ref", "object": "nt", "references": "dst_ip"}], "port": {"key": "network-traffic.dst_port", "object": "nt", "transformer": "ToInteger"}},
    "proto": {"key": "network-traffic.protocols", "object": "nt", "transformer": "ToLowercaseArray"},
    "host": {"name": {"key": "x-oca-asset.hostname", "object": "host"}, "ip": [{"key": "ipv4-addr.value", "object": "host_ip", "unwrap": True}, {"key": "x-oca-asset.ip_refs", "object": "host", "references": ["host_ip"]}]},
    "user": {"key": "user-account.user_id", "object": "user"},
}
EVENTS = [
    {"event": {"time": "2021-01-01T00:00:00Z"}, "source": {"ip": "10.0.0.1", "port": "1000"}, "dest": {"ip": "fe80::1", "port": "80"}, "proto": ["TCP", "ip", ""], "host": {"name": "h1", "ip": ["10.0.0.1", "10.0.0.9"]}, "junk": 1},
    {"event": {"time": "2021-01-01T00:00:01Z"}, "source": {"ip": "10.0.0.2", "port": "1001"}, "dest": {"ip": "10.0.0.3", "port": "443"}, "proto": ["udp"], "host": {"name": "h1", "ip": ["10.0.0.9"]}, "user": "u/1"},
]


def test_translate(spark, tmp_path):
    wide = translate.translate(spark, MAPPING, {}, EVENTS, ME)
    assert "junk" not in " ".join(wide.columns)
    rows = {r["nt#network-traffic:src_port"]: r for r in wide.collect()}
    assert rows[1000]["nt#network-traffic:protocols"] == ["ip", "tcp"]
    assert rows[1000]["src_ip#ipv4-addr:id"] == make_id({"type": "ipv4-addr", "value": "10.0.0.1"}) and rows[1000]["dst_ip#ipv4-addr:value"] is None
    want = make_id({"type": "network-traffic", "src_ref": rows[1000]["src_ip#ipv4-addr:id"], "dst_ref": rows[1000]["dst_ip#ipv6-addr:id"], "src_port": 1000, "dst_port": 80, "protocols": ["ip", "tcp"]})
    assert rows[1000]["nt#network-traffic:id"] == want
    assert rows[1001]["user#user-account:id"] == make_id({"type": "user-account", "user_id": "u/1"}) and rows[1000]["user#user-account:id"] is None
    assert len(rows[1000]["host#x-oca-asset:ip_refs"]) == 2
    store = Store(spark, str(tmp_path), "t")
    translate.ingest(store, ME, wide, "q1")
    assert store.count("ipv4-addr") == 4 and store.count("x-oca-asset") == 1 and store.count("observed-data") == 2
    assert store.value_counts("network-traffic", "src_ref.value") and store.count("__reflist") == 2
    ranks = {r["x_rank"] for r in store.run_query(Query("__contains"))}
    assert ranks == {0, 1}


def test_bundle_tools(spark):
    given = bundles.read_objects(spark, connections(4))
    assert len(objects_of(bundle_tools.limit(given, 2))) == 3
    fresh = objects_of(bundle_tools.randomize_ids(given))
    assert len({o["id"] for o in fresh}) == 5 and {o["created_by_ref"] for o in fresh[1:]} == {fresh[0]["id"]}
    twice = bundles.read_objects(spark, [bundle([observation(1, traffic("1.1.1.1", "2.2.2.2", 1)), observation(1, traffic("1.1.1.1", "2.2.2.2", 1))])])
    assert len({o["id"] for o in objects_of(bundle_tools.dedup_ids(twice))}) == 3
    up = objects_of(bundle_tools.upgrade(given))
    assert {o.get("spec_version") for o in up if o["type"] != "identity"} == {"2.1"}
    net = next(o for o in up if o["type"] == "network-traffic")
    assert net["src_ref"].startswith("ipv4-addr--")
    moved = [o for o in objects_of(bundle_tools.timeshift(given, "2022-01-01T00:00:00Z", "2022-01-01T00:00:30Z")) if o["type"] == "observed-data"]
    assert [m["first_observed"] for m in moved] == [f"2022-01-01T00:00:{10 * k:02d}.000Z" for k in range(4)]
    assert moved[0]["last_observed"] == "2022-01-01T00:00:05.000Z"


def test_streaming(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    parts = connections(6)["objects"]
    (inbox / "a.jsonl").write_text("\n".join(map(json.dumps, parts[:4])))
    store = Store(spark, str(tmp_path / "s"), "live")
    run = lambda: incremental.cache_stream(store, incremental.stream_objects(spark, str(inbox)), "q", str(tmp_path / "c")).awaitTermination()
    run()
    assert store.count("observed-data") == 3
    (inbox / "b.jsonl").write_text("\n".join(map(json.dumps, parts[3:])))
    run()
    assert store.count("observed-data") == 6 and store.count("ipv4-addr") == 7
    events = spark.createDataFrame([("2021-01-01 00:00:01", "a"), ("2021-01-01 00:04:59", "a"), ("2021-01-01 00:05:00", "b")], "ts string, k string").selectExpr("cast(ts as timestamp) ts", "k")
    assert sorted((r["k"], r["n"]) for r in incremental.binned_counts(events, "ts", "5 minutes", ["k"]).collect()) == [("a", 2), ("b", 1)]
    assert sorted((r["k"], r["n"]) for r in incremental.session_counts(events, "ts", "1 minute", ["k"]).collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_async(spark, tmp_path):
    async def use():
        store = AsyncStore(spark, str(tmp_path), "a")
        with pytest.raises(SessionNotFound):
            await store.attach()
        await store.create()
        await store.cache("q", connections(2))
        assert "ipv4-addr" in await store.types() and len(await store.lookup("ipv4-addr")) == 4
        await store.assign_query("g", Query(["network-traffic", Group(["dst_port"]), Aggregation([("COUNT", "*", "n")])]))
        assert await store.views() == ["g"] and [r["n"] for r in await store.lookup("g")] == [1, 1]
        await store.new_type("x-new", {"id": "string"})
        await store.new_property("x-new", "a", "bigint")
        assert await store.columns("x-new") == ["id", "a"]
        with pytest.raises(SessionExists):
            await AsyncStore(spark, str(tmp_path), "a").create()
        await store.delete()

    asyncio.run(use())


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "b.json").write_text(json.dumps(connections(3)))
    base = ["--path", str(tmp_path), "--session", "c", "--format", "json"]

    def run(*args):
        capsys.readouterr()
        main([*base, *args], spark)
        return capsys.readouterr().out

    run("cache", "q1", str(tmp_path / "b.json"))
    run("extract", "conns", "network-traffic", "q1", "[network-traffic:dst_port < 22]")
    assert json.loads(run("count", "conns")) == [2]
    assert json.loads(run("tables")) == ["conns", "identity", "ipv4-addr", "network-traffic", "observed-data", "user-account"]
    assert len(json.loads(run("lookup", "conns", "--columns", "dst_port"))) == 2
    assert json.loads(run("summary", "conns"))[0]["number_observed"] == 2
    assert json.loads(run("sql", "SELECT count(*) AS n FROM conns")) == [{"n": 2}]
    out = json.loads(run("upgrade", str(tmp_path / "b.json")))
    assert out["type"] == "bundle" and len(out["objects"]) == 16
    assert len(json.loads(run("limit", "1", str(tmp_path / "b.json")))["objects"]) == 2
    assert identity()["id"] == "identity--1"


def test_broken_and_remote_bundles(spark, tmp_path):
    text = json.dumps(connections(4))
    cut = text[: text.rindex('"type": "observed-data"') - 1]
    (tmp_path / "cut.json").write_text(cut)
    assert bundles.read_objects(spark, str(tmp_path / "cut.json")).count() == 0
    assert len(objects_of(bundles.read_objects(spark, str(tmp_path / "cut.json"), partial=True))) == 4
    assert list(bundles.whole_objects("no bundle")) == [] and [json.loads(o) for o in bundles.whole_objects('{"objects" : [ {"a": 1} , {"b": [2]}]}')] == [{"a": 1}, {"b": [2]}]
    assert len(objects_of(bundles.read_objects(spark, connections(4), types=["identity"]))) == 1
    (tmp_path / "b.json").write_text(text)

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=str(tmp_path))

        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        got = objects_of(bundles.read_objects(spark, [f"http://127.0.0.1:{server.server_port}/b.json", connections(1)]))
        server.shutdown()
    assert len(got) == 7


def test_json_lines_of_late_and_mixed_formats(spark, tmp_path):
    """The first known event stands behind 150 others; a folder holds files of two formats and one of none. Small parts make files span tasks."""
    folder = tmp_path / "logs.jsonl"
    folder.mkdir()
    beats = [{"heartbeat": n} for n in range(150)]
    flat = [{"type": "ipv4-addr", "value": f"10.0.0.{n}"} for n in range(60)]
    zeek = [{"id.orig_h": f"10.1.0.{n}", "id.orig_p": 1, "id.resp_h": "10.2.0.1", "id.resp_p": 53, "proto": "udp", "ts": 1.5} for n in range(40)]
    for name, events in (("a", beats + flat), ("b", zeek), ("c", beats)):
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, events)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for path, n in ((folder / "a.jsonl", 60), (folder / "b.jsonl", 40), (folder / "c.jsonl", 0), (folder, 100)):
                made = [json.loads(r["object"]) for r in logs.convert(spark, str(path)).collect()]
                assert [o["type"] for o in made].count("observed-data") == n and len(made) == n + 1
            values = {x["value"] for o in made[1:] for x in o["objects"].values() if x["type"] == "ipv4-addr"}
            assert values == {e["value"] for e in flat} | {e["id.orig_h"] for e in zeek} | {"10.2.0.1"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_files_by_one_reader(spark, tmp_path):
    """Files of a list keep its order, whatever their names; a folder and a dictionary among them."""
    parts = connections(5)["objects"]
    names = ["z z.json", "a.json", "m%1.json"]
    for name, obj in zip(names, parts, strict=False):
        (tmp_path / name).write_text(json.dumps({"objects": [obj, {"type": "x-next", "id": name}]}))
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "f.json").write_text(json.dumps({"objects": [parts[3]]}))
    got = objects_of(bundles.read_objects(spark, [*[str(tmp_path / n) for n in names], str(tmp_path / "folder"), {"objects": [parts[4]]}]))
    assert [o["id"] for o in got] == [x for n, p in zip(names, parts, strict=False) for x in (p["id"], n)] + [parts[3]["id"], parts[4]["id"]]
