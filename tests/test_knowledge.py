import pytest
from pyspark.sql import functions as F

from sightline import knowledge as k
from sightline.errors import InvalidStixPath, InvalidViewname, StixPatternError
from sightline.functions import scalars
from sightline.names import check_name, check_path
from sightline.operators import pattern


def test_paths():
    assert k.parse_prop("network-traffic", "src_port") == [("node", "network-traffic", "src_port")]
    assert k.parse_prop("network-traffic", "src_ref.value") == [("rel", "network-traffic", "src_ref", "ipv4-addr"), ("node", "ipv4-addr", "value")]
    assert k.parse_path("process:parent_ref.binary_ref.name")[1:] == [("rel", "process", "binary_ref", "file"), ("node", "file", "name")]
    assert k.parse_prop("process", "opened_connection_refs[*].src_ref.value")[0] == ("rel", "process", "opened_connection_refs", "network-traffic")
    assert k.parse_prop("x-thing", "odd_ref.value") == []
    assert k.ref_types("x-oca-event", "parent_process_ref") == ("process",) and k.ref_types("x-ibm-finding", "src_os_user_ref") == ("user-account",)


def test_metadata():
    assert k.primary_prop("x-oca-event") == "action" and k.primary_prop("ipv4-addr") == "value"
    assert k.prop_metadata("observed-data", "first_observed")["ftype"] == "timestamp"
    assert k.prop_metadata("network-traffic", "src_byte_count") == {"dtype": "int", "ftype": "numerical"}
    assert k.prop_metadata("x", "start_time")["ftype"] == "timestamp" and k.prop_metadata("x", "word_count")["ftype"] == "numerical"
    assert k.path_metadata("network-traffic:src_ref.value") == {"dtype": "str", "ftype": "categorical"}


@pytest.mark.parametrize(
    "args,want",
    [
        (("network-traffic", "src_port", "bigint"), ("NUNIQUE", "src_port", "unique_src_port")),
        (("process", "pid", "int"), ("NUNIQUE", "pid", "unique_pid")),
        (("file", "size", "bigint"), ("AVG", "size", "mean_size")),
        (("file", "name", "string"), ("NUNIQUE", "name", "unique_name")),
        (("x", "first_observed", "string"), ("MIN", "first_observed", "first_observed")),
        (("x", "last_observed", "string"), ("MAX", "last_observed", "last_observed")),
        (("x", "number_observed", "bigint"), ("SUM", "number_observed", "number_observed")),
        (("x", "id", "string"), None),
        (("x", "p" * 60, "string"), None),
    ],
)
def test_auto_agg(args, want):
    assert k.auto_agg(*args) == want


def test_names():
    for good in ("conns", "my-view", "a_1"):
        assert check_name(good) == good
    for bad in ("a b", "a;b", "", None, 'a"b'):
        with pytest.raises(InvalidViewname):
            check_name(bad)
    for good in ("value", "src_ref.value", "file:hashes.'SHA-1'", "x[*].y", "network-traffic:protocols[*]"):
        assert check_path(good) == good
    for bad in ("a b", "x;y", "a.'b", "1' OR '1'='1", 3):
        with pytest.raises(InvalidStixPath):
            check_path(bad)


def test_summaries():
    assert pattern.summarize("[a:x = 1 AND a:y = 2 OR b:z = 'q']") == {"a": {"x", "y"}, "b": {"z"}}
    assert pattern.summarize("[a:x = 1] OR [a:y = 2]") == {"a": {"x", "y"}}
    assert pattern.summarize("[a:x = 1 OR a:y = 1] AND [a:y = 2]") == {"a": {"y"}}
    assert pattern.parse(r"[file:name = 'it\'s \\ here']").value == r"it's \ here"
    for bad in ("", "[]", "[a:b]", "[a:b = 'x]", "[a:b = c.d]", "[a:b = 1] START t'x' STOP t'y'", "[a:b == 1]"):
        with pytest.raises(StixPatternError):
            pattern.parse(bad)


def test_scalars(spark):
    rows = spark.createDataFrame([("10.0.0.5",), ("10.0.1.0/24",), ("300.1.1.1",), ("fe80::1",), ("FE80:0:0:0:0:0:0:ff",), (None,), ("x",)], "a string")
    got = [tuple(r) for r in rows.select(scalars.in_subnet(F.col("a"), "10.0.0.0/24"), scalars.in_subnet(F.col("a"), "10.0.0.0/16"), scalars.in_subnet(F.col("a"), "fe80::/64")).collect()]
    assert got == [(True, True, False), (False, True, False), (False, False, False), (False, False, True), (False, False, True), (False, False, False), (False, False, False)]
    with pytest.raises(ValueError):
        scalars.in_subnet(F.col("a"), "10.0.0.1/24")
    one = spark.range(1).select(
        scalars.uuid5(F.lit('{"value":"198.51.100.3"}'), "00abedb4-aa42-466c-9c01-fed23315a9b7").alias("u"),
        scalars.timefmt(F.lit("2020-01-02 03:04:05.678901").cast("timestamp")).alias("t"),
        scalars.matches(F.lit("a\nb"), "a.b").alias("m"),
        scalars.matches(F.lit(None).cast("string"), "a").alias("n"),
        scalars.like(F.lit("C:\\Windows"), "C:\\W%").alias("l"),
        scalars.decoded(F.lit("not base64!")).alias("d"),
        scalars.decoded(F.lit("aGk=")).alias("e"),
    ).first()
    assert tuple(one) == ("28bb3599-77cd-5a82-a950-b5bc3caf07c4", "2020-01-02T03:04:05.678Z", True, False, True, None, "hi")
