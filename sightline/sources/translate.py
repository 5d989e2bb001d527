"""Native events to typed objects by a mapping: one plan of column expressions, and the split of its wide rows into tables.

A mapping gives for each native field (perhaps nested) one target or several: {key, object, references, transformer, unwrap, group, value, cybox}. The wide
frame has a column `object#type:property` for each, and for each object a column of ids."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import CONTRIBUTING, NAMESPACE
from ..functions.scalars import uuid5
from ..names import quoted
from .bundles import RANK, ROWS, short_name
from .logs import now

#: Network layers of protocols, lower ones first; all others come last.
LAYERS = {"phy": 1, "physical": 1, "eth": 2, "ethernet": 2, "ip": 3, "ipv4": 3, "ipv6": 3, "icmp": 4, "icmp6": 4, "icmpv6": 4, "udp": 4, "tcp": 4, "sctp": 4, "ssl": 5, "tls": 5, "https": 5, "ssh": 5, "http": 6}
OTHER_LAYER = 8
#: Types whose ids need the ids of what they refer to.
DEFERRED = ("network-traffic", "file", "email-message", "process")
TARGETS = ("dst", "destination", "target")


def column_name(target: dict) -> str:
    """`object#type:property` for a target's key; parts with a dash are quoted; keys without a type are the observation's."""
    first, *rest = target["key"].split(".")
    parts = [f"'{p}'" if "-" in p else p for p in rest]
    if not target.get("cybox", True):
        return "observed-data:" + ".".join([first, *parts])
    if not parts:
        return f"observed-data:{first}"
    return (f"{target['object']}#" if "object" in target else "") + f"{first}:{'.'.join(parts)}"


def targets_of(mapping: dict, field: str) -> list[dict]:
    """The targets of a native field, found by its name or, level by level, by its dotted parts."""
    found = mapping.get(field)
    if found is None:
        found = mapping
        for part in field.split("."):
            found = found.get(part) if isinstance(found, dict) else None
    if isinstance(found, dict):
        return [found] if isinstance(found.get("key"), str) else []
    return found or []


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested fields as dotted columns."""
    out: list[SparkColumn] = []

    def walk(schema: T.StructType, path: list[str]) -> None:
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, [*path, f.name])
            else:
                out.append(F.col(quoted(*path, f.name)).alias(".".join([*path, f.name])))

    walk(df.schema, [])
    return df.select(*out)


def read_events(spark: SparkSession, events: object) -> DataFrame:
    """Events as rows: a DataFrame, a path of JSON lines, or a list of dicts."""
    if isinstance(events, DataFrame):
        return flat_columns(events)
    if isinstance(events, str):
        return flat_columns(spark.read.json(events))
    lines = spark.createDataFrame([(json.dumps(e),) for e in events], "value string")
    schema = spark.read.json(lines.rdd.map(lambda r: r[0])).schema if events else T.StructType([])
    return flat_columns(lines.select(F.from_json("value", schema).alias("v")).select("v.*"))


def protocols(value: SparkColumn, dtype: T.DataType) -> SparkColumn:
    """Protocol names in lower case, without empty ones, by layer."""
    if not isinstance(dtype, T.ArrayType):
        return F.array(F.lower(value.cast("string")))
    names = F.transform(F.filter(value, lambda x: x.isNotNull() & (x.cast("string") != "")), lambda x: F.lower(x.cast("string")))
    layer = lambda x: F.coalesce(F.create_map(*[F.lit(v) for kv in LAYERS.items() for v in kv])[x], F.lit(OTHER_LAYER))
    ranked = F.transform(names, lambda x, i: F.struct(layer(x).alias("layer"), i.alias("i"), x.alias("name")))
    return F.transform(F.array_sort(ranked), lambda x: x["name"])


def transformed(value: SparkColumn, dtype: T.DataType, name: str, transformers: dict) -> SparkColumn:
    if name == "ToInteger":
        return value.cast("string").try_cast("bigint")
    if name == "EpochToTimestamp":
        return F.date_format(F.timestamp_millis(value.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if name in ("FilterIPv4List", "FilterIPv6List") or name not in transformers:
        return value
    change = transformers[name].transform

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:  # a user's own function of one value, on Arrow batches
        made = (v if v is None else change(v) for v in values.to_pylist())
        return pa.array([v if v is None or isinstance(v, str) else json.dumps(v) for v in made], pa.string())

    return run(value)


class _Plan:
    """Column expressions under their target names; a second expression for a name fills where the first is null."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.out: dict[str, SparkColumn] = {}
        self.groups: dict[str, list[tuple[SparkColumn, T.DataType]]] = {}
        self.refs: dict[str, object] = {}
        self.copies: dict[str, list[str]] = {}
        self.constants: dict[str, object] = {}

    def put(self, name: str, value: SparkColumn) -> None:
        self.out[name] = F.coalesce(self.out[name], value) if name in self.out else value


def translate(spark: SparkSession, mapping: dict, transformers: dict, events: object, identity: dict) -> DataFrame:
    """The wide frame of the events. Fields without a target, and those that are null in all events, are left out."""
    df = read_events(spark, events)
    if not df.columns:
        return spark.createDataFrame([], "`observed-data:id` string")
    sizes = [F.max(F.size(quoted(c)) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(quoted(c)).isNotNull().cast("int")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    longest = dict(zip(df.columns, df.agg(*sizes).first(), strict=True))  # one row: how long lists get, what is there at all
    plan = _Plan(df)
    for field in df.columns:
        if (longest[field] or 0) > 0:
            _field(plan, df, field, targets_of(mapping, field), transformers, longest[field])
    for name, parts in plan.groups.items():
        lists = [v if isinstance(t, T.ArrayType) else F.array(v) for v, t in parts]
        plan.put(name, F.filter(reduce(lambda a, b: F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lists) if len(lists) > 1 else lists[0], lambda x: x.isNotNull()))
    for name, value in plan.constants.items():
        plan.out[name] = F.lit(value)
    at = now()
    fixed = {"observed-data:id": F.concat(F.lit("observed-data--"), F.uuid()), "observed-data:created_by_ref": F.lit(identity["id"]), "observed-data:created": F.lit(at), "observed-data:modified": F.lit(at)}
    if "observed-data:number_observed" not in plan.out:
        fixed["observed-data:number_observed"] = F.lit(1).cast("long")
    wide = df.select(*[v.alias(n) for n, v in (plan.out | fixed).items()])
    return _with_ids(wide, plan)


def _field(plan: _Plan, df: DataFrame, field: str, targets: list[dict], transformers: dict, size: int) -> None:
    raw, dtype = F.col(quoted(field)), plan.types[field]
    for n, target in enumerate(targets):
        name = column_name(target)
        value, kind = raw, dtype
        if name.endswith(("_ref", "_refs")):
            plan.refs[name] = target["references"]
            continue
        if "value" in target and "transformer" not in target:
            plan.constants[name] = target["value"]
            continue
        if target.get("transformer") == "ToLowercaseArray" and name.endswith("network-traffic:protocols"):
            if not target.get("group"):
                value, kind = protocols(raw, dtype), T.ArrayType(T.StringType())
        elif "transformer" in target:
            value = transformed(raw, dtype, target["transformer"], transformers)
            if target["transformer"] not in ("FilterIPv4List", "FilterIPv6List"):
                kind = T.StringType()
        if target.get("group") and n == 0:
            plan.groups.setdefault(name, []).append((value, kind))
            continue
        if target.get("unwrap") and isinstance(dtype, T.ArrayType):
            obj, _, rest = name.rpartition("#")
            for i in range(size):
                _address(plan, f"{obj}_{i}#{rest}" if obj else f"{i}#{rest}", F.get(raw, F.lit(i)))
            plan.copies.setdefault(obj, [f"{obj}_{i}" for i in range(size)])
            continue
        _address(plan, name, value)


def _address(plan: _Plan, name: str, value: SparkColumn) -> None:
    """A field mapped to both kinds of address goes where its form belongs."""
    if name.endswith("ipv4-addr:value"):
        value = F.when(value.cast("string").contains("."), value)
    elif name.endswith("ipv6-addr:value"):
        value = F.when(value.cast("string").contains(":"), value)
    plan.put(name, value)


def _objects(columns: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(c.partition(":")[0], []).append(c)
    return out


def _with_ids(wide: DataFrame, plan: _Plan) -> DataFrame:
    """Ids of all objects and the references between them: first the types that need no other's id, then the others.

    A reference is the first id that isn't null among those of the objects of its name (an object may be an address of either kind); a list has all of them."""
    objects = _objects(wide.columns)
    ids: dict[str, list[str]] = {}

    def give(keys: list[str], df: DataFrame) -> DataFrame:
        made = {}
        for key in keys:
            name, _, kind = key.rpartition("#")
            made[f"{key}:id"] = object_id(df, kind, [c for c in df.columns if c.startswith(f"{key}:")], f"{key}:")
            ids.setdefault(name, []).append(f"{key}:id")
        return df.select("*", *[v.alias(n) for n, v in made.items()]) if made else df

    def resolve(df: DataFrame, wanted: Callable[[str], bool]) -> DataFrame:
        made = {}
        for ref, value in plan.refs.items():
            key = ref.partition(":")[0]
            if key not in objects or not wanted(key) or ref in df.columns:
                continue
            names = [m for v in (value if isinstance(value, list) else [value]) for m in plan.copies.get(v, [v])]
            found = [i for m in names for i in ids.get(m, []) if i in df.columns]
            if not found:
                continue
            columns = [F.col(quoted(c)) for c in found]
            if isinstance(value, list):
                listed = F.array_compact(F.array(*columns))
                made[ref] = F.when(F.size(listed) > 0, listed)
            else:
                made[ref] = F.coalesce(*columns)
        return df.select("*", *[v.alias(n) for n, v in made.items()]) if made else df

    first = [k for k in objects if k != "observed-data" and k.rpartition("#")[2] not in DEFERRED]
    later = [k for kind in DEFERRED[::-1] for k in objects if k.rpartition("#")[2] == kind]
    wide = resolve(give(first, wide), lambda k: True)
    for key in sorted(later, key=lambda k: (k.rpartition("#")[2] in ("process", "network-traffic"), k.rpartition("#")[2] == "process")):
        wide = resolve(give([key], wide), lambda k: True)
    return wide


def object_id(df: DataFrame, kind: str, columns: list[str], prefix: str) -> SparkColumn:
    """type--uuid5 of the contributing properties, random without any; null where the whole object is null."""
    plain = {c[len(prefix) :]: c for c in columns}
    counted = sorted(p for p in CONTRIBUTING.get(kind, ()) if p in plain)
    there = reduce(lambda a, b: a | b, [F.col(quoted(c)).isNotNull() for c in columns])
    random = F.concat(F.lit(f"{kind}--"), F.uuid())
    if not counted:
        return F.when(there, random)
    some = reduce(lambda a, b: a | b, [F.col(quoted(plain[p])).isNotNull() for p in counted])
    text = F.replace(F.to_json(F.struct(*[F.col(quoted(plain[p])).alias(p) for p in counted])), F.lit("/"), F.lit("\\/"))
    return F.when(some, F.concat(F.lit(f"{kind}--"), uuid5(text, str(NAMESPACE)))).when(there, random)


def ingest(store, identity: dict, wide: DataFrame, query_id: str) -> None:
    """Writes a wide frame's objects, what contains them, and their lists of references into a session's tables."""
    spark = wide.sparkSession
    staged = f"{store.folder}/staged/{uuid.uuid4().hex}"
    wide.write.parquet(staged)  # random ids are made once
    fs, path = store._fs(staged)
    try:
        wide = spark.read.schema(wide.schema).parquet(staged)
        store._merge(spark.createDataFrame([("identity", identity["id"], json.dumps({k: v for k, v in identity.items() if k != "type"}), {k: f"s{k}" for k in identity if k != "type"}, 0)], ROWS), query_id)
        by_type: dict[str, DataFrame] = {}
        edges, lists = [], []
        for key, columns in _objects(wide.columns).items():
            name, _, kind = key.rpartition("#")
            kind = kind or key
            prefix = f"{key}:"
            if f"{prefix}id" not in columns:
                continue
            rows = wide.where(F.col(quoted(f"{prefix}id")).isNotNull())
            plain = [c for c in columns if not c.endswith("_refs")]
            shown = []
            for c in plain:
                value = F.col(quoted(c))
                if isinstance(wide.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
                    value = F.to_json(value)
                elif isinstance(wide.schema[c].dataType, T.IntegerType):
                    value = value.cast("long")
                path_ = c[len(prefix) :]
                shown.append(value.alias(short_name(path_)))
                store.paths.setdefault(kind, {}).setdefault(short_name(path_), path_)
            table = rows.select(*shown).withColumn("seq", F.lit(0).cast("long"))
            by_type[kind] = table if kind not in by_type else by_type[kind].unionByName(table, allowMissingColumns=True)
            if kind == "observed-data":
                continue
            rank = 0 if name.startswith(TARGETS) else 1
            edges.append(rows.select(F.col(quoted("observed-data:id")).alias("source_ref"), F.col(quoted(f"{prefix}id")).alias("target_ref"), F.lit(rank).cast("long").alias(RANK)))
            for c in columns:
                if c.endswith("_refs"):
                    lists.append(rows.select(F.lit(c[len(prefix) :]).alias("ref_name"), F.col(quoted(f"{prefix}id")).alias("source_ref"), F.explode(F.col(quoted(c))).alias("target_ref")))
        tags = [t.select(F.col("id").alias("sco_id"), F.lit(str(query_id)).alias("query_id")) for t in by_type.values()]
        edge_tables = {"__queries": tags, "__contains": edges, "__reflist": lists}
        store._absorb_all(by_type | {name: reduce(lambda a, b: a.unionByName(b), parts) for name, parts in edge_tables.items() if parts})
        store._save()
    finally:
        fs.delete(path, True)
