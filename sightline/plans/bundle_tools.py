"""Utilities over bundles: new ids, repeated ids, limits, upgrades, shifted times. Objects are rows (object: JSON text, seq)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import make_id
from ..knowledge import TIMESTAMPS

_OBJECT = pa.schema([("object", pa.string()), ("seq", pa.int64())])


def repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with `again`: whether an earlier row (by order) has the key too. Only a key's least order is aggregated and joined, so no key's rows meet in one task."""
    first = df.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("again", F.col(order) > F.col("__first")).drop("__key", "__first")


def shifted(df: DataFrame, column: str, start: str, end: str, name: str) -> DataFrame:
    """df with a timestamp mapped from its own range to [start, end]. The range is one row, broadcast."""
    micros = F.unix_micros(F.col(column).cast("timestamp"))
    ends = df.agg(F.min(micros).alias("__lo"), F.max(micros).alias("__hi"))
    lo, hi = (F.unix_micros(F.to_timestamp(F.lit(x))) for x in (start, end))
    place = (micros - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / (hi - lo))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.timestamp_micros((lo + place).cast("long"))).drop("__lo", "__hi")


def _each(objects: DataFrame, change) -> DataFrame:
    """Objects after a Python function of an object, which returns a list of objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seqs = [], []
            for text, seq in zip(batch.column("object").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                for obj in change(json.loads(text)):
                    texts.append(json.dumps(obj))
                    seqs.append(seq)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(seqs, pa.int64())], schema=_OBJECT)

    return objects.select("object", "seq").mapInArrow(run, "object string, seq long")


def limit(objects: DataFrame, n: int) -> DataFrame:
    """The identity and the first n observations."""
    return objects.orderBy("seq").limit(n + 1)


def randomize_ids(objects: DataFrame) -> DataFrame:
    """Every object gets a new random id; the first identity becomes the creator of all observations."""
    creator = f"identity--{uuid.uuid4()}"
    first = objects.where(F.get_json_object("object", "$.type") == "identity").agg(F.min("seq")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, seq in zip(batch.column("object").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                obj = json.loads(text)
                obj["id"] = creator if seq == first else f"{obj['type']}--{uuid.uuid4()}"
                if "created_by_ref" in obj and first is not None:
                    obj["created_by_ref"] = creator
                texts.append(json.dumps(obj))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("seq")], schema=_OBJECT)

    return objects.select("object", "seq").mapInArrow(run, "object string, seq long")


def dedup_ids(objects: DataFrame) -> DataFrame:
    """The second and further objects of an id get new ones."""
    marked = repeats(objects.withColumn("__id", F.get_json_object("object", "$.id")), "__id", "seq")

    def renamed(obj: dict) -> list[dict]:
        return [obj | {"id": f"{obj['type']}--{uuid.uuid4()}"}]

    return marked.where("not again").select("object", "seq").union(_each(marked.where("again"), renamed))


def _upgraded(obj: dict) -> list[dict]:
    """A 2.0 observation as one of version 2.1 and its objects."""
    objects = obj.get("objects")
    if objects is None:
        return [obj]
    ids = {k: o.get("id") or make_id(o, obj) for k, o in objects.items()}
    out = []
    for key, o in objects.items():
        new = {"type": o["type"], "spec_version": "2.1", "id": ids[key]}
        for prop, value in o.items():
            prop = "image_ref" if prop == "binary_ref" else prop
            if prop.endswith("_refs"):
                found = [ids[v] for v in (value if isinstance(value, list) else [value]) if v in ids]
                if found:
                    new[prop] = found
            elif prop.endswith("_ref"):
                new[prop] = ids.get(value, value)
            else:
                new.setdefault(prop, value)
        out.append(new)
    plain = {k: v for k, v in obj.items() if k != "objects"}
    return [plain | {"spec_version": "2.1", "object_refs": list(dict.fromkeys(ids.values()))}, *out]


def upgrade(objects: DataFrame) -> DataFrame:
    return _each(objects, _upgraded)


def timeshift(objects: DataFrame, start: str, end: str) -> DataFrame:
    """Observations' times, and those of their objects, mapped linearly from the range of first_observed to [start, end]."""
    from dateutil.parser import parse

    kind, first = F.get_json_object("object", "$.type"), F.get_json_object("object", "$.first_observed")
    ends = objects.where(kind == "observed-data").agg(F.min(first), F.max(first)).first()
    if ends[0] is None:
        return objects
    lo, hi, new_lo, new_hi = parse(ends[0]), parse(ends[1]), parse(start), parse(end)
    scale = (new_hi - new_lo) / (hi - lo) if hi > lo else 0.0

    def move(text: str, digits: int) -> str:
        t = new_lo + (parse(text) - lo) * scale
        return t.strftime("%Y-%m-%dT%H:%M:%S.%f")[: 20 + digits] + "Z"

    def change(obj: dict) -> list[dict]:
        if obj.get("type") != "observed-data":
            return [obj]
        long = parse(obj["last_observed"]) - parse(obj["first_observed"])
        begin = new_lo + (parse(obj["first_observed"]) - lo) * scale
        text = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.%f")[:23] + "Z"
        obj |= {"first_observed": text(begin), "last_observed": text(begin + long * scale)}
        for o in obj.get("objects", {}).values():
            o.update({p: move(v, 6) for p, v in o.items() if p in TIMESTAMPS and isinstance(v, str)})
        return [obj]

    return _each(objects, change)


def as_bundle(objects: DataFrame, version: str = "2.0") -> dict:
    """The objects, in their order, as one bundle on the driver; for results of a size to be printed."""
    return {"type": "bundle", "id": f"bundle--{uuid.uuid4()}", "spec_version": version, "objects": [json.loads(r["object"]) for r in objects.orderBy("seq").collect()]}


def write_objects(objects: DataFrame, path: str) -> None:
    """Objects as JSON lines, partitioned by type."""
    objects.select(F.get_json_object("object", "$.type").alias("type"), F.col("object").alias("value")).write.partitionBy("type").text(path)


