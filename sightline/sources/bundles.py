"""Observation bundles as rows: reading JSON, flattening observations of versions 2.0 and 2.1, typing columns."""

from __future__ import annotations

import http.client
import json
import re
import urllib.request
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidObject
from ..functions.ids import make_id

RANK = "x_rank"
#: Columns with a type of their own, whatever value comes first.
FIXED_TYPES = {"number_observed": "bigint", "src_port": "bigint", "dst_port": "bigint", RANK: "bigint", "ipfix.flowId": "string", "id": "string"}
#: Tables that are there from the beginning, and their columns.
BOOTSTRAP = {
    "identity": ("id", "identity_class", "name", "created", "modified"),
    "observed-data": ("id", "created_by_ref", "created", "modified", "first_observed", "last_observed", "number_observed"),
}
LONGEST_NAME = 48
ROWS = "type string, id string, body string, kinds map<string,string>, seq bigint"
_ROWS = pa.schema([("type", pa.string()), ("id", pa.string()), ("body", pa.string()), ("kinds", pa.map_(pa.string(), pa.string())), ("seq", pa.int64())])
KINDS = {"i": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "s": T.StringType(), "j": T.StringType()}


def normalize(obj: dict, flat_lists: bool = False, prefix: str = "", inside: str | None = None) -> dict:
    """Nested objects as dotted paths; a part with a dash is quoted. Objects of custom (x-) types keep what is nested in them, but for extensions."""
    kind = obj.get("type", "") if inside is None or "type" in obj else inside
    custom = isinstance(kind, str) and kind.startswith("x-")
    out: dict = {}
    for key, value in obj.items():
        name = f"'{key}'" if "-" in key else key
        path = f"{prefix}{name}"
        if isinstance(value, dict) and (not custom or key == "extensions"):
            out.update(normalize(value, flat_lists, f"{path}.", ""))
        elif flat_lists and isinstance(value, list):
            for i, item in enumerate(value):
                if isinstance(item, dict):
                    out.update(normalize(item, flat_lists, f"{path}[{i}].", ""))
                else:
                    out[f"{path}[{i}]"] = item
        else:
            out[path] = value
    return out


def short_name(path: str) -> str:
    """Column name of a path: an extension's properties, and long names, begin with x_."""
    if len(path) > LONGEST_NAME or "extensions." in path:
        return re.sub(r"^extensions\.'(x-)?[\w-]+'\.", "x_", path)
    return path


def _edges(source: str, name: str, value: object) -> Iterator[dict]:
    for ref in value if isinstance(value, list) else [value]:
        if str(ref) != source:
            yield {"type": "__reflist", "ref_name": name, "source_ref": source, "target_ref": str(ref)}


def flatten(obj: dict) -> list[dict]:
    """The rows of one object: itself with plain columns, and edges."""
    if obj.get("spec_version") == "2.1" or "object_refs" in obj:
        return _flatten_refs(obj)
    return _flatten_observation(obj) if "objects" in obj else [obj if obj.get("type") == "identity" else normalize(obj)]


def _flatten_refs(obj: dict) -> list[dict]:
    """Version 2.1: references are ids already."""
    oid, kind = str(obj["id"]), obj["type"]
    if kind == "identity":
        return [obj | {"id": oid}]
    if kind == "observed-data":
        plain = {k: v for k, v in obj.items() if k != "object_refs"}
        return [{"type": "__contains", "source_ref": oid, "target_ref": str(r)} for r in obj.get("object_refs", [])] + [normalize(plain | {"id": oid})]
    out, plain = [], {"id": oid}
    for key, value in obj.items():
        if key.endswith("_refs"):
            out.extend(_edges(oid, key, value))
        elif key != "id":
            plain[key] = str(value) if key.endswith("_ref") else value
    return [*out, normalize(plain)]


class _Graph:
    """The objects of a 2.0 observation, which refer to each other by their keys, and which of them are not roots."""

    def __init__(self, objects: dict[str, dict]):
        self.objects = objects
        self.flat = {k: normalize(o) for k, o in objects.items()}
        self.preferred: dict[str, list[str]] = defaultdict(list)
        self.below: set[str] = set()
        for key, flat in self.flat.items():
            self.preferred[flat["type"]].append(key)
            for prop, value in flat.items():
                self._look(key, flat["type"], prop, value)

    def _look(self, key: str, kind: str, prop: str, value: object) -> None:
        if prop.endswith("_refs"):
            self.below.update(v for v in self._keys(value) if v != key and v in self.objects and self.objects[v]["type"] == kind)
        elif prop.endswith("_ref") and isinstance(value, str) and value in self.objects and value != key:
            target = self.objects[value]["type"]
            if target == kind:
                self._sink(value)
            elif target.endswith("-addr"):
                if "dst_" in prop:
                    self.below.add(value)
                elif prop.endswith("src_ref"):
                    self.preferred[target].insert(0, value)
            elif value in self.below:
                self.below.add(key)

    @staticmethod
    def _keys(value: object) -> list[str]:
        return [str(v) for v in (value if isinstance(value, list) else [value])]

    def _sink(self, key: str) -> None:
        """Whatever can be reached from here is no root."""
        waiting, seen = [key], set()
        while waiting:
            k = waiting.pop()
            if k in seen:
                continue
            seen.add(k)
            for prop, value in self.objects[k].items():
                if prop.endswith(("_ref", "_refs")):
                    waiting += [v for v in self._keys(value) if v in self.objects and v != k]
        self.below |= seen

    def roots(self) -> set[str]:
        """Of each type the first object in order of preference that isn't below another."""
        first = (next((k for k in keys if k not in self.below), None) for keys in self.preferred.values())
        return {k for k in first if k is not None}


def _flatten_observation(obs: dict) -> list[dict]:
    graph = _Graph(obs["objects"])
    ids = {k: make_id(o, obs) for k, o in obs["objects"].items()}
    last = {i: k for k, i in ids.items()}
    ranked = graph.roots()
    out = []
    for key, flat in graph.flat.items():
        row = {}
        for prop, value in flat.items():
            if prop.endswith("_refs"):
                out.extend({"type": "__reflist", "ref_name": prop, "source_ref": ids[key], "target_ref": ids[v]} for v in graph._keys(value) if v in ids and v != key)
            elif prop.endswith("_ref"):
                if value in ids:
                    row[prop] = ids[value]
            else:
                row[prop] = value
        edge = {"type": "__contains", "source_ref": obs["id"], "target_ref": ids[key]}
        out.append(edge | ({RANK: 1} if last[ids[key]] in ranked else {}))
        out.append(row | {"id": ids[key]})
    return [*out, normalize({k: v for k, v in obs.items() if k != "objects"})]


def _kind(value: object) -> str:
    if isinstance(value, bool):
        return "b"
    if isinstance(value, int):
        return "i" if -(1 << 63) <= value < 1 << 63 else "s"
    return "f" if isinstance(value, float) else "j" if isinstance(value, (list, dict)) else "s"


def as_row(obj: dict, seq: int) -> tuple:
    """(type, id, body, kinds, seq): body is JSON with lists and objects as JSON text; kinds tell what each value was."""
    kind = obj.get("type")
    if not kind and isinstance(obj.get("id"), str):
        kind = obj["id"].rpartition("--")[0]
    if not kind:
        raise InvalidObject("missing or empty `type`")
    body, kinds = {}, {}
    for key, value in obj.items():
        if key in ("type", "spec_version"):
            continue
        name = short_name(key)
        k = _kind(value)
        body[name] = json.dumps(value, separators=(",", ":"), ensure_ascii=False) if k == "j" else str(value) if k == "s" and value is not None else value
        kinds[name] = f"{k}{key}"
    return kind, body.get("id"), json.dumps(body, ensure_ascii=False), list(kinds.items()), seq


def whole_objects(text: str) -> Iterator[str]:
    """The objects of a bundle's text, as far as it goes: a text that breaks off gives those that came whole."""
    start = re.search(r'"objects"\s*:\s*\[', text)
    decoder, at = json.JSONDecoder(), start.end() if start else len(text)
    while at < len(text):
        at = re.compile(r"[\s,]*").match(text, at).end()
        try:
            _, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            return
        yield text[at:end]
        at = end


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, text in zip(batch.column("base").to_pylist(), batch.column("value").to_pylist(), strict=True):
            found = list(whole_objects(text))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(range(base, base + len(found)), pa.int64())], names=["object", "seq"])


def download(url: str, chunk: int = 8192) -> str:
    """A bundle's text over HTTP, in chunks; a transfer that breaks off gives what came."""
    parts: list[bytes] = []
    with urllib.request.urlopen(url) as response:
        try:
            while part := response.read(chunk):
                parts.append(part)
        except (OSError, http.client.IncompleteRead) as e:
            parts.append(getattr(e, "partial", b""))
    return b"".join(parts).decode(errors="ignore")


def _downloaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for url, base in zip(batch.column("url").to_pylist(), batch.column("base").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([download(url)]), pa.array([base], pa.int64())], names=["value", "base"])


def _plain(uri: SparkColumn | str) -> SparkColumn | str:
    """A file's address with one slash behind the scheme, as different readers write it differently."""
    return re.sub("^([a-z0-9]+):/+", r"\1:/", uri) if isinstance(uri, str) else F.regexp_replace(uri, "^([a-z0-9]+):/+", "$1:/")


def _read_texts(spark: SparkSession, paths: dict[str, int], whole: bool) -> DataFrame:
    """(value, base) of the paths: the files among them by one reader, a folder or pattern by one each."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, frames = {}, []
    for path, base in paths.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if len(paths) > 1 and fs.exists(p) and fs.getFileStatus(p).isFile():
            files[path] = (_plain(fs.makeQualified(p).toUri().toString()), base)
        else:
            frames.append(spark.read.text(path, wholetext=whole).select("value", F.lit(base).cast("long").alias("base")))
    if files:
        bases = spark.createDataFrame(list(files.values()), "file string, base long")
        frames.append(spark.read.text(list(files), wholetext=whole).select("value", _plain(F.col("_metadata.file_path")).alias("file")).join(F.broadcast(bases), "file").select("value", "base"))
    return reduce(DataFrame.union, frames)


def read_objects(spark: SparkSession, sources: object, types: Iterable[str] | None = None, partial: bool = False) -> DataFrame:
    """(object, seq): JSON text of each object of the bundles, in their order; sources: paths, http(s) addresses, dicts or a list of them.

    A file holds one bundle, or, named .jsonl, an object in each line. Files that are no bundle give nothing. partial: texts may break off (downloads always may). Addresses are read by the tasks."""
    listed = sources if isinstance(sources, (list, tuple)) else [sources]
    dicts, urls, lines, files = [], [], {}, {}
    for n, source in enumerate(listed):
        base = n << 40
        if isinstance(source, dict):
            dicts.append((json.dumps(source), base))
        elif str(source).startswith(("http://", "https://")):
            urls.append((str(source), base))
        else:
            (lines if str(source).endswith(".jsonl") else files)[str(source)] = base
    frames, broken = [], []
    if dicts:
        frames.append(spark.createDataFrame(dicts, "value string, base long"))
    if lines:
        frames.append(_read_texts(spark, lines, False).select(F.concat(F.lit('{"objects":['), "value", F.lit("]}")).alias("value"), (F.col("base") + F.monotonically_increasing_id()).alias("base")))
    if files:
        (broken if partial else frames).append(_read_texts(spark, files, True))
    if urls:
        broken.append(spark.createDataFrame(urls, "url string, base long").repartition(len(urls)).mapInArrow(_downloaded, "value string, base long"))
    out = spark.createDataFrame([], "object string, seq long")
    if broken:
        out = reduce(DataFrame.union, broken).mapInArrow(_partial, "object string, seq long")
    if frames:
        whole = reduce(DataFrame.union, frames).select("base", F.posexplode(F.from_json("value", "struct<objects:array<string>>")["objects"]).alias("pos", "object")).select("object", (F.col("base") + F.col("pos")).alias("seq"))
        out = out.union(whole) if broken else whole
    return out.where(F.get_json_object("object", "$.type").isin(*types)) if types else out


def flatten_rows(objects: DataFrame) -> DataFrame:
    """(object, seq) -> ROWS; each observation is a small graph of its own, flattened within its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, seq in zip(batch.column("object").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                obj = json.loads(text)
                if not obj.get("type") and "--" in str(obj.get("id", "")):
                    obj["type"] = str(obj["id"]).rpartition("--")[0]
                if not obj.get("type"):
                    raise InvalidObject("missing or empty `type`")
                rows.extend(as_row(row, seq) for row in flatten(obj))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)

    return objects.mapInArrow(run, ROWS)


def column_kinds(rows: DataFrame) -> dict[str, dict[str, tuple[str, str]]]:
    """For each type its columns, in order of first sight: name -> (kind of the first value, full path). The driver gets one row a column."""
    seen = rows.select("type", "seq", F.explode("kinds").alias("name", "kind"))
    seen = seen.groupBy("type", "name").agg(F.min_by("kind", "seq").alias("kind"), F.min("seq").alias("seq"))
    out: dict[str, dict[str, tuple[str, str]]] = defaultdict(dict)
    for r in seen.orderBy("type", "seq", "name").collect():
        out[r["type"]][r["name"]] = (r["kind"][0], r["kind"][1:])
    return dict(out)


def typed(rows: DataFrame, sco_type: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows of a type with their columns, and seq; a value of another kind than its column's first becomes that kind or null."""
    fields = []
    for name, (kind, _) in columns.items():
        fixed = FIXED_TYPES.get(name)
        fields.append(T.StructField(name, T._parse_datatype_string(fixed) if fixed else KINDS[kind]))
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    parsed = rows.where(F.col("type") == sco_type).select(F.from_json("body", raw).alias("v"), "seq")
    return parsed.select(*[F.col("v").getField(f.name).try_cast(f.dataType).alias(f.name) for f in fields], "seq")
