"""A session: type tables, edge tables, and named views that are plans over them.

A table is a base of parquet and a few increments over it, in the session's folder: a merge writes only the rows that it changes, and an increment's rows replace
those of their ids in what lies below. After DELTAS increments the table is written anew. Nothing is changed in place, so plans made before keep
reading what they were made of. Views are definitions that look names up when they are used: redefining one changes those that build on it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DatabaseMismatch, IncompatibleType, InvalidAttr, InvalidObject, SessionExists, SessionNotFound, UnknownViewname
from ..functions.ids import make_id
from ..knowledge import auto_agg, parse_prop, primary_prop, prop_metadata
from ..names import check_name, check_path, quoted
from ..operators.paths import dereference, path_joins, unresolve
from ..operators.pattern import Compiler
from ..operators.query import Aggregation, BinnedColumn, Column, Filter, Group, Join, Limit, Order, Predicate, Projection, Query, Table
from ..sources import bundles
from . import codec, upsert

VERSION = "2.2"
PRIVATE = ("__contains", "__reflist", "__queries")
EDGE = ("ref_name", "source_ref", "target_ref", "sco_id", "query_id")
DELTAS = 6
#: Tables that are merged at a time.
AT_A_TIME = 8


@codec.known
@dataclass
class Extract:
    """Rows of a type that came with a query and satisfy a pattern."""

    sco_type: str
    query_id: str
    pattern: str

    def build(self, store: Store) -> DataFrame:
        df = store.type_table(self.sco_type)
        tags = store.stored("__queries")
        if df is None or tags is None:
            return store.spark.createDataFrame([], "id string")
        df = df.join(tags.where(F.col("query_id") == str(self.query_id)).select(F.col("sco_id")), F.col("id") == F.col("sco_id"), "left_semi")
        return store.matching(df, self.sco_type, self.pattern)


@codec.known
@dataclass
class Filtered:
    source: object
    sco_type: str
    pattern: str

    def build(self, store: Store) -> DataFrame:
        return store.matching(self.source.build(store), self.sco_type, self.pattern)


@codec.known
@dataclass
class Joined:
    left: object
    left_on: str
    right: object
    right_on: str

    def build(self, store: Store) -> DataFrame:
        a, b = self.left.build(store), self.right.build(store)
        for df, on in ((a, self.left_on), (b, self.right_on)):
            if on not in df.columns:
                raise InvalidAttr(on)
        both = a.alias("a").join(b.alias("b"), F.col(quoted("a", self.left_on)) == F.col(quoted("b", self.right_on)))
        left = [F.coalesce(F.col(quoted("a", c)), F.col(quoted("b", c))).alias(c) if c in b.columns else F.col(quoted("a", c)) for c in a.columns]
        return both.select(*left, *[F.col(quoted("b", c)) for c in b.columns if c not in a.columns])


@codec.known
@dataclass
class Merged:
    sources: list

    def build(self, store: Store) -> DataFrame:
        out = self.sources[0].build(store)
        for s in self.sources[1:]:
            out = out.unionByName(s.build(store), allowMissingColumns=True)
        return out.distinct()


@codec.known
@dataclass
class Named:
    """Whatever the name stands for when it is used."""

    name: str

    def build(self, store: Store) -> DataFrame:
        return store.relation(self.name)


@codec.known
@dataclass
class Queried:
    query: Query
    inlined: dict

    def build(self, store: Store) -> DataFrame:
        return self.query.to_df(lambda name: self.inlined[name].build(store) if name in self.inlined else store.relation(name))


@codec.known
@dataclass
class View:
    sco_type: str | None
    definition: object
    appdata: object = None


class Store:
    def __init__(self, spark: SparkSession, path: str | None = None, session_id: str = "session", *, attach: bool | None = None, ignore_case: bool = False, sum_on_recache: bool = False):
        """attach: True to need an existing session, False to need a new one. ignore_case: whether LIKE in patterns ignores case.
        sum_on_recache: whether an observation that comes again is merged into the first rather than ignored."""
        self.spark, self.session_id, self.ignore_case, self.sum_on_recache = spark, check_name(session_id), ignore_case, sum_on_recache
        root = path or spark.conf.get("spark.sql.warehouse.dir")
        self.folder = f"{str(root).rstrip('/')}/{session_id}"
        self.versions: dict[str, list[str]] = {}
        self.views: dict[str, View] = {}
        self.paths: dict[str, dict[str, str]] = {}
        self.number = 0
        found = self._load()
        if attach and not found:
            raise SessionNotFound(session_id)
        if attach is False and found:
            raise SessionExists(session_id)
        if not found:
            for name, columns in bundles.BOOTSTRAP.items():
                self._put(name, spark.createDataFrame([], ", ".join(f"`{c}` {bundles.FIXED_TYPES.get(c, 'string')}" for c in columns)), save=False)
            self._save()

    # Stored state

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _catalogs(self) -> list[tuple[int, str]]:
        """(number, path) of the catalogs in the folder, oldest first. A catalog has its name only when it is whole."""
        fs, folder = self._fs(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((int(m[1]), f"{self.folder}/{n}") for n in names if (m := re.fullmatch(r"catalog\.(\d+)\.json", n)))

    def _load(self) -> bool:
        found = self._catalogs()
        if not found:
            return False
        self.number, path = found[-1]
        state = json.loads("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))
        if state["version"] != VERSION:
            raise DatabaseMismatch(state["version"], VERSION)
        self.versions, self.paths = state["tables"], state["paths"]
        self.views = codec.decode(state["views"])
        return True

    def _save(self) -> None:
        """Writes the next catalog under another name, then names it; the one before stays until then. Names are given once, so a second writer fails."""
        state = json.dumps({"version": VERSION, "tables": self.versions, "paths": self.paths, "views": codec.encode(self.views)})
        fs, path = self._fs(f"{self.folder}/catalog.{self.number + 1:09d}.json")
        _, new = self._fs(f"{self.folder}/new.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(state.encode()))
        out.close()
        if fs.exists(path) or not fs.rename(new, path):
            raise SessionExists(f"{self.session_id}: another writer has changed it")
        self.number += 1
        for number, old in self._catalogs():
            if number < self.number - 1:
                fs.delete(self._fs(old)[1], False)

    def _write(self, name: str, df: DataFrame) -> str:
        where = f"{self.folder}/tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(where)
        return where

    def _put(self, name: str, df: DataFrame, save: bool = True) -> None:
        """The whole table anew."""
        self.versions[name] = [self._write(name, df)]
        if save:
            self._save()

    def _add(self, name: str, df: DataFrame) -> None:
        """An increment; when they get many, the table is written anew."""
        self.versions[name] = [*self.versions.get(name, []), self._write(name, df)]
        if len(self.versions[name]) > DELTAS:
            self._put(name, self.stored(name), save=False)

    def stored(self, name: str) -> DataFrame | None:
        if name not in self.versions:
            return None
        base, *increments = [self.spark.read.parquet(p) for p in self.versions[name]]
        for newer in increments:
            kept = base if name in PRIVATE else base.join(newer.select("id"), "id", "left_anti")
            base = kept.unionByName(newer, allowMissingColumns=True)
        return base

    def type_table(self, name: str) -> DataFrame | None:
        return self.stored(name)

    def relation(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name].definition.build(self)
        df = self.stored(name)
        if df is None:
            raise UnknownViewname(name)
        return df

    def matching(self, df: DataFrame, sco_type: str, pattern: str) -> DataFrame:
        return Compiler(self.stored, self.ignore_case).apply(df, sco_type, pattern) if pattern else df

    # Ingest

    def cache(self, query_id: str, sources: object) -> None:
        """Reads bundles (paths, dicts, or a list) under a query id: flattens, types and merges them into the type tables."""
        self._merge(bundles.flatten_rows(bundles.read_objects(self.spark, sources)), query_id)

    def load(self, view: str, objects: list, sco_type: str | None = None, query_id: str | None = None, preserve_ids: bool = True) -> str:
        """Rows, or values of a type's primary property, as a type's objects and a view of them; returns the type."""
        check_name(view)
        query_id = query_id or (objects[0].get("query_id") if isinstance(objects[0], dict) else None) or str(uuid.uuid4())
        rows = []
        for n, obj in enumerate(objects):
            if not sco_type:
                if not isinstance(obj, dict) or "type" not in obj:
                    raise InvalidObject("missing `type`")
                sco_type = obj["type"]
            if isinstance(obj, str):
                obj = {primary_prop(sco_type): obj}
            elif not isinstance(obj, dict):
                raise InvalidObject("neither an object nor a value")
            obj = {"type": sco_type} | obj
            if "id" not in obj or not preserve_ids:
                obj["id"] = make_id(obj)
            rows.append(bundles.as_row(obj, n))
        self._merge(self.spark.createDataFrame([(*r[:3], dict(r[3]), r[4]) for r in rows], bundles.ROWS), str(query_id))
        self.extract(view, sco_type, query_id, "")
        return sco_type

    def _merge(self, rows: DataFrame, query_id: str | None, overwrite: bool = False) -> None:
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        rows.write.partitionBy("type").parquet(staged)
        fs, path = self._fs(staged)
        try:
            rows = self.spark.read.schema(bundles.ROWS).parquet(staged)
            kinds = bundles.column_kinds(rows)
            new = {}
            for sco_type, columns in kinds.items():
                known = self.paths.setdefault(sco_type, {})
                known.update({n: p for n, (_, p) in columns.items() if n not in known})
                new[sco_type] = bundles.typed(rows, sco_type, columns)
            if query_id is not None:
                new["__queries"] = rows.where(~F.col("type").isin(*PRIVATE)).select(F.col("id").alias("sco_id"), F.lit(str(query_id)).alias("query_id"))
            self._absorb_all(new, overwrite)
            self._save()
        finally:
            fs.delete(path, True)

    def _absorb_all(self, new: dict[str, DataFrame], overwrite: bool = False) -> None:
        """Merges rows into several tables at a time: their jobs don't depend on each other."""
        with ThreadPoolExecutor(AT_A_TIME) as pool:
            for done in [pool.submit(self._absorb, name, df, overwrite) for name, df in new.items()]:
                done.result()

    def _absorb(self, name: str, new: DataFrame, overwrite: bool = False) -> None:
        """Merges rows into a table. Edges are added once. Of objects, one row for each id: first and last times and counts combine, of other columns the
        last value that isn't null counts; overwrite: the new row as it is. Only rows of the new ids are read together and written."""
        old = self.stored(name)
        if name in PRIVATE:
            new = new.drop("seq")
            key = [c for c in EDGE if c in new.columns]
            rest = [c for c in new.columns if c not in key]
            new = new.groupBy(*key).agg(*[F.max(quoted(c)).alias(c) for c in rest]) if rest else new.distinct()
            return self._put(name, new, save=False) if old is None else self._add(name, new.join(old.select(*key), key, "left_anti"))
        if old is None:
            return self._put(name, upsert.merged(new, "id", "seq", combine=not overwrite), save=False)
        types = dict(old.dtypes)
        new = new.select(*[F.col(quoted(c)).try_cast(types[c]).alias(c) if c in types and c != "seq" else F.col(quoted(c)) for c in new.columns])
        if name == "observed-data" and not self.sum_on_recache and not overwrite:
            new = new.join(old.select("id"), "id", "left_anti")
        elif not overwrite:
            touched = old.join(new.select("id"), "id", "left_semi")
            new = touched.withColumn("seq", F.lit(-1).cast("long")).unionByName(new, allowMissingColumns=True)
        return self._add(name, upsert.merged(new, "id", "seq", combine=not overwrite))

    def reassign(self, view: str, objects: list[dict]) -> None:
        """Objects with ids replace those in the type tables (what they refer to included); others become what the view holds."""
        check_name(view)
        if not objects:
            return
        if "id" not in objects[0]:
            columns = {k: k for o in objects for k in o if k != "type"}
            rows = [bundles.as_row({"type": view} | {c: o.get(c) for c in columns}, n) for n, o in enumerate(objects)]
            df = self.spark.createDataFrame([(*r[:3], dict(r[3]), r[4]) for r in rows], bundles.ROWS)
            kinds = bundles.column_kinds(df.where(F.lit(True)))[view]
            self._put(view, bundles.typed(df, view, kinds).drop("seq"), save=False)
            kind = self.views[view].sco_type if view in self.views else None
            self.views[view] = View(kind, _Stored(view))
            self._save()
            return
        rows = []
        for obj in objects:
            if "type" not in obj:
                raise InvalidObject("missing `type`")
            rows += [bundles.as_row(o, len(rows)) for o in split_references(obj)]
        self._merge(self.spark.createDataFrame([(*r[:3], dict(r[3]), r[4]) for r in rows], bundles.ROWS), None, overwrite=True)

    def reassign_df(self, df: DataFrame, sco_type: str) -> None:
        """The same for rows in a DataFrame of any size, with `ref.column` columns for what they refer to."""
        for kind, part in unresolve(df, sco_type):
            part = part.withColumn("seq", F.lit(0).cast("long")).where("id is not null")
            kinds = [kind] if kind else [r[0] for r in part.select(F.regexp_extract("id", "^(.*)--", 1)).distinct().collect()]
            for k in kinds:
                self._absorb(k, part if kind else part.where(F.col("id").startswith(f"{k}--")), overwrite=True)
        self._save()

    # Views

    def _bind(self, view: str, sco_type: str | None, definition: object) -> None:
        check_name(view)
        old = self.views.get(view)
        probe = definition.build(self)  # names and columns are checked here rather than at first use
        probe.schema  # noqa: B018
        self.views[view] = View(sco_type, definition, old.appdata if old else None)
        self._save()

    def _source(self, name: str, view: str | None = None) -> object:
        """What a definition holds for a name: the name, or, for the view that is being redefined, its old definition."""
        check_name(name)
        if name == view and name in self.views:
            return self.views[name].definition
        if name not in self.views and name not in self.versions:
            raise UnknownViewname(name)
        return Named(name)

    def extract(self, view: str, sco_type: str, query_id: str, pattern: str) -> None:
        check_name(view)
        check_name(sco_type)
        self._bind(view, sco_type, Extract(sco_type, str(query_id), pattern))

    def filter(self, view: str, sco_type: str, input_view: str, pattern: str) -> None:
        check_name(view)
        self._bind(view, sco_type, Filtered(self._inlined(input_view), sco_type, pattern))

    def _inlined(self, name: str) -> object:
        source = self._source(name)
        return self.views[name].definition if name in self.views else source

    def join(self, view: str, left: str, left_on: str, right: str, right_on: str) -> None:
        for c in (left_on, right_on):
            check_path(c)
        self._bind(view, self.table_type(left), Joined(self._source(left, view), left_on, self._source(right, view), right_on))

    def merge(self, view: str, input_views: Iterable[str]) -> None:
        names = list(input_views)
        kinds = {self.table_type(n) for n in names}
        if len(kinds) > 1:
            raise IncompatibleType(f"views of different types: {', '.join(sorted(map(str, kinds)))}")
        self._bind(view, kinds.pop(), Merged([self._inlined(n) for n in names]))

    def assign_query(self, view: str, query: Query, sco_type: str | None = None) -> None:
        """A query as a view; groups without aggregations sum every column up by its name and type."""
        check_name(view)
        if not isinstance(query.table, Table):
            raise InvalidObject("a view's query begins with a table")
        source = query.table.name
        sco_type = sco_type or self.table_type(source) or (source if source in self.versions else None)
        if query.group and not query.aggs:
            columns = self.schema(source)
            grouped = {c.name for c in query.group.cols}
            aggs = [auto_agg(sco_type or source, c["name"], c["type"]) for c in columns if c["name"] not in grouped]
            query.append(Aggregation([a for a in aggs if a]))
        inlined = {n: self.views[n].definition for n in [source, *[j.name for j in query.joins]] if n == view and n in self.views}
        self._bind(view, sco_type, Queried(query, inlined))

    def assign(self, view: str, on: str, op: str = "sort", by: str | None = None, ascending: bool = True, limit: int | None = None) -> None:
        """Sort (perhaps with a limit) or group a view by a column or path."""
        check_name(view)
        check_name(on)
        query = Query(on)
        table, column, path = on, None, None
        if by:
            path = check_path(by).rpartition(":")[2]
            column = path
            if path not in self.columns(on):
                joins, table, column = path_joins(on, self.table_type(on), path)
                query.extend(joins)
        if op == "group":
            query.append(Group([Column(column, table, path)]))
        else:
            query.append(Projection([Column(c, on) for c in self.columns(on)]))
            query.append(Order([(Column(column, table), "ASC" if ascending else "DESC")]))
            if limit:
                query.append(Limit(limit))
        self.assign_query(view, query)

    def group(self, view: str, source: str, by: object, aggs: list[tuple] | None = None) -> None:
        """A view's rows by columns, paths or bins, with aggregations, or every other column summed up by its name and type."""
        have = self.columns(source)
        query, keys, bins = Query(source), [], []
        for col in by if isinstance(by, list) else [by]:
            if isinstance(col, BinnedColumn):
                keys.append(col)
                bins.append(col)
            elif col in have:
                keys.append(Column(col, source))
            else:
                joins, table, name = self._path(source, col)
                _join_new(query, joins)
                keys.append(Column(name, table, col))
        if aggs is None:
            kind = self.table_type(source) or source
            skip = {k.name for k in keys}
            found = (auto_agg(kind, c["name"], c["type"]) for c in self.schema(source) if c["name"] not in skip)
            aggs = [a for a in found if a]
            query.append(Group(keys))
            query.append(Aggregation(aggs))
        else:
            parts = []
            for func, col, *alias in aggs:
                if col not in (None, "*") and col not in have:
                    joins, table, name = self._path(source, col)
                    _join_new(query, joins)
                    col = name
                parts.append((func, col, *alias))
            query.append(Group(keys))
            query.append(Aggregation(parts))
        # Bins are part of the projection, and so are the other keys.
        if bins:
            query.append(Projection(keys))
        query.append(Order([(k.output if isinstance(k, BinnedColumn) else Column(k.output), "ASC") for k in keys]))
        self.assign_query(view, query)

    def _path(self, view: str, path: str) -> tuple[list[Join], str, str]:
        return path_joins(view, self.table_type(view) or view, path)

    path_joins = _path

    def remove_view(self, view: str) -> None:
        if view not in self.views:
            raise UnknownViewname(view)
        del self.views[view]
        self._save()

    def rename_view(self, old: str, new: str) -> None:
        check_name(new)
        if old not in self.views:
            raise UnknownViewname(old)
        self.views[new] = self.views.pop(old)
        self._save()

    # Results

    def lookup_df(self, view: str, cols: object = "*", limit: int | None = None, offset: int | None = None) -> DataFrame:
        """A view's rows with references followed; cols: `*`, or a list (or text with commas) of columns and paths."""
        df = self.relation(check_name(view))
        kind = self.table_type(view) or view
        order = self._order(view)
        if cols == "*":
            shown = dereference(df, kind, self.stored)
        else:
            paths = cols.replace(" ", "").split(",") if isinstance(cols, str) else list(cols)
            query = Query(view)
            picked = []
            for p in paths:
                if p == "type":
                    continue
                if p in df.columns:
                    picked.append(Column(p, view))
                    continue
                try:
                    check_path(p)
                except Exception as e:
                    raise InvalidAttr(p) from e
                joins, table, name = self._path(view, p)
                _join_new(query, joins)
                picked.append(Column(name, table, p))
            shown = query.append(Projection(picked)).to_df(lambda n: df if n == view else self.relation(n))
            paths_kept = [p for p in paths if p != "type"]
            shown = shown.select(*[F.col(quoted(p)) for p in paths_kept])
        if order and order[0] in shown.columns:
            c = F.col(quoted(order[0]))
            shown = shown.orderBy(c.desc() if order[1] == "DESC" else c.asc())
        if limit:
            shown = (shown.offset(int(offset)) if offset else shown).limit(int(limit))
        return shown.withColumn("type", F.lit(kind)) if cols == "*" or "type" in cols else shown

    def _order(self, view: str) -> tuple[str, str] | None:
        """The one column that a view is sorted by; joins may lose that order, so it is asked for again."""
        d = self.views[view].definition if view in self.views else None
        if isinstance(d, Queried) and d.query.order and len(d.query.order.cols) == 1:
            c, way = d.query.order.cols[0]
            return c.output, way
        return None

    def lookup(self, view: str, cols: object = "*", limit: int | None = None, offset: int | None = None) -> list[dict]:
        return _dicts(self.lookup_df(view, cols, limit, offset))

    def values(self, path: str, view: str) -> list:
        column = path.rpartition(":")[2]
        return [r[column] for r in _dicts(self.lookup_df(view, [column]))]

    def count(self, view: str) -> int:
        return self.relation(check_name(view)).count()

    def run_query(self, query: Query) -> list[dict]:
        return _dicts(self.query_df(query))

    def query_df(self, query: Query) -> DataFrame:
        return query.to_df(self.relation)

    def sql(self, text: str, **args: object) -> DataFrame:
        """Spark SQL over all tables and views of the session, by their names."""
        for name in [n for n in [*self.versions, *self.views] if n.lower() in text.lower()]:
            self.relation(name).createOrReplaceTempView(_view_name(name))
        return self.spark.sql(text, args=args or None)

    def _observed(self, view: str, path: str | None) -> tuple[Query, str, str]:
        query = Query([Table(view), Join("__contains", "id", "=", "target_ref"), Join("observed-data", "source_ref", "=", "id")])
        if path is None:
            return query, view, "id"
        path = path.rpartition(":")[2]
        if path in self.columns(view):
            return query, view, path
        joins, table, column = self._path(view, path)
        return query.extend(joins), table, column

    def value_counts_df(self, view: str, path: str) -> DataFrame:
        """How many observations hold each value of a path."""
        query, table, column = self._observed(check_name(view), path)
        return query.extend([Group([Column(column, table, path.rpartition(":")[2])]), Aggregation([("COUNT", "*", "count")])]).to_df(self.relation)

    def value_counts(self, view: str, path: str) -> list[dict]:
        return _dicts(self.value_counts_df(view, path))

    def number_observed(self, view: str, path: str, value: object = None) -> int:
        """How often a value was observed; without observations at all the number of rows."""
        try:
            query, table, column = self._observed(view, path)
            if value is not None:
                query.append(Filter([Predicate(Column(column, table), "=", value)]))
            found = query.append(Aggregation([("SUM", "number_observed", "count")])).to_df(self.relation).collect()
        except (UnknownViewname, InvalidAttr):
            return self.count(view)
        return int(found[0]["count"] or 0)

    def observed_df(self, view: str, attributes: object, paths: object = None, value: object = None, limit: int | None = None) -> DataFrame:
        """Attributes of the observations of a view's rows, then the paths (or all columns), in the attributes' order."""
        attributes = [attributes] if isinstance(attributes, str) else list(attributes)
        listed = [] if paths is None else [paths] if isinstance(paths, str) else list(paths)
        query, table, column = self._observed(view, listed[0] if listed else None)
        shown = [Column(a, "observed-data", "observation_id" if a == "id" else a) for a in attributes]
        for n, p in enumerate(listed):
            p = p.rpartition(":")[2]
            if n == 0:
                shown.append(Column(column, table, p))
            elif p in self.columns(view):
                shown.append(Column(p, view))
            else:
                joins, t, c = self._path(view, p)
                _join_new(query, joins)
                shown.append(Column(c, t, p))
        if not listed:
            shown += [Column(c, view) for c in self.columns(view) if c not in attributes]
        if value is not None and listed:
            query.append(Filter([Predicate(Column(column, table), "=", value)]))
        query.extend([Projection(shown), Order([Column(a, "observed-data", "observation_id" if a == "id" else a) for a in attributes])])
        if limit:
            query.append(Limit(limit))
        return query.to_df(self.relation)

    def extract_observeddata_attribute(self, view: str, attributes: object, path: object = None, value: object = None, limit: int | None = None) -> list[dict]:
        return _dicts(self.observed_df(view, attributes, path, value, limit))

    def timestamped(self, view: str, path: object = None, value: object = None, timestamp: str = "first_observed", limit: int | None = None) -> list[dict]:
        return _dicts(self.observed_df(view, timestamp, path, value, limit))

    def summary(self, view: str, path: str | None = None, value: object = None) -> dict:
        """First and last time and number of a value's observations; without any, no times and the number of the view's rows."""
        try:
            query, table, column = self._observed(view, path)
            if value is not None and path:
                query.append(Filter([Predicate(Column(column, table), "=", value)]))
            aggs = [("MIN", "first_observed", "first_observed"), ("MAX", "last_observed", "last_observed"), ("SUM", "number_observed", "number_observed")]
            observed = query.append(Projection([Column(a, "observed-data") for _, a, _ in aggs])).to_df(self.relation)
            found = Query([Table("o"), Aggregation(aggs)]).to_df(lambda _: observed).collect()[0].asDict()
        except (UnknownViewname, InvalidAttr):
            found = {"first_observed": None, "last_observed": None, "number_observed": None}
        return found if found["number_observed"] else found | {"number_observed": self.count(view)}

    # Catalog

    def tables(self) -> list[str]:
        return sorted({*self.views, *(t for t in self.versions if not t.startswith("__"))})

    def types(self, private: bool = False) -> list[str]:
        return sorted(t for t in self.versions if t not in self.views and (private or not t.startswith("__")))

    def view_names(self) -> list[str]:
        return sorted(self.views)

    def table_type(self, name: str) -> str | None:
        if name in self.views:
            return self.views[name].sco_type
        return name if name in self.versions else None

    def columns(self, name: str) -> list[str]:
        return self.relation(check_name(name)).columns

    def schema(self, name: str) -> list[dict[str, str]]:
        return [{"name": n, "type": t} for n, t in self.relation(check_name(name)).dtypes]

    def column_paths(self, name: str) -> dict[str, str]:
        """The full property paths of a type's columns, whose names may be shorter."""
        return dict(self.paths.get(name, {}))

    def column_metadata(self, name: str) -> list[dict[str, str]]:
        """Name, full path, dtype and ftype of a view's columns, and of those that its references lead to."""
        kind = self.table_type(check_name(name)) or name
        df = dereference(self.relation(name), kind, self.stored)
        out = []
        for c in df.columns:
            links = parse_prop(kind, c)
            holder = links[-1][1] if links and links[-1][0] == "node" else kind
            last = links[-1][2] if links and links[-1][0] == "node" else c
            path = self.paths.get(holder, {}).get(last, last)
            out.append({"name": c, "path": f"{c[: len(c) - len(last)]}{path}", "table": holder} | prop_metadata(holder, path))
        return out

    def set_appdata(self, view: str, data: object) -> None:
        if view not in self.views:
            raise UnknownViewname(view)
        self.views[view] = replace(self.views[view], appdata=data)
        self._save()

    def get_appdata(self, view: str) -> object:
        if view not in self.views:
            raise UnknownViewname(view)
        return self.views[view].appdata

    def get_view_data(self, names: Iterable[str] | None = None) -> list[dict]:
        return [{"name": n, "type": v.sco_type, "appdata": v.appdata} for n, v in sorted(self.views.items()) if names is None or n in names]

    def delete(self) -> None:
        """Drops the session with all that it holds."""
        fs, path = self._fs(self.folder)
        fs.delete(path, True)
        self.views, self.versions, self.paths, self.number = {}, {}, {}, 0


@codec.known
@dataclass
class _Stored:
    name: str

    def build(self, store: Store) -> DataFrame:
        return store.stored(self.name)


def _join_new(query: Query, joins: list[Join]) -> None:
    """Adds the joins of a path that the query doesn't have from a path with the same beginning."""
    have = {j.alias or j.name for j in query.joins}
    query.extend([j for j in joins if (j.alias or j.name) not in have])


def _view_name(name: str) -> str:
    return f"`{name}`" if not name.isidentifier() else name


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def split_references(obj: dict) -> list[dict]:
    """An object with `ref.prop` properties as the objects that it refers to and itself; a referenced object's type is that of its id."""
    inner: dict[str, dict] = {}
    plain = {}
    for key, value in obj.items():
        ref, dot, rest = key.partition(".")
        if dot and ref.endswith("_ref"):
            inner.setdefault(ref, {})[rest] = value
            if rest == "id":
                plain[ref] = value
        else:
            plain[key] = value
    out = []
    for other in inner.values():
        if other.get("id"):
            out += split_references(other | {"type": str(other["id"]).partition("--")[0]})
    return [*out, plain]
