"""The session's interface for asynchronous callers: each method runs in a thread; one session's changes run one after another."""

from __future__ import annotations

import asyncio

from pyspark.sql import DataFrame, SparkSession

from .errors import SessionNotFound
from .operators.query import Query
from .plans.store import Store
from .sources import translate


class AsyncStore:
    def __init__(self, spark: SparkSession, path: str | None = None, session_id: str = "session"):
        self.spark, self.path, self.session_id = spark, path, session_id
        self.store: Store | None = None
        self._lock = asyncio.Lock()

    async def create(self) -> None:
        """Makes a new session; SessionExists if there is one of that name."""
        self.store = await asyncio.to_thread(Store, self.spark, self.path, self.session_id, attach=False)

    async def attach(self) -> None:
        """Opens a session that exists; else SessionNotFound."""
        self.store = await asyncio.to_thread(Store, self.spark, self.path, self.session_id, attach=True)

    def _open(self) -> Store:
        if self.store is None:
            raise SessionNotFound(self.session_id)
        return self.store

    async def _read(self, name: str, *args: object, **kwargs: object) -> object:
        return await asyncio.to_thread(getattr(self._open(), name), *args, **kwargs)

    async def _change(self, name: str, *args: object, **kwargs: object) -> object:
        async with self._lock:
            return await asyncio.to_thread(getattr(self._open(), name), *args, **kwargs)

    async def cache(self, query_id: str, bundle: object) -> None:
        await self._change("cache", query_id, bundle)

    async def load(self, *args: object, **kwargs: object) -> str:
        return await self._change("load", *args, **kwargs)

    async def extract(self, *args: object) -> None:
        await self._change("extract", *args)

    async def assign_query(self, view: str, query: Query, sco_type: str | None = None) -> None:
        await self._change("assign_query", view, query, sco_type)

    async def remove_view(self, view: str) -> None:
        await self._change("remove_view", view)

    async def set_appdata(self, view: str, data: object) -> None:
        await self._change("set_appdata", view, data)

    async def delete(self) -> None:
        await self._change("delete")

    async def ingest(self, identity: dict, wide: DataFrame, query_id: str) -> None:
        async with self._lock:
            await asyncio.to_thread(translate.ingest, self._open(), identity, wide, query_id)

    async def write_df(self, name: str, df: DataFrame, query_id: str | None = None) -> None:
        """Merges rows with ids into a type's table."""
        async with self._lock:
            await asyncio.to_thread(self._open().reassign_df, df, name)

    async def new_type(self, name: str, schema: dict[str, str]) -> None:
        store = self._open()
        async with self._lock:
            await asyncio.to_thread(store._put, name, self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in schema.items())))

    async def new_property(self, name: str, column: str, dtype: str) -> None:
        from pyspark.sql import functions as F

        store = self._open()
        async with self._lock:
            df = store.relation(name)
            if column not in df.columns:
                await asyncio.to_thread(store._put, name, df.withColumn(column, F.lit(None).cast(dtype)))

    async def tables(self) -> list[str]:
        return await self._read("tables")

    async def views(self) -> list[str]:
        return await self._read("view_names")

    async def types(self, private: bool = False) -> list[str]:
        return await self._read("types", private)

    async def table_type(self, view: str) -> str | None:
        return await self._read("table_type", view)

    async def columns(self, view: str) -> list[str]:
        return await self._read("columns", view)

    async def schema(self, view: str) -> list[dict]:
        return await self._read("schema", view)

    async def properties(self, name: str | None = None) -> list[dict]:
        """Column names and types of a type, or of all."""
        store = self._open()
        names = [name] if name else store.types(private=True)
        return [{"table": n} | c for n in names for c in await self._read("schema", n)]

    async def lookup(self, view: str, cols: object = "*", limit: int | None = None, offset: int | None = None) -> list[dict]:
        return await self._read("lookup", view, cols, limit, offset)

    async def run_query(self, query: Query) -> list[dict]:
        return await self._read("run_query", query)

    async def fetch(self, text: str, **args: object) -> list[dict]:
        return [r.asDict() for r in (await self._read("sql", text, **args)).collect()]

    async def get_appdata(self, view: str) -> object:
        return await self._read("get_appdata", view)

    async def get_view_data(self, names: list[str] | None = None) -> list[dict]:
        return await self._read("get_view_data", names)

    async def path_joins(self, view: str, path: str) -> tuple:
        return await self._read("path_joins", view, path)
