"""Implicit joins: property paths that lead over references, and views with all their references followed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidAttr
from ..knowledge import parse_path, parse_prop, ref_types
from ..names import quoted
from .query import Column, Join, Predicate

#: References that aren't followed, by type.
IGNORED = {"x-oca-asset": ("parent_process_ref",)}


def path_joins(view: str, sco_type: str, path: str) -> tuple[list[Join], str, str]:
    """Joins that bring a path's end to the rows of a view, the relation that has it, and its column there.

    A reference becomes a left join named by the reference without its ending (behind the names of those before it), a list of references an inner join over the edge table, by its name."""
    links = parse_path(path) if ":" in path else parse_prop(sco_type, path)
    if not links:
        raise InvalidAttr(path)
    joins, here, parts = [], view, []
    for link in links:
        if link[0] == "node":
            parts.append(link[2])
            continue
        _, _, name, target = link
        alias = name.rpartition("_")[0] if here == view else f"{here}__{name.rpartition('_')[0]}"
        if name.endswith("_refs"):
            edge = f"{alias}__r"
            joins.append(Join("__reflist", "id", "=", "source_ref", lhs=here, alias=edge, preds=[Predicate(Column("ref_name", edge), "=", name)]))
            joins.append(Join(target, "target_ref", "=", "id", lhs=edge, alias=alias))
        else:
            joins.append(Join(target, name, "=", "id", lhs=here, alias=alias, how="LEFT OUTER"))
        here = alias
    return joins, here, ".".join(parts) if parts else "id"


def dereference(df: DataFrame, sco_type: str, table: Callable[[str], DataFrame | None], paths: list[str] | None = None) -> DataFrame:
    """df with the columns of what its references point to, as `ref.column`, in place of the references.

    References are followed to their ends, but not to a type that is on the way already; a process's parent is followed once. With addresses of both versions, their columns coalesce. With paths, only
    the references that these need are joined, and only the paths remain."""
    if "id" not in df.columns:
        return df
    wanted = None if paths is None or "*" in paths else paths
    out = _follow(df, sco_type, "", table, (sco_type,), wanted)
    if wanted is not None:
        missing = [p for p in wanted if p not in out.columns]
        if missing:
            raise InvalidAttr(f"no such column: {missing[0]}")
        return out.select(*[F.col(quoted(p)) for p in wanted])
    kept = [c for c in out.columns if not c.endswith("_ref") or (sco_type == "relationship" and c in ("source_ref", "target_ref"))]
    return out.select(*[F.col(quoted(c)) for c in kept])


def _follow(df: DataFrame, sco_type: str, prefix: str, table: Callable[[str], DataFrame | None], way: tuple[str, ...], wanted: list[str] | None) -> DataFrame:
    for column in [c for c in df.columns if c.startswith(prefix) and c.endswith("_ref") and "." not in c[len(prefix) :]]:
        name = column[len(prefix) :]
        if name in IGNORED.get(sco_type, ()) or (wanted is not None and not any(p.startswith(f"{column}.") for p in wanted)):
            continue
        parent = sco_type == "process" and name == "parent_ref" and way.count("process") < 2
        targets = [t for t in ref_types(sco_type, name) if table(t) is not None and (t not in way or parent)]
        if not targets:
            continue
        sides = []
        for k, target in enumerate(targets):
            side = table(target)
            side = side.select(*[F.col(quoted(c)).alias(f"{column}.{c}" + (f"#{k}" if len(targets) > 1 else "")) for c in side.columns])
            key = f"{column}.id" + (f"#{k}" if len(targets) > 1 else "")
            df = df.join(side, F.col(quoted(column)) == F.col(quoted(key)), "left")
            sides.append([c for c in side.columns])
        if len(targets) > 1:
            names = list(dict.fromkeys(c.rpartition("#")[0] for cols in sides for c in cols))
            mine = {c for cols in sides for c in cols}
            merged = [F.coalesce(*[F.col(quoted(f"{n}#{k}")) for k in range(len(targets)) if f"{n}#{k}" in mine]).alias(n) for n in names]
            df = df.select(*[F.col(quoted(c)) for c in df.columns if c not in mine], *merged)
        df = _follow(df, targets[0], f"{column}.", table, (*way, targets[0]), wanted)
    return df


def unresolve(df: DataFrame, sco_type: str) -> list[tuple[str | None, DataFrame]]:
    """The reverse: (type, rows) of the objects whose columns stand in df as `ref.column`, and of df itself with plain references.

    The type of a referenced object is told by its id; None stands for a mixture, which the caller parts by id."""
    refs: dict[str, list[str]] = {}
    for c in df.columns:
        if "_ref." in c:
            refs.setdefault(c.split(".")[0], []).append(c)
    out: list[tuple[str | None, DataFrame]] = []
    for ref, columns in refs.items():
        if f"{ref}.id" in columns:
            inner = df.select(*[F.col(quoted(c)).alias(c[len(ref) + 1 :]) for c in columns]).where("id is not null").distinct()
            out.extend(unresolve(inner, ""))
    plain = [F.col(quoted(c)) for c in df.columns if "_ref." not in c]
    plain += [F.col(quoted(f"{ref}.id")).alias(ref) for ref, columns in refs.items() if f"{ref}.id" in columns and ref not in df.columns]
    return [*out, (sco_type or None, df.select(*plain))]
