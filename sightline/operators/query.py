"""The query builder: stages that become one declarative DataFrame plan.

Stages are evaluated in the order from, joins, where, projection of bins, group and aggregation, having, projection, distinct or count, order, offset and
limit, whatever their order in the list; only a Filter behind a Group is a condition on groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import (
    InvalidAggregateFunction,
    InvalidAttr,
    InvalidComparisonOperator,
    InvalidJoinOperator,
    InvalidPredicateOperand,
    InvalidPredicateOperator,
    InvalidQuery,
)
from ..functions import scalars
from ..names import check_column, check_name, check_path, quoted

#: Operators and functions by name.
COMPARISONS = ("=", "<>", "!=", "<", ">", "<=", ">=", "LIKE", "IN", "IS", "NOT LIKE", "NOT IN", "IS NOT", "MATCHES")
JOINS = {"INNER": "inner", "OUTER": "full_outer", "LEFT OUTER": "left_outer", "CROSS": "cross"}
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "NUNIQUE")
ALL_ITEMS = "[*]"
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


class Scope:
    """A DataFrame of one or more named relations, and where its columns come from."""

    def __init__(self, df: DataFrame, relations: list[tuple[str, dict[str, str]]]):
        self.df, self.relations = df, relations

    @classmethod
    def of(cls, name: str, df: DataFrame) -> Scope:
        return cls(df.alias(name), [(name, dict(df.dtypes))])

    def find(self, name: str, table: str | None = None) -> tuple[SparkColumn, str]:
        """The column and its type; an unqualified name belongs to the first relation that has it."""
        for relation, columns in self.relations:
            if (table is None or table == relation) and name in columns:
                return F.col(quoted(relation, name)), columns[name]
        raise InvalidAttr(f"no such column: {table + '.' if table else ''}{name}")

    def everything(self) -> list[SparkColumn]:
        """All columns; where names repeat, the last relation's column counts, at the place of the first."""
        chosen = {}
        for relation, columns in self.relations:
            for c in columns:
                chosen[c] = F.col(quoted(relation, c)).alias(c)
        return list(chosen.values())


class Column:
    """A column of a relation, perhaps under another name."""

    def __init__(self, name: str, table: str | None = None, alias: str | None = None):
        check_column(name)
        if table:
            check_name(table)
        if alias:
            check_path(alias)
        self.name, self.table, self.alias = name, table, alias

    @property
    def output(self) -> str:
        return self.alias or self.name

    def column(self, scope: Scope) -> SparkColumn:
        return scope.find(self.name, self.table)[0]


class CoalescedColumn:
    """The first of some columns that isn't null; names may be qualified by a relation."""

    def __init__(self, names: Iterable[str], alias: str):
        self.names, self.alias = list(names), check_path(alias)

    @property
    def output(self) -> str:
        return self.alias

    def column(self, scope: Scope) -> SparkColumn:
        known = {relation for relation, _ in scope.relations}
        parts = []
        for name in self.names:
            table, _, column = name.partition(".")
            parts.append(scope.find(column, table)[0] if column and table in known else scope.find(name)[0])
        return F.coalesce(*parts)


class BinnedColumn(Column):
    """A column in bins: of n units of time for a timestamp, of n for a number."""

    def __init__(self, prop: str, n: int, unit: str | None = None, table: str | None = None, alias: str | None = None):
        super().__init__(prop, table, alias)
        self.n, self.unit = n, unit

    def column(self, scope: Scope) -> SparkColumn:
        value = super().column(scope)
        return scalars.bin_time(value, self.n, self.unit) if self.unit in scalars.UNITS else scalars.bin_number(value, self.n)


def as_column(c: str | Column | CoalescedColumn) -> Column | CoalescedColumn:
    return Column(c) if isinstance(c, str) else c


def _is_null(value: object) -> bool:
    return value is None or (isinstance(value, str) and value.lower() == "null")


def literal(value: object, dtype: str) -> SparkColumn:
    """A value to compare with a column of the type: null, so never equal, if it can't be of that type."""
    if isinstance(value, bool) and dtype in NUMERIC:
        return F.lit(int(value))
    if isinstance(value, str) and dtype != "string":
        return F.lit(value).try_cast(dtype)
    if not isinstance(value, str) and dtype == "string":
        return F.lit(str(value))
    return F.lit(value)


class Predicate:
    """A comparison of a column with a value, list, column or query; or two predicates with AND or OR."""

    def __init__(self, lhs: object, op: str, rhs: object):
        if op.upper() in ("AND", "OR"):
            if not isinstance(lhs, Predicate) or not isinstance(rhs, Predicate):
                raise InvalidPredicateOperand(f"{op} takes predicates")
        elif isinstance(lhs, Predicate):
            raise InvalidPredicateOperator(op)
        elif op.upper() not in COMPARISONS:
            raise InvalidComparisonOperator(op)
        else:
            check_column(lhs.name if isinstance(lhs, Column) else lhs)
            if _is_null(rhs) and op.upper() not in ("=", "!=", "<>", "IS", "IS NOT"):
                raise InvalidComparisonOperator(f"{op} with null")
            if isinstance(rhs, (list, tuple)) and op.upper() not in ("IN", "NOT IN"):
                raise InvalidComparisonOperator(f"{op} with a list")
        self.lhs, self.op, self.rhs = lhs, op.upper(), rhs

    def subqueries(self) -> list[Predicate]:
        if isinstance(self.lhs, Predicate):
            return self.lhs.subqueries() + self.rhs.subqueries()
        return [self] if isinstance(self.rhs, Query) else []

    def column(self, scope: Scope, marks: dict[int, SparkColumn] | None = None) -> SparkColumn:
        if isinstance(self.lhs, Predicate):
            a, b = self.lhs.column(scope, marks), self.rhs.column(scope, marks)
            return a & b if self.op == "AND" else a | b
        if isinstance(self.rhs, Query):
            return marks[id(self)]
        name, table = (self.lhs.name, self.lhs.table) if isinstance(self.lhs, Column) else (self.lhs, None)
        op, rhs = self.op, self.rhs
        if name.endswith(ALL_ITEMS) and isinstance(rhs, str):
            value = scope.find(name.removesuffix(ALL_ITEMS), table)[0]
            inside = value.cast("string").contains(rhs) if "%" not in rhs else scalars.like(value, f"%{rhs}%")
            return ~inside if op in ("!=", "<>", "NOT LIKE") else inside
        value, dtype = scope.find(name, table)
        if _is_null(rhs):
            return value.isNull() if op in ("=", "IS") else value.isNotNull()
        if name.rpartition(".")[2] == "payload_bin" and op in ("LIKE", "NOT LIKE", "MATCHES"):
            value, dtype = scalars.decoded(value), "string"
        if op in ("IN", "NOT IN"):
            inside = value.isin([literal(v, dtype) for v in (rhs if isinstance(rhs, (list, tuple)) else [rhs])])
            return ~inside if op == "NOT IN" else inside
        if op == "MATCHES":
            return scalars.matches(value, str(rhs))
        if op in ("LIKE", "NOT LIKE"):
            found = scalars.like(value, str(rhs))
            return ~found if op == "NOT LIKE" else found
        other = scope.find(rhs.name, rhs.table)[0] if isinstance(rhs, Column) else literal(rhs, dtype)
        return compare(value, op, other)


def compare(a: SparkColumn, op: str, b: SparkColumn) -> SparkColumn:
    return {"=": a == b, "IS": a.eqNullSafe(b), "<>": a != b, "!=": a != b, "IS NOT": ~a.eqNullSafe(b), "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


class Filter:
    """Predicates that all (or, with OR, not all) have to hold."""

    AND, OR = "AND", "OR"

    def __init__(self, preds: Iterable[Predicate], op: str = "AND"):
        if op not in ("AND", "OR"):
            raise InvalidPredicateOperator(op)
        self.preds, self.op = list(preds), op

    def predicate(self) -> Predicate:
        whole = self.preds[0]
        for p in self.preds[1:]:
            whole = Predicate(whole, self.op, p)
        return whole


class Table:
    def __init__(self, name: str):
        self.name = check_name(name)


class Projection:
    def __init__(self, cols: Iterable[str | Column | CoalescedColumn]):
        self.cols = [as_column(c) for c in cols]


class Group:
    def __init__(self, cols: Iterable[str | Column]):
        self.cols = [as_column(c) for c in cols]


class Aggregation:
    """(function, column or None, alias) each; the alias is the function's name by default."""

    def __init__(self, aggs: Iterable[tuple]):
        self.aggs = []
        for agg in aggs:
            func, col, alias = (*agg, None, None)[:3]
            if func.upper() not in AGGREGATES:
                raise InvalidAggregateFunction(func)
            if col not in (None, "*"):
                check_column(col)
            if alias:
                check_path(alias)
            self.aggs.append((func.upper(), col, alias or ("count" if func.upper() == "NUNIQUE" else func.lower())))

    def columns(self, scope: Scope) -> list[SparkColumn]:
        out = []
        for func, col, alias in self.aggs:
            if col in (None, "*"):
                out.append((F.countDistinct(*scope.everything()) if func == "NUNIQUE" else F.count(F.lit(1))).alias(alias))
                continue
            c, dtype = scope.find(col)
            if func in ("SUM", "AVG") and dtype == "string":
                c = c.try_cast("double")
            use = {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg, "NUNIQUE": F.countDistinct}[func]
            out.append(use(c).alias(alias))
        return out


class Order:
    ASC, DESC = "ASC", "DESC"

    def __init__(self, cols: Iterable[str | Column | tuple]):
        self.cols = []
        for c in cols:
            col, way = c if isinstance(c, tuple) else (c, "ASC")
            if way.upper() not in ("ASC", "DESC"):
                raise InvalidQuery(f"order {way}")
            self.cols.append((as_column(col), way.upper()))


class Limit:
    def __init__(self, num: int):
        self.num = int(num)


class Offset:
    """Rows to skip; without a Limit it has no effect."""

    def __init__(self, num: int):
        self.num = int(num)


class Unique:
    """Distinct rows."""


class Count:
    """The number of rows, as `count`."""


class CountUnique:
    """The number of distinct rows of the projected columns in which none is null."""

    def __init__(self, cols: Iterable[str] | None = None):
        self.cols = list(cols or [])


class Join:
    """A join on lhs.left_col op name.right_col and further predicates; lhs is the relation before by default."""

    def __init__(self, name: str, left_col: str | None = None, op: str | None = None, right_col: str | None = None, preds: Iterable[Predicate] | None = None, how: str = "INNER", alias: str | None = None, lhs: str | None = None):
        check_name(name)
        if how.upper() not in JOINS:
            raise InvalidJoinOperator(how)
        for c in (left_col, right_col):
            if c is not None:
                check_column(c)
        for n in (alias, lhs):
            if n is not None:
                check_name(n)
        self.name, self.left_col, self.op, self.right_col, self.preds, self.how, self.alias, self.lhs = name, left_col, op or "=", right_col, list(preds or []), how.upper(), alias, lhs

    def apply(self, scope: Scope, right: DataFrame, last: str) -> Scope:
        name = self.alias or self.name
        other = Scope.of(name, right)
        both = Scope(scope.df, scope.relations + other.relations)
        on = None
        if self.left_col and self.right_col:
            on = compare(scope.find(self.left_col, self.lhs or last)[0], self.op, other.find(self.right_col, name)[0])
        for p in self.preds:
            on = p.column(both) if on is None else on & p.column(both)
        if on is None:
            if self.how != "CROSS":
                raise InvalidQuery(f"join with {self.name} has no condition")
            return Scope(scope.df.crossJoin(other.df), both.relations)
        return Scope(scope.df.join(other.df, on, "inner" if self.how == "CROSS" else JOINS[self.how]), both.relations)


@dataclass
class Query:
    """Stages in a list; to_df(relation) makes the plan, with relation(name) -> DataFrame."""

    stages: list = field(default_factory=list)

    def __post_init__(self):
        given = [self.stages] if isinstance(self.stages, (str, Table, Query)) else self.stages
        self.stages = []
        self.table: Table | Query | None = None
        self.joins: list[Join] = []
        self.where: list[Filter] = []
        self.having: list[Filter] = []
        self.group: Group | None = None
        self.aggs: Aggregation | None = None
        self.proj: Projection | None = None
        self.order: Order | None = None
        self.limit: Limit | None = None
        self.offset: Offset | None = None
        self.unique = self.count = False
        self.extend([Table(x) if isinstance(x, str) else x for x in given])

    def extend(self, stages: Iterable) -> Query:
        for s in stages:
            self.append(s)
        return self

    def append(self, stage: object) -> Query:
        match stage:
            case Table() | Query():
                if self.table is not None:
                    raise InvalidQuery("a second table")
                self.table = stage
            case Join():
                if self.table is None:
                    raise InvalidQuery("a join without a table")
                self.joins.append(stage)
            case Filter():
                (self.having if self.group else self.where).append(stage)
            case Predicate():
                (self.having if self.group else self.where).append(Filter([stage]))
            case Group():
                self.group = stage
            case Aggregation():
                self.aggs = stage
            case Projection():
                self.proj = stage
            case Order():
                self.order = stage
            case Limit():
                self.limit = stage
            case Offset():
                self.offset = stage
            case Unique():
                self.unique = True
            case Count():
                self.count = True
            case CountUnique():
                self.unique = self.count = True
            case _:
                raise InvalidQuery(f"not a stage: {stage!r}")
        self.stages.append(stage)
        return self

    def to_df(self, relation: Callable[[str], DataFrame]) -> DataFrame:
        if self.table is None:
            raise InvalidQuery("no table")
        name = "s1" if isinstance(self.table, Query) else self.table.name
        source = self.table.to_df(relation) if isinstance(self.table, Query) else relation(name)
        scope, last = Scope.of(name, source), name
        for j in self.joins:
            scope = j.apply(scope, relation(j.name), last)
            last = j.alias or j.name
        for f in self.where:
            scope = _filtered(scope, f, relation)
        if self.group or self.aggs:
            df = self._grouped(scope)
            scope = Scope.of("grouped", df)
            for f in self.having:
                scope = _filtered(scope, f, relation)
            df = scope.df
            if self.proj and not self.group:
                df = df.select([scope.find(c.output)[0].alias(c.output) if c.output in df.columns else c.column(scope).alias(c.output) for c in self.proj.cols])
            return self._finish(df, None)
        if self.proj and not any(c.output == "*" for c in self.proj.cols):
            shown = [c.column(scope).alias(c.output) for c in self.proj.cols]
        else:
            shown = scope.everything()
        return self._finish(scope.df.select(*shown), scope)

    def render(self, placeholder: str = "?") -> tuple[str, list]:
        """The query as SQL text and the values for its placeholders, for display and other engines; to_df doesn't use it."""
        values: list = []
        source = f"({self._bound(self.table, placeholder, values)}) AS s1" if isinstance(self.table, Query) else _ident(self.table.name)
        keys = [_sql_column(c, False) for c in self.group.cols] if self.group else []
        bins = {c.output: c for c in (self.proj.cols if self.proj else []) if isinstance(c, BinnedColumn)}
        if self.proj:
            shown = [_sql_column(c, True) for c in self.proj.cols]
        elif self.group:
            shown = [_sql_column(bins.get(c.output, c), True) for c in self.group.cols]
        else:
            shown = [] if self.aggs else ["*"]
        if self.aggs:
            shown += [_sql_agg(a) for a in self.aggs.aggs]
        text = ", ".join(shown)
        if self.unique and self.count:
            text = f"COUNT(DISTINCT {text}) AS {_ident('count')}"
        elif self.count:
            text = f"COUNT({text}) AS {_ident('count')}"
        elif self.unique:
            text = f"DISTINCT {text}"
        parts = [f"SELECT {text} FROM {source}"]
        last = "s1" if isinstance(self.table, Query) else self.table.name
        for j in self.joins:
            name = j.alias or j.name
            on = [f"{_ident(j.lhs or last)}.{_ident(j.left_col)} {j.op} {_ident(name)}.{_ident(j.right_col)}"] if j.left_col and j.right_col else []
            on += [_sql_predicate(p, placeholder, values) for p in j.preds]
            parts.append(f"{j.how} JOIN {_ident(j.name)}" + (f" AS {_ident(j.alias)}" if j.alias else "") + (f" ON {' AND '.join(on)}" if on else ""))
            last = name
        for word, filters in (("WHERE", self.where), ("GROUP BY", None), ("HAVING", self.having)):
            if filters is None:
                parts += [f"GROUP BY {', '.join(keys)}"] if keys else []
            elif filters:
                parts.append(f"{word} " + " AND ".join(f"({_sql_predicate(f.predicate(), placeholder, values)})" for f in filters if f.preds))
        if self.order:
            parts.append("ORDER BY " + ", ".join(f"{_sql_column(c, False)} {way}" for c, way in self.order.cols))
        if self.limit:
            parts.append(f"LIMIT {self.limit.num}" + (f" OFFSET {self.offset.num}" if self.offset else ""))
        return " ".join(parts), values

    @staticmethod
    def _bound(inner: Query, placeholder: str, values: list) -> str:
        text, more = inner.render(placeholder)
        values.extend(more)
        return text

    def _grouped(self, scope: Scope) -> DataFrame:
        aggs = self.aggs.columns(scope) if self.aggs else [F.count(F.lit(1)).alias("count")]
        if not self.group:
            return scope.df.agg(*aggs)
        bins = {c.output: c for c in (self.proj.cols if self.proj else []) if isinstance(c, BinnedColumn)}
        keys = [bins.get(c.output, c) for c in self.group.cols]
        out = scope.df.groupBy(*[k.column(scope).alias(k.output) for k in keys]).agg(*aggs)
        if self.proj:
            shown = [c.output for c in self.proj.cols if c.output in out.columns]
            out = out.select(*[F.col(quoted(c)) for c in shown], *[F.col(quoted(c)) for c in out.columns if c not in shown and c not in {k.output for k in keys}])
        return out

    def _finish(self, df: DataFrame, scope: Scope | None) -> DataFrame:
        if self.unique and self.count:
            present = None
            for c in df.columns:
                present = F.col(quoted(c)).isNotNull() if present is None else present & F.col(quoted(c)).isNotNull()
            return df.where(present).distinct().agg(F.count(F.lit(1)).alias("count"))
        if self.unique:
            df = df.distinct()
        if self.count:
            return df.agg(F.count(F.lit(1)).alias("count"))
        if self.order:
            by = []
            for c, way in self.order.cols:
                here = F.col(quoted(c.output)) if c.output in df.columns else None
                if here is None and c.name in df.columns:
                    here = F.col(quoted(c.name))
                if here is None:
                    if scope is None or self.unique:
                        raise InvalidAttr(f"no such column: {c.name}")
                    here = c.column(scope)
                by.append(here.desc() if way == "DESC" else here.asc())
            df = df.orderBy(*by)
        if self.limit:
            if self.offset:
                df = df.offset(self.offset.num)
            df = df.limit(self.limit.num)
        return df


def _ident(name: str) -> str:
    return name if name == "*" else '"' + name.replace('"', '""') + '"'


def _sql_column(c: Column | CoalescedColumn, shown: bool) -> str:
    if isinstance(c, CoalescedColumn):
        return f"COALESCE({', '.join('.'.join(map(_ident, n.split('.', 1))) for n in c.names)}) AS {_ident(c.alias)}" if shown else _ident(c.alias)
    plain = (f"{_ident(c.table)}." if c.table else "") + _ident(c.name)
    if not shown:
        return _ident(c.alias) if c.alias else plain
    if isinstance(c, BinnedColumn):
        if c.unit in scalars.UNITS:
            width = c.n * scalars.UNITS[c.unit]
            plain = f"to_timestamp(floor(epoch({plain}) / {width}) * {width})"
        else:
            plain = f"trunc({plain} / {c.n}) * {c.n}"
        return f"{plain} AS {_ident(c.output)}"
    return f"{plain} AS {_ident(c.alias)}" if c.alias else plain


def _sql_agg(agg: tuple[str, str | None, str]) -> str:
    func, col, alias = agg
    inner = "*" if col in (None, "*") else _ident(col)
    return (f"COUNT(DISTINCT {inner})" if func == "NUNIQUE" else f"{func}({inner})") + f" AS {_ident(alias)}"


def _sql_predicate(p: Predicate, placeholder: str, values: list) -> str:
    if isinstance(p.lhs, Predicate):
        return f"({_sql_predicate(p.lhs, placeholder, values)}) {p.op} ({_sql_predicate(p.rhs, placeholder, values)})"
    column = p.lhs if isinstance(p.lhs, Column) else Column(p.lhs)
    if column.name.endswith(ALL_ITEMS) and isinstance(p.rhs, str):
        values.append(f"%{p.rhs}%")
        return f"{_ident(column.name.removesuffix(ALL_ITEMS))} {'NOT LIKE' if p.op in ('!=', '<>', 'NOT LIKE') else 'LIKE'} {placeholder}"
    left = _sql_column(column, False)
    if _is_null(p.rhs):
        return f"{left} IS NULL" if p.op in ("=", "IS") else f"{left} IS NOT NULL"
    if isinstance(p.rhs, Query):
        return f"{left} {p.op} ({Query._bound(p.rhs, placeholder, values)})"
    if isinstance(p.rhs, Column):
        return f"{left} {p.op} {_sql_column(p.rhs, False)}"
    if isinstance(p.rhs, (list, tuple)):
        values.extend(p.rhs)
        return f"{left} {p.op} ({', '.join([placeholder] * len(p.rhs))})"
    values.append(p.rhs)
    return f"{left} {p.op} {placeholder}"


def _filtered(scope: Scope, f: Filter, relation: Callable[[str], DataFrame]) -> Scope:
    """Conditions with IN (query) that must all hold are semi and anti joins; under OR they are joins with a mark."""
    if not f.preds:
        return scope
    conjuncts = _conjuncts(f.predicate())
    df, plain = scope.df, []
    for p in conjuncts:
        if isinstance(p.rhs, Query) and not isinstance(p.lhs, Predicate):
            df = _semi(df, scope, p, relation)
        else:
            plain.append(p)
    marks: dict[int, SparkColumn] = {}
    for p in plain:
        for k, sub in enumerate(p.subqueries()):
            mark = f"__mark_{id(p)}_{k}"
            inner = sub.rhs.to_df(relation)
            value = inner.select(F.col(quoted(inner.columns[0])).alias(mark))
            key = scope.find(sub.lhs.name if isinstance(sub.lhs, Column) else sub.lhs, sub.lhs.table if isinstance(sub.lhs, Column) else None)[0]
            # One row: whether there are values, and a null among them; either leaves open what isn't found.
            about = value.agg((F.count(F.lit(1)) > 0).alias(f"{mark}_any"), (F.count(F.lit(1)) > F.count(mark)).alias(f"{mark}_null"))
            df = df.join(value.where(F.col(mark).isNotNull()).distinct(), key == F.col(mark), "left").crossJoin(F.broadcast(about))
            unsure = F.col(f"{mark}_null") | (key.isNull() & F.col(f"{mark}_any"))
            found = F.when(F.col(mark).isNotNull(), True).when(unsure, F.lit(None).cast("boolean")).otherwise(False)
            marks[id(sub)] = ~found if sub.op == "NOT IN" else found
    for p in plain:
        df = df.where(p.column(scope, marks))
    return Scope(df, scope.relations)


def _conjuncts(p: Predicate) -> list[Predicate]:
    return _conjuncts(p.lhs) + _conjuncts(p.rhs) if isinstance(p.lhs, Predicate) and p.op == "AND" else [p]


def _semi(df: DataFrame, scope: Scope, p: Predicate, relation: Callable[[str], DataFrame]) -> DataFrame:
    inner = p.rhs.to_df(relation)
    key = scope.find(p.lhs.name if isinstance(p.lhs, Column) else p.lhs, p.lhs.table if isinstance(p.lhs, Column) else None)[0]
    inside = inner.select(F.col(quoted(inner.columns[0])).alias("__in"))
    if p.op == "IN":
        return df.join(inside, key == F.col("__in"), "left_semi")
    if p.op != "NOT IN":
        raise InvalidComparisonOperator(f"{p.op} with a query")
    # NOT IN isn't true for a null if the query returns anything, nor for any value if it returns a null.
    nulls = inside.where(F.col("__in").isNull()).limit(1)
    return df.join(inside, key == F.col("__in"), "left_anti").join(inside.limit(1), key.isNull(), "left_anti").join(nulls, F.lit(True), "left_anti")
