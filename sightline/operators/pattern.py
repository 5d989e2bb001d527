"""The pattern language: [type:path op value AND ...] OR [...], parsed into a tree and compiled into column conditions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StixPatternError
from ..functions import scalars
from ..knowledge import parse_prop
from ..names import quoted
from .query import ALL_ITEMS, compare, literal

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<string>'(?:\\.|[^'\\])+')
  | (?P<stamp>t'\d{4}-[01]\d-[0-3]\dT[0-2]\d:[0-5]\d:[0-5]\d(?:\.\d+)?Z')
  | (?P<path>[A-Za-z][A-Za-z0-9_-]*:[A-Za-z][A-Za-z0-9_-]*(?:\[\*\])?(?:\.(?:[A-Za-z0-9_]|-|')+(?:\[\*\])?)*)
  | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
  | (?P<op>[<>!]=|[=<>])
  | (?P<word>[A-Za-z]+)
  | (?P<sign>[\[\](),])
)""",
    re.VERBOSE,
)
WORD_OPS = ("IN", "LIKE", "MATCHES", "ISSUBSET", "ISSUPERSET")


@dataclass(frozen=True)
class Comparison:
    sco_type: str
    prop: str
    op: str
    value: object
    negated: bool = False


@dataclass(frozen=True)
class Both:
    """AND or OR; observation: between brackets rather than inside."""

    op: str
    left: object
    right: object
    observation: bool = False


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise StixPatternError(text)
            kind = m.lastgroup
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.text, self.at = text, 0

    def fail(self) -> StixPatternError:
        return StixPatternError(self.text)

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "sign", "op") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise self.fail()
        self.at += 1
        return self.tokens[self.at - 1][1]

    def kind(self, *kinds: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise self.fail()
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> object:
        tree = self.chain(self.observation, True)
        if self.peek("START"):
            self.take("START")
            self.kind("stamp")
            self.take("STOP")
            self.kind("stamp")
        if self.at != len(self.tokens):
            raise self.fail()
        return tree

    def chain(self, part: Callable[[], object], observation: bool) -> object:
        """OR of ANDs of parts."""
        tree = self.ands(part, observation)
        while self.peek("OR"):
            self.take("OR")
            tree = Both("OR", tree, self.ands(part, observation), observation)
        return tree

    def ands(self, part: Callable[[], object], observation: bool) -> object:
        tree = part()
        while self.peek("AND"):
            self.take("AND")
            tree = Both("AND", tree, part(), observation)
        return tree

    def observation(self) -> object:
        if self.take("[", "(") == "[":
            tree = self.chain(self.comparison, False)
            self.take("]")
        else:
            tree = self.chain(self.observation, True)
            self.take(")")
        return tree

    def comparison(self) -> object:
        if self.peek("("):
            self.take("(")
            tree = self.chain(self.comparison, False)
            self.take(")")
            return tree
        sco_type, _, prop = self.kind("path").partition(":")
        negated = self.peek("NOT")
        if negated:
            self.take("NOT")
            op = self.take(*WORD_OPS)
        elif self.peek(*WORD_OPS):
            op = self.take(*WORD_OPS)
        else:
            op = self.kind("op")
        return Comparison(sco_type, prop, op, self.value(), negated)

    def value(self) -> object:
        if not self.peek("("):
            return self.literal()
        self.take("(")
        values = [self.literal()]
        while self.peek(","):
            self.take(",")
            values.append(self.literal())
        self.take(")")
        return values

    def literal(self) -> object:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "string":
            return re.sub(r"\\(['\\])", r"\1", self.kind("string")[1:-1])
        text = self.kind("number")
        return int(text) if text.isdigit() else float(text)


def parse(pattern: str) -> object:
    return _Parser(pattern).whole()


def summarize(pattern: str) -> dict[str, set[str]]:
    """The properties of each type that a pattern looks at; of parts joined by AND between brackets only those in both."""

    def walk(tree: object) -> dict[str, set[str]]:
        if isinstance(tree, Comparison):
            return {tree.sco_type: {tree.prop}}
        a, b = walk(tree.left), walk(tree.right)
        if tree.op == "AND" and tree.observation:
            both = {t: a[t] & b[t] for t in a if t in b}
            return {t: p for t, p in both.items() if p}
        return {t: a.get(t, set()) | b.get(t, set()) for t in {*a, *b}}

    return walk(parse(pattern))


class Compiler:
    """Turns a pattern into a condition on the rows of one object type.

    Comparisons of other types vanish; AND and OR keep the side that remains. A path over references becomes a join with the
    distinct ids that satisfy its end, marked, so that it works under OR and NOT; a null reference satisfies neither."""

    def __init__(self, relation: Callable[[str], DataFrame | None], ignore_case: bool = False):
        self.relation, self.ignore_case = relation, ignore_case

    def apply(self, df: DataFrame, sco_type: str, pattern: str) -> DataFrame:
        columns = df.columns
        self.df, self.marks = df, 0
        try:
            condition = self._walk(parse(pattern), sco_type)
        except (ValueError, KeyError) as e:
            raise StixPatternError(f"{pattern}: {e}") from e
        return df if condition is None else self.df.where(condition).select(*[F.col(quoted(c)) for c in columns])

    def _walk(self, tree: object, sco_type: str) -> SparkColumn | None:
        if isinstance(tree, Comparison):
            return self._compare(tree) if tree.sco_type == sco_type else None
        a, b = self._walk(tree.left, sco_type), self._walk(tree.right, sco_type)
        if a is None or b is None:
            return b if a is None else a
        return a & b if tree.op == "AND" else a | b

    def _compare(self, c: Comparison) -> SparkColumn:
        links = parse_prop(c.sco_type, c.prop)
        if not links or links[-1][0] != "node":
            raise StixPatternError(f"{c.sco_type}:{c.prop} leads nowhere")
        rels = links[:-1]
        if not rels:
            return self._simple(self.df, c.prop, c)
        # From the path's end to its begin: ids whose reference satisfies what follows.
        target = self.relation(rels[-1][3])
        if target is None:
            return F.lit(False)
        ids = target.where(self._simple(target, links[-1][2], c)).select(F.col("id").alias("__id")).distinct()
        for _, holder, name, _ in reversed(rels[1:]):
            ids = self._holders(self.relation(holder), name, ids)
        first = rels[0][2]
        self.marks += 1
        mark = f"__mark{self.marks}"
        ids = ids.select(F.col("__id").alias(mark))
        if first.endswith("_refs"):
            lists = self._lists(first).join(ids, F.col("target_ref") == F.col(mark), "left_semi").select(F.col("source_ref").alias(mark)).distinct()
            self.df = self.df.join(lists, F.col("id") == F.col(mark), "left")
            return F.col(mark).isNotNull()
        if first not in self.df.columns:
            return F.lit(False)
        self.df = self.df.join(ids, F.col(quoted(first)) == F.col(mark), "left")
        return F.col(mark).isNotNull()

    def _lists(self, name: str) -> DataFrame:
        return self.relation("__reflist").where(F.col("ref_name") == name)

    def _holders(self, holder: DataFrame | None, name: str, ids: DataFrame) -> DataFrame:
        if name.endswith("_refs"):
            return self._lists(name).join(ids, F.col("target_ref") == F.col("__id"), "left_semi").select(F.col("source_ref").alias("__id")).distinct()
        if holder is None or name not in holder.columns:
            return ids.limit(0)
        return holder.join(ids, F.col(quoted(name)) == F.col("__id"), "left_semi").select(F.col("id").alias("__id")).distinct()

    def _simple(self, df: DataFrame, prop: str, c: Comparison) -> SparkColumn:
        name, _, item = prop.partition(ALL_ITEMS)
        types = dict(df.dtypes)
        if ALL_ITEMS in prop:
            if name not in types:
                return F.lit(False)
            wanted = f'"{item[1:]}":"{c.value}"' if item else str(c.value)
            text = F.col(quoted(name)).cast("string")
            inside = scalars.like(text, f"%{wanted}%", self.ignore_case) if c.op == "LIKE" else text.contains(wanted)
            return ~inside if c.negated or c.op == "!=" else inside
        if prop not in types:
            return F.lit(False)
        value, dtype = F.col(quoted(prop)), types[prop]
        if c.op in ("ISSUBSET", "ISSUPERSET"):
            if c.sco_type != "ipv4-addr" and c.prop not in ("src_ref.value", "dst_ref.value"):
                raise ValueError(f"{c.op} on {c.prop}")
            found = scalars.in_subnet(value, str(c.value)) if c.op == "ISSUBSET" else self._superset(value, str(c.value))
        elif c.op in ("LIKE", "MATCHES"):
            if prop.rpartition(".")[2] == "payload_bin":
                value = scalars.decoded(value)
            found = scalars.like(value, str(c.value), self.ignore_case) if c.op == "LIKE" else scalars.matches(value, str(c.value))
        elif c.op == "IN":
            found = value.isin([literal(v, dtype) for v in (c.value if isinstance(c.value, list) else [c.value])])
        else:
            found = compare(value, c.op, literal(c.value, dtype))
        return ~found if c.negated else found

    def _superset(self, value: SparkColumn, address: str) -> SparkColumn:
        """Whether the value, a network or address, holds the given one."""
        import ipaddress

        net = ipaddress.ip_network(address, strict=False)
        base = scalars.ipv4_number(F.regexp_replace(value, "/.*$", ""))
        bits = F.coalesce(F.regexp_extract(value, r"/(\d+)$", 1).try_cast("int"), F.lit(32))
        size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
        low = F.floor(base / size) * size
        return F.coalesce((bits <= net.prefixlen) & (low <= int(net.network_address)) & (F.lit(int(net.network_address)) < low + size), F.lit(False))
