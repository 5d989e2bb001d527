"""Definitions of views as JSON: plain values, and objects of the known classes by their names and attributes. Reading runs no code of the writer."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from ..errors import InvalidObject
from ..operators import query

#: Classes whose objects may stand in a definition. Modules add their own.
KNOWN: dict[str, type] = {
    c.__name__: c
    for c in (query.Aggregation, query.BinnedColumn, query.CoalescedColumn, query.Column, query.Count, query.CountUnique, query.Filter, query.Group, query.Join)
    + (query.Limit, query.Offset, query.Order, query.Predicate, query.Projection, query.Query, query.Table, query.Unique)
}
#: Values that JSON has no form for.
_TEXTS = {"datetime": (datetime, datetime.isoformat, datetime.fromisoformat), "date": (date, date.isoformat, date.fromisoformat), "decimal": (Decimal, str, Decimal)}


def known(cls: type) -> type:
    KNOWN[cls.__name__] = cls
    return cls


def encode(value: object) -> object:
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, list):
        return [encode(v) for v in value]
    if isinstance(value, (tuple, set, frozenset)):
        return {"kind": type(value).__name__, "of": [encode(v) for v in value]}
    if isinstance(value, dict):
        return {"kind": "dict", "of": [[encode(k), encode(v)] for k, v in value.items()]}
    for name, (cls, write, _) in _TEXTS.items():
        if isinstance(value, cls):
            return {"kind": name, "of": write(value)}
    if KNOWN.get(type(value).__name__) is type(value):
        return {"kind": "object", "class": type(value).__name__, "of": {k: encode(v) for k, v in vars(value).items()}}
    raise InvalidObject(f"a {type(value).__name__} can't be stored")


def decode(value: object) -> object:
    if isinstance(value, list):
        return [decode(v) for v in value]
    if not isinstance(value, dict):
        return value
    kind, of = value["kind"], value["of"]
    if kind in ("tuple", "set", "frozenset"):
        return {"tuple": tuple, "set": set, "frozenset": frozenset}[kind](map(decode, of))
    if kind == "dict":
        return {decode(k): decode(v) for k, v in of}
    if kind in _TEXTS:
        return _TEXTS[kind][2](of)
    cls = KNOWN[value["class"]]
    made = cls.__new__(cls)
    vars(made).update({k: decode(v) for k, v in of.items()})
    return made
