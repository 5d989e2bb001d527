"""Which names and paths are valid."""

from __future__ import annotations

import re

from .errors import InvalidStixPath, InvalidViewname

#: The forms of names, paths and plain columns.
NAME = re.compile(r"^[\w-]+$")
PATH = re.compile(r"^([a-zA-Z][a-zA-Z0-9-]*:)?[\w]+(\[\*\])?((\.\w+|\.\'[a-zA-Z0-9-]+\')(\[\*\])?)*$")
COLUMN = re.compile(r"^(\*|[A-Za-z_]+)$")


def check_name(name: object) -> str:
    if not isinstance(name, str) or not NAME.match(name):
        raise InvalidViewname(name)
    return name


def check_path(path: object) -> str:
    if not isinstance(path, str) or not PATH.match(path):
        raise InvalidStixPath(path)
    return path


def check_column(name: object) -> str:
    return name if isinstance(name, str) and COLUMN.match(name) else check_path(name)


def quoted(*parts: str) -> str:
    """A column reference of Spark in which dots and quotes are part of the names."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)
