"""Commands over a session: `python -m sightline.cli [--path P] [--session S] command ...`; those of bundles work on files."""

from __future__ import annotations

import argparse
import csv
import json
import os
import sys


def _print(rows: object, form: str) -> None:
    rows = rows if isinstance(rows, list) else [rows]
    dicts = [r if isinstance(r, dict) else {"value": r} for r in rows]
    names = list(dict.fromkeys(k for r in dicts for k in r))
    if form == "json":
        print(json.dumps(rows, default=str))
    elif form == "csv":
        out = csv.DictWriter(sys.stdout, names)
        out.writeheader()
        out.writerows(dicts)
    else:
        text = [[str(r.get(n, "") if r.get(n) is not None else "") for n in names] for r in dicts]
        width = [max([len(n), *(len(t[i]) for t in text)]) for i, n in enumerate(names)]
        for line in [names, ["-" * w for w in width], *text]:
            print("  ".join(v.ljust(w) for v, w in zip(line, width, strict=True)).rstrip())


#: command -> (arguments, those with a dash are options; what to do with the session)
COMMANDS = {
    "cache": (["query_id", "files*"], lambda s, a: s.cache(a.query_id, a.files)),
    "extract": (["name", "sco_type", "query_id", "pattern"], lambda s, a: s.extract(a.name, a.sco_type, a.query_id, a.pattern)),
    "filter": (["name", "sco_type", "source", "pattern"], lambda s, a: s.filter(a.name, a.sco_type, a.source, a.pattern)),
    "assign": (["name", "source", "--op", "--by", "--desc!", "--limit#"], lambda s, a: s.assign(a.name, a.source, a.op or "sort", a.by, not a.desc, a.limit)),
    "join": (["name", "left", "left_on", "right", "right_on"], lambda s, a: s.join(a.name, a.left, a.left_on, a.right, a.right_on)),
    "lookup": (["name", "--limit#", "--offset#", "--columns"], lambda s, a: s.lookup(a.name, a.columns or "*", a.limit, a.offset)),
    "values": (["path", "name"], lambda s, a: s.values(a.path, a.name)),
    "tables": ([], lambda s, a: s.tables()),
    "views": ([], lambda s, a: s.view_names()),
    "viewdata": (["names*"], lambda s, a: s.get_view_data(a.names or None)),
    "columns": (["name"], lambda s, a: s.columns(a.name)),
    "type": (["name"], lambda s, a: s.table_type(a.name)),
    "schema": (["name"], lambda s, a: s.schema(a.name)),
    "count": (["name"], lambda s, a: s.count(a.name)),
    "delete": ([], lambda s, a: s.delete()),
    "sql": (["statement"], lambda s, a: [r.asDict() for r in s.sql(a.statement).collect()]),
    "set-appdata": (["name", "data"], lambda s, a: s.set_appdata(a.name, a.data)),
    "get-appdata": (["name"], lambda s, a: s.get_appdata(a.name)),
    "load": (["name", "file", "--sco-type", "--query-id"], lambda s, a: s.load(a.name, _objects(a.file), a.sco_type, a.query_id)),
    "reassign": (["name", "file"], lambda s, a: s.reassign(a.name, _objects(a.file))),
    "merge": (["name", "sources*"], lambda s, a: s.merge(a.name, a.sources)),
    "remove": (["name"], lambda s, a: s.remove_view(a.name)),
    "rename": (["old", "new"], lambda s, a: s.rename_view(a.old, a.new)),
    "value-counts": (["name", "path"], lambda s, a: s.value_counts(a.name, a.path)),
    "number-observed": (["name", "path", "--value"], lambda s, a: s.number_observed(a.name, a.path, a.value)),
    "timestamped": (["name", "path?", "--value", "--timestamp", "--limit#"], lambda s, a: s.timestamped(a.name, a.path, a.value, a.timestamp or "first_observed", a.limit)),
    "summary": (["name", "path?", "--value"], lambda s, a: s.summary(a.name, a.path, a.value)),
}
#: command of bundles -> (arguments, objects -> objects)
BUNDLES = {
    "randomize-ids": ([], lambda t, o, a: t.randomize_ids(o)),
    "dedup-ids": ([], lambda t, o, a: t.dedup_ids(o)),
    "limit": (["n#"], lambda t, o, a: t.limit(o, a.n)),
    "upgrade": ([], lambda t, o, a: t.upgrade(o)),
    "timeshift": (["start", "end"], lambda t, o, a: t.timeshift(o, a.start, a.end)),
    "convert": ([], None),
}


def _objects(path: str) -> list[dict]:
    """Objects of a JSON array, else rows of a table with a header."""
    with open(path) as f:
        try:
            return json.load(f)
        except json.JSONDecodeError:
            f.seek(0)
            return [{k: v for k, v in row.items() if v != ""} for row in csv.DictReader(f)]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sightline")
    p.add_argument("--path", dest="folder", default=os.environ.get("SIGHTLINE_PATH", "sightline-sessions"))
    p.add_argument("--session", default=os.environ.get("SIGHTLINE_SESSION", "session"))
    p.add_argument("--format", choices=("table", "json", "csv"), default="table")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (arguments, _) in (COMMANDS | BUNDLES).items():
        one = sub.add_parser(name)
        for spec in arguments if name in COMMANDS else [*arguments, "file"]:
            plain = spec.rstrip("*#!?")
            kind = {"type": int} if spec.endswith("#") else {"action": "store_true"} if spec.endswith("!") else {"nargs": spec[-1]} if spec[-1] in "*?" else {}
            one.add_argument(plain, **kind)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in BUNDLES:
        from .plans import bundle_tools
        from .sources import bundles, logs

        change = BUNDLES[args.command][1]
        objects = logs.convert(spark, args.file) if change is None else change(bundle_tools, bundles.read_objects(spark, args.file), args)
        print(json.dumps(bundle_tools.as_bundle(objects), indent=4, ensure_ascii=False))
        return 0
    from .plans.store import Store

    out = COMMANDS[args.command][1](Store(spark, args.folder, args.session), args)
    if out is not None:
        _print(out, args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
