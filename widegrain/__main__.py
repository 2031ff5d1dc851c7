"""python -m widegrain validate | estimate | suggest | build | emit | introspect"""

from __future__ import annotations

import argparse
import sys

from widegrain.authoring.draft import delete_draft, load_draft, save_draft
from widegrain.authoring.emit import emit
from widegrain.authoring.grid import build_manifest, state_of
from widegrain.plans.estimate import estimate_table_rows
from widegrain.plans.manifest_yaml import load_manifest, save_manifest
from widegrain.plans.rules import validate
from widegrain.plans.suggest import suggest


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("widegrain").getOrCreate()


def _catalog(spark, args):
    from widegrain.sources.catalog import Catalog

    return Catalog.csv(spark, args.data) if args.format == "csv" else Catalog.parquet(spark, args.data)


def _report(manifest) -> bool:
    found = validate(manifest)
    for f in sorted(found, key=lambda f: f.severity != "warning"):
        print(f"{f.severity}: [{f.rule}] {f.message}", file=sys.stderr)
    return not any(f.severity == "error" for f in found)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="widegrain")
    parser.add_argument("command", choices=["validate", "estimate", "suggest", "build", "emit", "introspect"])
    parser.add_argument("manifest")
    parser.add_argument("--data", default="data")
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--out", default="out")
    parser.add_argument("--table", action="append")
    args = parser.parse_args(argv)
    if args.command == "introspect":
        return _introspect(args)
    try:
        manifest = load_manifest(args.manifest)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not _report(manifest):
        return 1
    if args.command == "estimate":
        for t in manifest.tables:
            print(t.name, estimate_table_rows(manifest, t.name))
    elif args.command == "suggest":
        for i, s in enumerate(suggest(manifest), 1):
            print(f"{i}. {s.change}: saves {s.saves.rows} rows, {s.saves.columns} columns, {s.saves.weights} weights; {s.loses}")
    elif args.command == "emit":
        print("\n".join(emit(manifest, args.out, args.data, args.format)))
    elif args.command == "build":
        from widegrain.engine import ChecksFailed, Engine

        engine = Engine(spark := _session(), manifest, _catalog(spark, args))
        for t in args.table or [t.name for t in manifest.tables]:
            try:
                engine.write(t, f"{args.out}/{t}")
                print(f"{t}: PASS")
            except ChecksFailed as e:
                print(f"{t}: {e}", file=sys.stderr)
                return 1
    return 0


def _introspect(args) -> int:
    """Draft a manifest from the tables named by --table, or from a saved draft."""
    from widegrain.sources.introspect import introspect, scan

    state = load_draft(args.data)
    if state is None:
        spark = _session()
        tables = {t: _catalog(spark, args).table(t) for t in args.table} if args.table else scan(spark)
        state = state_of(introspect(tables))
        save_draft(state, args.data)
    manifest = build_manifest(state)
    ok = _report(manifest)
    if ok:
        save_manifest(manifest, args.manifest)
        delete_draft(args.data)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
