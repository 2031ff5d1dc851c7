"""Files that load the sources and build every table in Spark SQL."""

from __future__ import annotations

import os

from widegrain.authoring.sql import checks_sql, table_sql
from widegrain.plans.manifest_yaml import serialize_manifest
from widegrain.plans.model import Manifest
from widegrain.plans.planner import plan_all, plan_table


RUN = """#!/bin/sh
set -e
cd "$(dirname "$0")"
cat [0-9]*.sql > .all.sql
"${SPARK_SQL:-spark-sql}" -f .all.sql > .result.txt
grep -E '(PASS|FAIL)$' .result.txt
if grep -q 'FAIL$' .result.txt; then exit 1; fi
"""


def load_sql(manifest: Manifest, folder: str, form: str = "csv") -> str:
    """Spark SQL that makes a view of every source table, entities first."""
    names = dict.fromkeys([*(e.table for e in manifest.entities), *(r.table for r in manifest.relationships)])
    options = ", header 'true', inferSchema 'true'" if form == "csv" else ""
    return "\n".join(f"CREATE OR REPLACE TEMPORARY VIEW `{n}` USING {form} OPTIONS (path '{folder}/{n}.{form}'{options});" for n in names) + "\n"


def plan_text(manifest: Manifest, table: str) -> str:
    plan = next(p for p in plan_all(manifest) if p.table.name == table)
    lines = [f"-- {table}: one row for each of {', '.join(plan.table.entities)}"]
    for g in plan.groups:
        lines.append(f"-- grain {', '.join(g.grain)}{' (summarized)' if g.summarizes else ''}")
        for m in g.metrics:
            hops = " > ".join(f"{h.target_entity} by {h.strategy}" for h in m.hops) or "reserve"
            lines.append(f"--   {m.name} from {m.home.name}: {hops}" + (f"; reserved for {', '.join(m.reserved)}" if m.reserved else ""))
    return "\n".join([*lines, table_sql(manifest, plan)])


def emit(manifest: Manifest, out: str, folder: str, form: str = "csv") -> list[str]:
    """Write 00_load_data.sql, a file for each table, 99_checks.sql, the manifest and run.sh; their paths.

    run.sh builds the tables, prints PASS or FAIL for each check, and ends with 1 if one fails.
    """
    os.makedirs(out, exist_ok=True)
    files = {"00_load_data.sql": load_sql(manifest, folder, form), "manifest.yaml": serialize_manifest(manifest)}
    for i, t in enumerate(manifest.tables, 1):
        files[f"{i:02d}_{t.name}.sql"] = plan_text(manifest, t.name)
    files["99_checks.sql"] = "".join(f"{checks_sql(manifest, plan_table(manifest, t.name))};\n" for t in manifest.tables)
    files["run.sh"] = RUN
    paths = []
    for name, body in files.items():
        path = os.path.join(out, name)
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)
        paths.append(path)
    os.chmod(paths[-1], 0o755)
    return paths
