"""Spark SQL text of a wide table, for running without this library.

The same branches as `operators.assemble` with its default options, over the source
tables' views; one statement for each table.
"""

from __future__ import annotations

from widegrain.functions.names import label_output
from widegrain.functions.periods import DAYS, MONTHS
from widegrain.operators.weights import count_name, rows_name
from widegrain.plans.model import Manifest, Metric
from widegrain.operators.checks import SUM_TOLERANCE, WEIGHT_TOLERANCE
from widegrain.plans.planner import GrainGroup, MetricPlan, TablePlan, join_links
from widegrain.sources.catalog import Catalog


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(m: Metric) -> str:
    return "CAST(1 AS DOUBLE)" if m.counts else f"CAST({q(m.column)} AS DOUBLE)"


def pair(e: str) -> str:
    return f"{q(f'id_{e}')}, {q(f'lb_{e}')}"


class TableSql:
    def __init__(self, manifest: Manifest, plan: TablePlan):
        self.manifest, self.plan, self.ctes = manifest, plan, []
        self.entities = plan.table.entities

    def statement(self) -> str:
        branches = []
        full = [m for g in self.plan.full_grain for m in g.metrics]
        if full:
            branches += self._pipeline(full)
        for i, g in enumerate(self.plan.summarizing):
            branches.append(self._summary(g, i))
        body = "\nUNION ALL\n".join(branches)
        ctes = ",\n".join(f"{q(n)} AS (\n{s}\n)" for n, s in self.ctes)
        name = q(self.plan.table.name)
        return f"DROP TABLE IF EXISTS {name};\nCREATE TABLE {name} USING parquet AS\nWITH {ctes}\n{body};\n"

    # -- sources and base rows

    def _entity(self, e: str, plans: list[MetricPlan]) -> str:
        entity = self.manifest.entity(e)
        cols = [f"{q(entity.id)} AS {q(f'id_{e}')}", f"CAST({q(entity.label)} AS STRING) AS {q(f'lb_{e}')}"]
        cols += [f"{number(p.metric)} AS {q(f'm_{p.name}')}" for p in plans if p.home.relationship is None and p.home.name == e]
        for r in self.manifest.relationships:
            if Catalog().held_by(self.manifest, r) == e:
                cols.append(f"{q(self.manifest.link_column(r, r.other(e)))} AS {q(f'f_{r.name}')}")
        time = self.manifest.time
        if time and time.entity == e:
            cols.append(f"CAST({q(time.column)} AS DATE) AS `period`")
        return f"(SELECT {', '.join(cols)} FROM {q(entity.table)})"

    def _links(self, r, plans: list[MetricPlan]) -> str:
        keys = [self.manifest.link_column(r, e) for e in r.between]
        cols = [f"{q(k)} AS {q(f'l_{r.name}_{e}')}" for k, e in zip(keys, r.between)]
        cols += [f"{'SUM' if p.additive else 'AVG'}({number(p.metric)}) AS {q(f'm_{p.name}')}" for p in plans if p.home.relationship == r.name]
        return f"(SELECT {', '.join(cols)} FROM {q(r.table)} GROUP BY {', '.join(map(q, keys))})"

    def _joined(self, links: list, first: str, plans: list[MetricPlan]) -> str:
        out = [self._entity(first, plans)]
        for at, to, r in links:
            many = Catalog().held_by(self.manifest, r)
            if many is not None:
                out.append(f"JOIN {self._entity(to, plans)} ON {q(f'f_{r.name}')} = {q(f'id_{r.other(many)}')}")
            else:
                out.append(f"JOIN {self._links(r, plans)} ON {q(f'id_{at}')} = {q(f'l_{r.name}_{at}')}")
                out.append(f"JOIN {self._entity(to, plans)} ON {q(f'l_{r.name}_{to}')} = {q(f'id_{to}')}")
        return "\n".join(out)

    def _base(self, name: str, grain: tuple[str, ...], plans: list[MetricPlan]) -> str:
        """Adds the base rows with all counts; returns their name."""
        self.ctes.append((f"{name}_base", f"SELECT * FROM {self._joined(join_links(self.manifest, grain), grain[0], plans)}"))
        counts: dict[str, tuple[tuple[str, ...], str]] = {}
        for p in plans:
            for i, h in enumerate(p.hops):
                if h.strategy != "elimination" or not p.additive:
                    counts[count_name(p, i)] = (p.anchors(i), f"COUNT(DISTINCT {q(f'id_{h.target_entity}')})")
            if not p.additive and set(grain) - set(p.grain):
                counts[rows_name(p)] = (p.grain, "COUNT(*)")
        cols, joins = ["b.*"], []
        for i, (label, (keys, expr)) in enumerate(counts.items()):
            ids = [q(f"id_{e}") for e in keys]
            joins.append(f"JOIN (SELECT {', '.join(ids)}, {expr} AS {q(label)} FROM {q(f'{name}_base')} GROUP BY {', '.join(ids)}) c{i} ON {' AND '.join(f'b.{k} = c{i}.{k}' for k in ids)}")
            cols.append(f"c{i}.{q(label)}")
        self.ctes.append((name, "\n".join([f"SELECT {', '.join(cols)} FROM {q(f'{name}_base')} b", *joins])))
        return name

    # -- values and branches

    def _allocated(self, p: MetricPlan, upto: int | None = None) -> str:
        return " / ".join([q(f"m_{p.name}"), *(q(count_name(p, i)) for i in p.hops_by("allocation") if upto is None or i < upto)])

    def _weight(self, p: MetricPlan, grain: tuple[str, ...]) -> str:
        parts = [q(count_name(p, i)) for i in p.hops_by("sum_over_sum")] + ([q(rows_name(p))] if set(grain) - set(p.grain) else [])
        return " / ".join(["CAST(1 AS DOUBLE)", *parts])

    def _select(self, source: str, present: tuple[str, ...], values: dict[str, str], weights: dict[str, str], placeholder: str) -> str:
        cols, named = [], {e for m in self.plan.metrics for e in m.grain}
        for e in self.entities:
            key, label = q(self.manifest.entity(e).id), q(label_output(e))
            if e in present:
                cols += [f"{q(f'id_{e}')} AS {key}", f"COALESCE({q(f'lb_{e}')}, CASE WHEN {q(f'id_{e}')} IS NULL THEN {text(placeholder)} END) AS {label}"]
            else:
                # A column that is null in every branch needs a type of its own.
                cols += [f"{'NULL' if e in named or self.plan.full_grain else 'CAST(NULL AS BIGINT)'} AS {key}", f"{text(placeholder)} AS {label}"]
        for m in self.plan.metrics:
            cols.append(f"CAST({values.get(m.name, '0')} AS DOUBLE) AS {q(m.name)}")
            if not m.additive:
                cols.append(f"CAST({weights.get(m.name, '0')} AS DOUBLE) AS {q(f'{m.name}_weight')}")
        return f"SELECT {', '.join(cols)}\nFROM {source}"

    def _corrected(self, name: str, p: MetricPlan, hop: int) -> str:
        anchors = ", ".join(pair(e) for e in p.anchors(hop))
        value, target = self._allocated(p, hop), q(f"id_{p.hops[hop].target_entity}")
        return f"(SELECT {anchors}, v * (1 - COUNT(DISTINCT {target})) AS {q(f'm_{p.name}')} FROM (SELECT *, {value} AS v FROM {q(name)}) GROUP BY {anchors}, v)"

    def _pipeline(self, plans: list[MetricPlan]) -> list[str]:
        name, reserve = self._base("combined", self.entities, plans), self.manifest.reserve_label
        values = {p.name: self._allocated(p) if p.additive else q(f"m_{p.name}") for p in plans if not p.additive or not p.reserved}
        weights = {p.name: self._weight(p, self.entities) for p in plans if not p.additive}
        out = [self._select(q(name), self.entities, values, weights, reserve)]
        for p in (p for p in plans if p.additive):
            own = {p.name: q(f"m_{p.name}")}
            if p.reserved and (p.hops_by("allocation") or p.hops_by("elimination")):
                rows = f"(SELECT DISTINCT {', '.join(pair(e) for e in p.grain)}, {self._allocated(p)} AS {own[p.name]} FROM {q(name)})"
                out.append(self._select(rows, p.grain, own, {}, reserve))
            elif p.reserved:
                out.append(self._select(self._home(p), p.home.grain, own, {}, reserve))
            out += [self._select(self._corrected(name, p, i), p.anchors(i), own, {}, self.manifest.elimination_label) for i in p.hops_by("elimination")]
        return out

    def _home(self, p: MetricPlan) -> str:
        """All rows of the metric's home."""
        links = join_links(self.manifest, p.home.grain) if p.home.relationship is None else [(*p.home.grain, self.manifest.relationship(p.home.relationship))]
        return f"(SELECT * FROM {self._joined(links, p.home.grain[0], [p])})"

    def checks(self) -> list[str]:
        """A query for each check, of one row (test, result); see `operators.checks`."""
        time, name = self.manifest.time, q(self.plan.table.name)
        timed = set(time.time_entities or (time.entity,)) if time else set()
        key = lambda e: q(self.manifest.entity(e).id)

        def verdict(test: str, bad: str) -> str:
            return f"SELECT {text(f'{self.plan.table.name}.{test}')} AS test, CASE WHEN {bad} THEN 'FAIL' ELSE 'PASS' END AS result"

        out = [verdict("row_count", f"(SELECT COUNT(*) FROM {name}) = 0")]
        for p in self.plan.metrics:
            own, home = q(f"m_{p.name}"), self._home(p)
            if not p.additive:
                if not p.summarized:
                    named = " AND ".join(f"{key(e)} IS NOT NULL" for e in p.grain)
                    sums = f"SELECT SUM({q(f'{p.name}_weight')}) AS w FROM {name} WHERE {named} GROUP BY {', '.join(key(e) for e in p.home.grain)}"
                    out.append(verdict(f"weights_{p.name}", f"EXISTS (SELECT 1 FROM ({sums}) WHERE ABS(COALESCE(w, 0) - 1) > {WEIGHT_TOLERANCE})"))
                continue
            if not (p.metric.stock and set(p.summarized) & timed):
                out.append(verdict(f"sum_{p.name}", f"ABS((SELECT COALESCE(SUM({q(p.name)}), 0) FROM {name}) - (SELECT COALESCE(SUM({own}), 0) FROM {home})) >= {SUM_TOLERANCE}"))
            if self.plan.summarizing:
                continue
            if p.reserved:
                named = " OR ".join(f"{key(e)} IS NOT NULL" for e in p.reserved)
                out.append(verdict(f"reserve_{p.name}", f"EXISTS (SELECT 1 FROM {name} WHERE ({named}) AND {q(p.name)} <> 0)"))
            elif p.home.relationship is None and p.hops and len(p.hops_by("allocation")) == len(p.hops):
                e = p.home.grain[0]
                sums = f"SELECT {key(e)} AS k, SUM({q(p.name)}) AS t FROM {name} GROUP BY {key(e)}"
                out.append(verdict(f"per_home_{p.name}", f"EXISTS (SELECT 1 FROM ({sums}) JOIN {home} ON k = {q(f'id_{e}')} WHERE ABS(t - {own}) > {SUM_TOLERANCE})"))
        return out

    def _summary(self, group: GrainGroup, number: int) -> str:
        plans, time = list(group.metrics), self.manifest.time
        name = self._base(f"summary{number}", group.grain, plans)
        keys = tuple(e for e in self.entities if e in group.grain)
        timed = time is not None and bool(set(plans[0].summarized) & set(time.time_entities or (time.entity,)))
        days = timed and (time.weighting or "days") == "days" and time.entity in group.grain
        length = self._days() if days else "CAST(NULL AS BIGINT)"
        cols = [pair(e) for e in keys]
        values = [f"{self._allocated(p) if p.additive else q(f'm_{p.name}')} AS {q(f'v_{p.name}')}" for p in plans]
        values += [f"{self._weight(p, group.grain) if not p.additive else 'CAST(0 AS DOUBLE)'} AS {q(f'u_{p.name}')}" for p in plans]
        parts = [f"SELECT {', '.join([*cols, *values, f'{length} AS days', 'TRUE AS counted'])} FROM {q(name)}"]
        for p in plans:
            for hop in p.hops_by("elimination") if p.additive and not (p.metric.stock and timed) else []:
                at = [pair(e) if e in p.anchors(hop) else f"NULL AS {q(f'id_{e}')}, NULL AS {q(f'lb_{e}')}" for e in keys]
                fill = [f"{q(f'm_{p.name}') if x is p else 'NULL'} AS {q(f'v_{x.name}')}" for x in plans] + [f"0 AS {q(f'u_{x.name}')}" for x in plans]
                parts.append(f"SELECT {', '.join([*at, *fill, 'NULL AS days', 'FALSE AS counted'])} FROM {self._corrected(name, p, hop)}")
        totals = [t for p in plans for t in self._totals(p, timed, days)]
        by = f" GROUP BY {', '.join(cols)}" if cols else ""
        rows = "\nUNION ALL\n".join(parts)
        return self._select(f"(SELECT {', '.join([*cols, *totals])} FROM (\n{rows}\n){by})", keys, {p.name: q(f"t_{p.name}") for p in plans}, {p.name: q(f"x_{p.name}") for p in plans}, self.manifest.reserve_label)

    def _totals(self, p: MetricPlan, timed: bool, days: bool) -> list[str]:
        v, u = q(f"v_{p.name}"), q(f"u_{p.name}")
        if not p.additive:
            return [f"SUM({v} * {u}) / NULLIF(SUM({u}), 0) AS {q(f't_{p.name}')}", f"SUM({u}) AS {q(f'x_{p.name}')}"]
        if timed and p.metric.stock:
            value = f"SUM({v} * days) / NULLIF(SUM(CASE WHEN counted THEN days END), 0)" if days else f"AVG(CASE WHEN counted THEN {v} END)"
        else:
            value = f"SUM({v})"
        return [f"{value} AS {q(f't_{p.name}')}", f"0 AS {q(f'x_{p.name}')}"]

    def _days(self) -> str:
        size = self.manifest.time.granularity
        return f"CAST({DAYS[size]} AS BIGINT)" if size in DAYS else f"CAST(DATEDIFF(ADD_MONTHS(`period`, {MONTHS[size]}), `period`) AS BIGINT)"


def checks_sql(manifest: Manifest, plan: TablePlan) -> str:
    return "\nUNION ALL\n".join(TableSql(manifest, plan).checks())


def table_sql(manifest: Manifest, plan: TablePlan) -> str:
    return TableSql(manifest, plan).statement()
