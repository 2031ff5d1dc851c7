import university as U

from widegrain.__main__ import main
from widegrain.authoring import draft, grid
from widegrain.authoring.emit import emit
from widegrain.engine import Engine
from widegrain.functions import names
from widegrain.plans.model import Time, WideTable
from widegrain.plans.rules import errors
from widegrain.sources.introspect import distinct_values, introspect, sample_rows


def model(spark):
    return introspect(U.catalog(spark).given)


def test_names():
    assert [names.pluralize(w) for w in ("class", "box", "city", "day", "order")] == ["classes", "boxes", "cities", "days", "orders"]
    assert names.is_id_like("orderID") and names.is_id_like("ID") and not names.is_id_like("paid")
    assert names.id_stem("customer_id") == "customer" and names.stem_fits_table("city", "cities")
    assert names.guess_nature("unitPrice") == "non-additive" and names.guess_nature("units_sold") == "additive"


def test_introspection(spark):
    m = model(spark)
    assert {t.name for t in m.entities} == {"students", "classes", "professors"}
    assert {t.name for t in m.junctions} == {"enrollments", "assignments"}
    assert m.table("classes").role == "bridge" and m.table("students").key == "student_id"
    assert [x.name for x in m.metrics["enrollments"]] == ["enrollment_grade"]
    df = U.catalog(spark).table("students")
    assert [r[0] for r in distinct_values(df, "name", 3).collect()] == ["s1", "s10", "s11"] and len(sample_rows(df)) == 5


def test_grid_to_manifest_builds(spark, tmp_path):
    state = grid.state_of(model(spark))
    assert grid.cycle(state, "tuition_paid", "Classe") in ("elimination",) if "Classe" in state.grid["tuition_paid"] else True
    row = state.grid["tuition_paid"]
    target = next(e for e, c in row.items() if c.depth == 1)
    row[target].strategy = "allocation"
    assert grid.cells_needing_weights(state) == [("tuition_paid", target)]
    row[target].weight = "share"
    home = next(e for e, c in row.items() if c.strategy == "home")
    state.tables.append(WideTable("t", (home, target), ("tuition_paid",)))
    grid.init_grid(state)
    assert state.grid["tuition_paid"][target].strategy == "allocation"
    assert grid.cycle(state, "satisfaction_score", target) == "sum_over_sum"
    grid.cycle(state, "satisfaction_score", target)
    state.move(1)
    state.time = Time("Month", "day", "month", "days", ("Month",))
    source = str(tmp_path / "db")
    draft.save_draft(state, source)
    again = draft.load_draft(source)
    assert again == state and draft.load_draft(source + "x") is None
    draft.delete_draft(source)
    assert draft.load_draft(source) is None
    again.time = None
    manifest = grid.build_manifest(again)
    assert not errors(manifest)
    assert Engine(spark, manifest, U.catalog(spark)).table("t").count() == 90


def test_roles_and_kinds(spark):
    m = model(spark)
    grid.set_role(m.table("students"), "tuition_paid", "attribute")
    m = grid.reclassify(m, "assignments", "excluded")
    assert [x.name for x in m.metrics["students"]] == ["satisfaction_score"]
    assert all(link.table != "assignments" for link in m.links) and m.table("classes").role == "leaf"


def test_emit_and_command_line(tmp_path):
    path = tmp_path / "m.yaml"
    path.write_text(U.MAIN)
    files = emit(U.manifest(), str(tmp_path / "out"), "data")
    assert files[-1].endswith("run.sh") and len(files) == 7
    assert main(["validate", str(path)]) == 0 and main(["estimate", str(path)]) == 0 and main(["suggest", str(path)]) == 0
    path.write_text(U.MAIN.replace("strategy: elimination", "strategy: split"))
    assert main(["emit", str(path), "--out", str(tmp_path / "no")]) == 1 and main(["validate", str(tmp_path / "none.yaml")]) == 1


def test_build_from_csv(spark, tmp_path):
    for name, df in U.catalog(spark).given.items():
        df.toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    path = tmp_path / "m.yaml"
    path.write_text(U.MAIN)
    assert main(["build", str(path), "--data", str(tmp_path), "--out", str(tmp_path / "out")]) == 0
