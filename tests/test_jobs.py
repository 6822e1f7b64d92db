from __future__ import annotations

import csv
import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.operators import grids, quality
from bomdrift.operators.selection import Selection
from bomdrift.plans import build, export, publish, storage
from bomdrift.plans.versions import Entry, Store
from bomdrift.session import work_folder
from bomdrift.sources import views
from checks.compare import TABLES, compare, connect
from checks.context import Context
from checks.registry import ORACLE, QUERIES
from tests.conftest import SMALL


def test_lazy_and_written_models_agree(ctx):
    for name in ("fact_variance_order", "agg_component"):
        lazy = S.TABLES[name].project(ctx.lazy[name])
        assert lazy.exceptAll(ctx.model[name]).count() == 0
        assert ctx.model[name].exceptAll(lazy).count() == 0


def test_build_refuses_broken_sources(spark, ctx, folder):
    from dataclasses import replace

    broken = replace(ctx.sources, prod_table=ctx.sources.prod_table.drop("bomid"))
    with pytest.raises(build.SourceContractError, match="prod_table.*bomid"):
        build.build(spark, broken, ctx.params, folder)
    assert not storage.exists(spark, folder) or not storage.listed(spark, folder)


def test_parameters_are_validated():
    for bad in ({"date_from": "30/03/2026"}, {"date_from": "2026-03-30", "tolerance": -1}):
        with pytest.raises(ValueError):
            build.Params(**bad)


def test_gate(spark, caplog):
    dq = lambda severity, hit: spark.createDataFrame(
        [("c", severity, "d", 9, 5, hit, "m")], S.TABLES["dq_checks"].schema)
    assert quality.dq_gate(dq(S.ERROR, False)).count() == 0
    assert quality.dq_gate(dq(S.ALERT, True)).count() == 1
    assert quality.dq_gate(dq(S.ERROR, True), fail_on_error=False).count() == 1
    with pytest.raises(quality.DataQualityError, match="c = 9"):
        quality.dq_gate(dq(S.ERROR, True))
    assert "c = 9" in caplog.text


def test_checks_on_an_empty_model(spark, ctx):
    from dataclasses import replace

    inputs = ctx.model.quality_inputs()
    none = {k: v.limit(0) for k, v in vars(inputs).items() if hasattr(v, "limit")}
    rows = {r.check: r for r in quality.dq_checks(replace(inputs, dq_pct=4.9, **none)).collect()}
    assert len(rows) == 15
    coverage = rows["couverture_referentiel"]
    assert (coverage.value, coverage.threshold, coverage.in_anomaly) == (None, 4, None)
    assert rows["reconciliation_of_detail"].value == 0
    assert rows["lignes_hors_nomenclature"].in_anomaly is False


def test_reconciliation_checks_fire(ctx):
    from dataclasses import replace

    inputs = ctx.model.quality_inputs()
    off = replace(
        inputs,
        fact_variance_order=inputs.fact_variance_order.filter("variance_qty > 0"),
        agg_week=inputs.agg_week.filter("line != 'LINE-1'"),
    )
    got = {r.check: r.in_anomaly for r in quality.dq_checks(off).collect()}
    assert got["reconciliation_of_detail"] and got["reconciliation_agg_detail"]


def test_publish_swaps_and_logs(spark, ctx, folder):
    counts = publish.publish(spark, ctx.model, folder, ["dim_bom", "dim_line_coef"], "r1")
    assert list(counts) == ["dim_bom", "dim_line_coef"]
    stored = views.read_table(spark, "dim_bom", folder)
    assert stored.columns == S.TABLES["dim_bom"].columns
    assert stored.count() == counts["dim_bom"]
    publish.publish(spark, ctx.model, folder, ["dim_bom"], "r2")
    log = {r.table_name: r for r in publish.read_log(spark, folder).collect()}
    assert {k: (r.run_id, r.status, r.row_count) for k, r in log.items()} == {
        "dim_bom": ("r2", S.LOAD_OK, counts["dim_bom"]),
        "dim_line_coef": ("r1", S.LOAD_OK, counts["dim_line_coef"])}
    with pytest.raises(ValueError, match="nothing"):
        publish.publish(spark, ctx.model, folder, ["nothing"])


def test_failed_publication_keeps_the_old_table(spark, ctx, folder):
    publish.publish(spark, ctx.model, folder, ["dim_bom"], "r1")
    before = views.read_table(spark, "dim_bom", folder).count()
    boom = ctx.model["dim_bom"].withColumn(
        "bom_coef", F.expr("CASE WHEN bom_coef > 0 THEN raise_error('boom') END"))
    broken = build.Model(ctx.sources, ctx.params, {**ctx.model.tables, "dim_bom": boom})
    with pytest.raises(Exception, match="boom"):
        publish.publish(spark, broken, folder, ["dim_bom", "dim_line_coef"], "r2")
    assert views.read_table(spark, "dim_bom", folder).count() == before
    row = publish.read_log(spark, folder).first()
    assert (row.status, row.row_count, row.run_id) == (S.LOAD_FAILED, -1, "r2")
    assert "boom" in row.error_message
    assert "dim_line_coef" not in Store(spark, folder).version().tables


def test_export_files(spark, ctx, folder):
    df = grids.grid_components(ctx.fact, Selection())
    assert publish.export_grid(df, "components", f"{folder}/t", ["component_id", "abs_value"], 3, "tsv")
    lines = [row for path in sorted(glob.glob(f"{folder}/t/*.txt"))
             for row in csv.reader(open(path, encoding="utf-8"), delimiter="\t")]
    assert lines[0] == ["Component", "Absolute value"] and len(lines) == 4
    assert not publish.export_grid(df, "components", f"{folder}/p")
    assert spark.read.parquet(f"{folder}/p").count() == df.count()
    with pytest.raises(ValueError):
        publish.export_grid(df, "components", f"{folder}/x", fmt="xlsx")


def test_log_rows():
    start, end = datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 0, 2)
    assert publish.log_row("t", 5, start, end, "r")[5:8] == (2000, S.LOAD_OK, None)


def test_work_folder_follows_the_session(spark):
    set_by_session = spark.conf.get("spark.checkpoint.dir", None)
    got = work_folder(spark)
    assert got == set_by_session.rstrip("/") if set_by_session else got.startswith("/tmp/spark-")


def test_unreadable_source_is_reported_with_its_text(spark, folder):
    found = views.read_sources(spark, folder)
    rows = views.check_source_columns(spark, found).collect()
    assert len(rows) == len(found) and all(r.missing == "unreadable table" and r.available for r in rows)
    silent = views.check_source_columns(spark, {name: ValueError() for name in found}).collect()
    assert {r.available for r in silent} == {"ValueError: "}


def test_keys_are_checked_before_publication(spark, ctx, folder):
    name = "dim_line_coef"
    twice = ctx.model[name].unionByName(ctx.model[name])
    broken = build.Model(ctx.sources, ctx.params, {**ctx.model.tables, name: twice})
    with pytest.raises(ValueError, match="repeated or NULL"):
        publish.publish(spark, broken, folder, [name])


def test_exported_texts_come_back(spark, folder):
    texts = [" A ", 'q"u,o', "line\nfeed", "back\\slash", "", None, "ÿ"]
    df = spark.createDataFrame(
        [(t, "P", "L", float(i)) for i, t in enumerate(texts)],
        "component_id string, parent_program string, parent_line string, abs_value double")
    for columns in (["component_id", "abs_value"], ["component_id"]):
        path = f"{folder}/csv{len(columns)}"
        publish.export_grid(df, "components", path, columns, None, "csv", "abs_value", False)
        got = [r.component_id for r in export.read(spark, path).collect()]
        assert sorted(got, key=str) == sorted(texts, key=str) or len(columns) == 1 and len(got) == len(texts)
        publish.export_grid(df, "components", path + "t", columns, None, "tsv", "abs_value", False)
        got = [r.component_id for r in export.read(spark, path + "t").collect()]
        assert sorted(got) == sorted((t or "").replace("\n", " ") for t in texts)


@pytest.mark.parametrize("fmt", export.FORMATS)
def test_parts_joined_by_name_are_the_sorted_rows(spark, folder, fmt):
    n = 5000
    rows = spark.range(0, n, 1, 7).selectExpr("(id * 7919) % 5000 AS id", "concat('n', id) AS name").orderBy("id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = export.write(rows, f"{folder}/e", fmt)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest.parts) > 1 and manifest.rows == n and manifest == export.manifest_of(spark, f"{folder}/e")
    assert [p.name for p in manifest.parts] == sorted(p.name for p in manifest.parts)
    if fmt == "parquet":
        whole = [r.id for p in manifest.parts for r in spark.read.parquet(f"{folder}/e/{p.name}").coalesce(1).collect()]
    else:
        lines = "".join(open(f"{folder}/e/{name}", encoding="utf-8").read() for name in (export.HEADER[fmt], *(p.name for p in manifest.parts))).splitlines()
        sep = "," if fmt == "csv" else "\t"
        assert lines[0] == f"id{sep}name" and sum(line == lines[0] for line in lines) == 1
        whole = [int(line.split(sep)[0]) for line in lines[1:]]
    assert whole == list(range(n))
    part = manifest.parts[1]
    held = {int(r.id) for r in export.read(spark, f"{folder}/e", part.first, part.rows).collect()}
    assert held == set(range(part.first, part.first + part.rows))
    assert export.read(spark, f"{folder}/e", n, 10).count() == 0


def test_unfinished_and_empty_exports(spark, folder):
    rows = spark.range(3).selectExpr("cast(id AS string) AS id")
    export.write(rows, f"{folder}/e", "csv")
    storage.remove(spark, f"{folder}/e/{export.MANIFEST}")
    with pytest.raises(ValueError, match="no finished export"):
        export.read(spark, f"{folder}/e")
    for fmt in export.FORMATS:
        assert export.write(rows.limit(0), f"{folder}/e", fmt).rows == 0
        back = export.read(spark, f"{folder}/e")
        assert back.columns == ["id"] and back.count() == 0


def test_log_keeps_every_load_and_shows_the_last(spark, ctx, folder):
    publish.publish(spark, ctx.model, folder, ["dim_bom"], "r1")
    publish.publish(spark, ctx.model, folder, ["dim_bom"], "r2")
    assert spark.read.parquet(f"{folder}/{publish.LOG_NAME}").count() == 2
    assert [r.run_id for r in publish.read_log(spark, folder).collect()] == ["r2"]


def small_orders(folder, condition="o_orderdate < DATE '1995-02-01'"):
    """The smallest tables with the orders of a condition and their lines alone."""
    con = connect(SMALL)
    con.execute(f"CREATE VIEW kept AS SELECT * FROM orders WHERE {condition}")
    rows = {"orders": "SELECT * FROM kept", "lineitem": "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM kept)"}
    for name in TABLES:
        con.execute(f"COPY ({rows.get(name, f'SELECT * FROM {name}')}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


def test_k1_build_reads_the_version_that_the_build_commits(spark, folder, monkeypatch):
    sf_dir = small_orders(folder)
    own = Context(spark, sf_dir)
    own.folder = f"{folder}/work"
    monkeypatch.setattr("checks.registry.context", lambda *_: own)
    assert QUERIES["s9_read_table"](spark, sf_dir).count() > 0  # a version of one table
    store = Store(spark, f"{own.folder}/model")
    assert set(store.version().tables) == {"fact_production"}
    before = own.model.entries["fact_production"]
    con = connect(sf_dir)
    assert compare(spark, con, QUERIES["k1_build"], ORACLE["k1_build"], sf_dir) is None
    version = store.version()
    assert set(S.TABLES) <= set(version.tables) and version.tables["fact_production"] == before
    assert compare(spark, con, QUERIES["k1_build"], ORACLE["k1_build"], sf_dir) is None
    assert store.version() == version


def test_a_model_that_the_gate_refuses_is_no_version(spark, ctx, folder):
    bad = spark.createDataFrame([("c", S.ERROR, "d", 9, 5, True, "m")], S.TABLES["dq_checks"].schema)
    model = build.Model(ctx.sources, ctx.params, {"dq_checks": bad}, {"dim_bom": Entry("{}", {})})
    with pytest.raises(quality.DataQualityError, match="c = 9"):
        build.complete(spark, model, folder)
    assert Store(spark, folder).version().number == 0
