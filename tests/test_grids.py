from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from bomdrift.operators import grids
from bomdrift.operators.selection import Selection


def source(ctx, key):
    return ctx.fact_order if key == "details_of" else ctx.fact


@pytest.mark.parametrize("key", grids.GRIDS)
def test_columns_exist_and_rows_are_identified(ctx, key):
    spec = grids.GRIDS[key]
    df = grids.grid(key, source(ctx, key), Selection())
    assert {c.key for c in spec.columns} | spec.sortable <= set(df.columns)
    identity = [*spec.row_key, *[t for t, _ in spec.ties if t not in spec.row_key]]
    assert df.groupBy(*identity).count().filter("count > 1").count() == 0


def test_pages_cover_without_repeats(ctx):
    sel = Selection(date(1997, 1, 6), date(1997, 2, 24))
    df = grids.grid_details(ctx.fact, sel).cache()
    total = grids.page_total(df).first().total
    key = ["week_start", "parent_id", "component_id"]
    pages = [grids.page(df, "details", "line_status", False, n, 100).select(*key).collect()
             for n in range(1, total // 100 + 2)]
    rows = [tuple(r) for p in pages for r in p]
    assert len(rows) == len(set(rows)) == total
    assert len(grids.page(df, "details", size=10_000).collect()) == total
    df.unpersist()


def test_nulls_come_last_both_ways(ctx):
    df = grids.grid_details(ctx.fact, Selection())
    for desc in (True, False):
        first = grids.page(df, "details", "variance_pct", desc, 1, 20).collect()
        values = [r.variance_pct for r in first]
        assert None not in values and values == sorted(values, reverse=desc)


def test_unknown_sort_and_grid_are_refused(ctx):
    df = grids.grid_details(ctx.fact, Selection())
    for sort in ("week_label", "nope; DROP"):
        with pytest.raises(ValueError):
            grids.page(df, "details", sort)
    with pytest.raises(ValueError):
        grids.grid("other", ctx.fact, Selection())


def test_line_and_parent_production_are_not_multiplied(ctx):
    made = ctx.fact.groupBy("parent_id", "week_start").agg(F.max("produced_qty").alias("q"))
    want = made.agg(F.sum("q")).first()[0]
    for key in ("lines", "parents"):
        got = grids.grid(key, ctx.fact, Selection()).agg(F.sum("produced_qty")).first()[0]
        assert got == want


def test_export_columns_order_and_truncation(ctx):
    df = grids.grid_components(ctx.fact, Selection())
    rows = grids.export_rows(df, "components", ["abs_value", "ghost", "component_id"], 5)
    assert rows.columns == ["abs_value", "component_id"]
    values = [r.abs_value for r in rows.collect()]
    assert len(values) == 5 and values == sorted(values, reverse=True)
    visible = [c.key for c in grids.GRIDS["components"].columns if c.visible]
    assert grids.export_rows(df, "components", ["ghost"], 5).columns == visible
    assert grids.export_truncated(df, 5).first().truncated
    assert not grids.export_truncated(df).first().truncated


def test_tsv_text(spark):
    rows = spark.createDataFrame(
        [("0012", True, 1234567, 1.5, "a\tb\nc\rd", date(2026, 4, 1)),
         (None, False, None, -0.25, "12.50", None), ("x", None, 0, 100.0, "", None)],
        "code string, flag boolean, n long, v double, t string, d date",
    ).withColumn("m", F.col("v").cast("decimal(20,6)"))
    got = [tuple(r) for r in grids.tsv_format(rows).collect()]
    assert got == [
        ("0012", "Oui", "1234567", "1,5", "a b cd", "2026-04-01", "1,5"),
        ("", "Non", "", "-0,25", "12.50", "", "-0,25"),
        ("x", "", "0", "100", "", "", "100"),
    ]


def test_doubles_as_text_keep_all_digits(spark):
    values = [1e7, 123456789.125, 1e19, 1e33, 0.00012345678901, 1e-7, 2.5, 1e-30, -1e8, float("nan"), 0.1234567891]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.v for r in grids.tsv_format(rows).collect()]
    assert got == [
        "10000000", "123456789,125", "10000000000000000000", "1,0E33", "0,00012345678901", "0,0000001", "2,5", "1,0E-30",
        "-100000000", "NaN", "0,1234567891",
    ]
    exact = spark.sql("SELECT 1.123456789000BD AS a, 100BD AS b, CAST(1E30 AS DECIMAL(38,2)) AS c")
    assert tuple(grids.tsv_format(exact).first()) == ("1,123456789", "100", "1" + "0" * 30)
