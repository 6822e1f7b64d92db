from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.operators import grids, overrides, pages
from bomdrift.operators.selection import Selection
from bomdrift.plans import build, job, publish
from bomdrift.plans.versions import Store
from bomdrift.sources import views

ORDERS = [[("x", False), ("k", False)], [("x", True), ("k", False)], [("x", True), ("y", False), ("k", True)]]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [(k, r.choice([None, 1.5, 2.5, -1.0, 7.25]), r.choice([None, "a", "b", "é"])) for k in range(300)]
    return spark.createDataFrame(data, "k long, x double, y string").repartition(5).cache()


@pytest.mark.parametrize("order", ORDERS)
def test_bookmarks_turn_every_page(rows, order):
    want = [r.k for r in rows.orderBy(*pages.columns(order)).collect()]
    got, mark = [], None
    while page := pages.following(rows, order, mark, 43).collect():
        got += [r.k for r in page]
        mark = pages.bookmark(page[-1], order)
    assert got == want and len(got) == 300


@pytest.mark.parametrize("order", ORDERS)
def test_an_index_gives_any_page_from_its_ranges(spark, rows, folder, order):
    want = [r.k for r in rows.orderBy(*pages.columns(order)).collect()]
    index = pages.PageIndex.build(rows, order, f"{folder}/i", 40)
    assert index.total == 300 and len(index.counts) > 3
    for number in (1, 2, 5, 12, 13, 14):
        page = index.page(number, 25)
        assert [r.k for r in page.collect()] == want[(number - 1) * 25 : number * 25]
    plan = index.page(9, 25)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range_" in plan or "PartitionFilters: [isnotnull(range_" in plan
    assert pages.PageIndex.build(rows.limit(0), order, f"{folder}/none").page(1).count() == 0


def test_orders_are_whitelisted(ctx):
    for bad in (lambda: grids.order_of("details", "order_bom_id"), lambda: overrides.item_order("reason"), lambda: overrides.bom_order("bom_id")):
        with pytest.raises(ValueError, match="not allowed"):
            bad()
    items = overrides.item_catalogue(ctx.model["dim_item"], ctx.model["agg_component"], ctx.excluded)
    lines = overrides.bom_catalogue(ctx.model["dim_bom"], ctx.model["dim_item"], ctx.bom_over)
    assert set(overrides.ITEM_SORTS) <= set(items.columns) and set(overrides.BOM_SORTS) <= set(lines.columns)
    for call in (lambda: pages.following(items, overrides.item_order(), None, 0), lambda: grids.page(ctx.fact, "details", number=0)):
        with pytest.raises(ValueError, match="start at 1"):
            call()


def test_grid_pages_by_bookmark_are_those_by_offset(ctx):
    df, order = grids.grid_components(ctx.fact, Selection()), grids.order_of("components")
    first = grids.next_page(df, "components", None, size=20).collect()
    second = grids.next_page(df, "components", pages.bookmark(first[-1], order), size=20).collect()
    assert first + second == df.orderBy(*pages.columns(order)).limit(40).collect()


def test_the_job_goes_from_source_names_to_published_tables(spark, ctx, folder):
    for name, df in ctx.sources.as_dict().items():
        df.write.parquet(f"{folder}/sources/{'moves' if name == 'invent_trans' else name}")
    with pytest.raises(build.SourceContractError, match="invent_trans: unreadable"):
        job.run(spark, ctx.params, f"{folder}/model", f"{folder}/served", f"{folder}/sources")
    late = replace(ctx.params, date_from="2001-03-05")
    counts = job.run(spark, late, f"{folder}/model", f"{folder}/served", f"{folder}/sources", {"invent_trans": "moves"}, ["dim_bom", "fact_production"], "r7")
    assert list(counts) == ["dim_bom", "fact_production"] and set(Store(spark, f"{folder}/served").version().tables) == set(counts)
    for name in counts:
        served = views.read_table(spark, name, f"{folder}/served")
        assert served.exceptAll(S.TABLES[name].project(ctx.model[name])).count() == 0 and 0 < served.count() == counts[name]
    assert {r.run_id for r in publish.read_log(spark, f"{folder}/served").collect()} == {"r7"}
    with pytest.raises(ValueError, match="unknown tables"):
        publish.publish(spark, ctx.model, f"{folder}/served", ["x"])
