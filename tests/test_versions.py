"""Versions of written tables, publication of what changed, and the log of user edits."""

from __future__ import annotations

import glob
import os
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.operators import overrides, zones
from bomdrift.operators.selection import Selection
from bomdrift.plans import build, publish, storage
from bomdrift.plans.edits import EditLog, UserEdits
from bomdrift.plans.versions import Store, digest_of
from bomdrift.sources import views


def facts(spark, weeks, factor=1):
    """Rows of some pairs in each of the weeks (Mondays from 2024-01-01)."""
    n = F.col("id")
    return spark.range(40 * len(weeks)).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.element_at(F.array(*map(F.lit, weeks)), (n % len(weeks) + 1).cast("int")) * 7).alias("week_start"),
        F.concat(F.lit("P"), n % 7).alias("parent_id"), F.concat(F.lit("C"), F.floor(n / len(weeks))).alias("component_id"),
        (n * factor).cast("decimal(38,6)").alias("actual_qty"),
    )


def files(folder):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


#: Builds of a few weeks.
LATE = "2001-03-05"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("buckets", [0, 1, 4])
def test_a_table_kept_by_week_reads_back_and_opens_the_weeks_asked_for(spark, folder, buckets):
    store, df = Store(spark, folder), facts(spark, range(10))
    store.commit({"fact": store.stage("fact", df, True, buckets)})
    back = store.read("fact")
    assert back.dtypes == df.dtypes and same(back, df)
    four = back.where("week_start BETWEEN DATE'2024-01-15' AND DATE'2024-02-05'")
    assert {p.split("week_start=")[1][:10] for p in four.inputFiles()} == {"2024-01-15", "2024-01-22", "2024-01-29", "2024-02-05"}
    plan = four._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week_start" in plan


def test_digests_follow_rows_and_not_their_order(spark):
    df = facts(spark, range(3))
    of = lambda x: x.agg(digest_of(x)).first()[0]
    assert of(df) == of(df.repartition(7).sortWithinPartitions("actual_qty"))
    assert len({of(df), of(df.union(df.limit(1))), of(df.withColumn("actual_qty", F.col("actual_qty") + 1)), of(df.limit(0))}) == 4


def test_readers_of_a_version_finish_while_the_next_is_published(spark, folder):
    store = Store(spark, folder)
    old, new = facts(spark, [0, 1]), facts(spark, [0, 1, 2], 3)
    store.commit({"fact": store.stage("fact", old, True, 2), "dim": store.stage("dim", old.limit(3))})
    reader, dim = store.read("fact"), store.read("dim")
    assert store.commit({"fact": store.stage("fact", new, True, 2)}) == 2
    assert same(reader, old) and same(store.read("fact"), new) and same(store.read("dim"), dim)
    assert same(Store(spark, folder).read("fact", store.version(1).tables["fact"]), old)


def test_a_run_killed_at_any_step_leaves_the_last_version(spark, folder):
    store, df = Store(spark, folder), facts(spark, [0])
    store.commit({"fact": store.stage("fact", df, True, 2)})
    store.stage("fact", facts(spark, [4]), True, 2)  # killed after the data
    assert same(store.read("fact"), df)
    for text in ("", '{"tables": {"fact"'):  # killed while it wrote the manifest
        number = max(store._numbers()) + 1
        assert storage.create_text(spark, store._manifest(number), text)
        assert same(store.read("fact"), df)
    assert not storage.create_text(spark, store._manifest(1), "{}")
    next_ = store.commit({"dim": store.stage("dim", df)})
    assert next_ == 4 and set(store.version().tables) == {"fact", "dim"}


def test_vacuum_keeps_named_weeks_young_folders_and_strangers(spark, folder):
    store = Store(spark, folder)
    first = store.stage("fact", facts(spark, [0, 1]), True, 2)
    store.commit({"fact": first})
    storage.create_text(spark, f"{folder}/load_log/row", "x")
    kept = {"2024-01-01": first.parts["2024-01-01"]}
    for factor in (2, 3, 4):
        store.commit({"fact": store.stage("fact", facts(spark, [1], factor), True, 2, reuse=replace(first, parts=kept))})
    orphan = store.stage("fact", facts(spark, [9]), True, 2)
    assert store.vacuum(keep=2) == []  # all are younger than the grace
    gone = store.vacuum(keep=2, grace_hours=-1)
    assert any(p.path.startswith(g) for p in orphan.parts.values() for g in gone) and first.parts["2024-01-08"].path in gone
    assert first.parts["2024-01-01"].path not in gone and os.path.exists(f"{folder}/load_log/row")
    assert store.read("fact").count() == 80 and len(store._numbers()) == 2


def model_of(ctx, spark, folder, df, zone=None):
    """A written model with one fact, as the build keeps it."""
    name = "fact_production"
    rows = S.TABLES[name].project(df)
    store = Store(spark, folder)
    entry = store.stage(name, rows, True, 0)
    store.commit({name: entry})
    return build.Model(ctx.sources, ctx.params, {name: store.read(name, entry)}, {name: entry})


def test_publication_writes_the_weeks_that_changed(spark, ctx, folder):
    fact = ctx.model["fact_production"]
    weeks = [r[0] for r in fact.select("week_start").distinct().orderBy("week_start").limit(6).collect()]
    few = fact.where(F.col("week_start").isin(weeks[:5]))
    out = f"{folder}/out"
    assert publish.publish(spark, model_of(ctx, spark, f"{folder}/m1", few), out, ["fact_production"], "r1") == {"fact_production": few.count()}
    before = files(out)
    publish.publish(spark, model_of(ctx, spark, f"{folder}/m2", few.repartition(3)), out, ["fact_production"], "r2")
    assert {k: v for k, v in files(out).items() if "fact_production" in k} == {k: v for k, v in before.items() if "fact_production" in k}
    assert Store(spark, out).version().number == 1
    # one week changed, one came, one went
    changed = few.where(F.col("week_start") != weeks[0]).withColumn("produced_qty", F.when(F.col("week_start") == weeks[2], F.col("produced_qty") + 1).otherwise(F.col("produced_qty")))
    changed = changed.union(fact.where(F.col("week_start") == weeks[5]))
    counts = publish.publish(spark, model_of(ctx, spark, f"{folder}/m3", changed), out, ["fact_production"], "r3")
    written = {p.split("week_start=")[1][:10] for p in set(files(out)) - set(before) if "week_start=" in p}
    assert written == {weeks[2].isoformat(), weeks[5].isoformat()}
    assert same(views.read_table(spark, "fact_production", out), S.TABLES["fact_production"].project(changed))
    assert counts["fact_production"] == changed.count()
    log = {r.run_id: r.row_count for r in spark.read.parquet(f"{out}/{publish.LOG_NAME}").collect()}
    assert log == {"r1": few.count(), "r2": few.count(), "r3": changed.count()}


def test_a_second_build_is_a_version_and_leaves_other_files_alone(spark, ctx, folder):
    storage.create_text(spark, f"{folder}/notes/own.txt", "mine")
    late = replace(ctx.params, date_from=LATE)
    model = build.build(spark, ctx.sources, late, folder)
    again = build.build(spark, ctx.sources, late, folder)
    store = Store(spark, folder)
    assert store.version().number == 2 and os.path.exists(f"{folder}/notes/own.txt")
    for name in ("fact_variance", "fact_variance_order", "dim_bom"):
        assert again.entries[name].same(model.entries[name]) and model[name].count() == model.entries[name].rows
    stored = build.stored_model(spark, ctx.sources, late, folder)
    assert same(stored["agg_component"], model["agg_component"])


def test_zone_maps_are_those_of_the_fact(spark, ctx):
    fact, order = ctx.raw_fact, ctx.model["fact_variance_order"]
    from bomdrift.operators.analytics import filter_options

    assert same(zones.filter_options(ctx.zones, ctx.model["zones_order"]), filter_options(fact, order))
    assert ctx.zones.agg(F.sum("row_count")).first()[0] == fact.count()
    assert zones.filter_options(ctx.zones.limit(0), ctx.model["zones_order"].limit(0)).where("value IS NOT NULL").count() == 0


# -- edits -------------------------------------------------------------------------

AT = [datetime(2026, 1, d) for d in range(1, 20)]


def test_edits_follow_each_other_and_lose_nothing(spark, folder):
    one, two = UserEdits(spark, folder), UserEdits(spark, folder)
    one.exclude(("A", "B", "B"), "broken", "ann", AT[0])
    two.exclude(("B", "C"), "test", "bob", AT[1])  # neither has read the other's
    one.include(("C",), AT[2])
    got = {r.item_id: (r.reason, r.modified_by, r.modified_at) for r in two.excluded.current().collect()}
    assert got == {"A": ("broken", "ann", AT[0]), "B": ("test", "bob", AT[1])}
    two.exclude(("C",), "again", "bob", AT[3])
    assert {r.item_id for r in one.excluded.current().collect()} == {"A", "B", "C"}
    assert one.overridden.current().count() == 0
    one.override((("P", "X"), ("P", "Y")), True, 2.5, None, "ann", AT[4])
    one.override((("P", "X"),), False, None, "gone", "ann", AT[5])
    two.reset((("P", "Y"),), AT[6])
    assert [tuple(r)[:4] for r in two.overridden.current().collect()] == [("P", "X", False, None)]
    for bad in (0, -1):
        with pytest.raises(ValueError, match="positive"):
            one.override((("P", "X"),), True, bad, None, None, AT[7])
    with pytest.raises(ValueError, match="no row"):
        one.exclude((), None, None, AT[7])


def test_an_edit_made_late_does_not_undo_a_later_one(spark, folder):
    log = UserEdits(spark, folder)
    log.include(("A",), AT[5])
    log.exclude(("A",), "slow network", "ann", AT[1])
    assert log.excluded.current().count() == 0


def test_sums_of_edits_stand_beside_what_they_cover(spark, folder):
    edits = UserEdits(spark, folder)
    for k in range(4):
        edits.exclude((f"I{k}", "I0"), str(k), "ann", AT[k])
    edits.include(("I1",), AT[5])
    log = edits.excluded
    want = sorted(map(tuple, log.current().collect()))
    summed = log.compact()
    assert sorted(map(tuple, log.current().collect())) == want and len(log.edits()) == 6
    edits.exclude(("I9",), "later", "bob", AT[6])
    assert log.compact(grace_hours=-1) and summed in log.edits()  # what the first sum covers is gone
    assert len(log.edits()) == 3
    assert sorted(map(tuple, log.current().collect())) == sorted([*want, ("I9", "later", "bob", AT[6])])
    # an edit that died before its end is passed over
    os.makedirs(f"{log.root}/dead/_temporary")
    assert log.current().count() == len(want) + 1


def test_adjustments_are_the_three_joins_in_one(spark, ctx):
    for fact, got in ((ctx.raw_fact, ctx.fact), (ctx.model["fact_variance_order"], ctx.fact_order)):
        assert same(got, overrides.effective(fact, ctx.bom_over, ctx.excluded))
    pairs = ctx.model["fact_pairs"]
    lines = spark.createDataFrame([("P-0", "C-0", None, Decimal(2), None, None, None)], S.BOM_OVERRIDE)
    changes = overrides.adjustments(pairs, lines, overrides.empty_exclusions(spark)).collect()
    assert [(r.dropped, r.override_coef) for r in changes] == [(False, Decimal(2))]


def test_pairs_are_joined_without_a_shuffle_of_the_fact(spark, ctx, folder):
    from bomdrift.operators import analytics, grids

    model = build.build(spark, ctx.sources, replace(ctx.params, buckets=4, date_from=LATE), folder)
    changes = overrides.adjustments(model["fact_pairs"], ctx.bom_over, ctx.excluded)
    store = Store(spark, f"{folder}/user")
    adjusted = store.read("adjustments", store.stage("adjustments", changes, buckets=4))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        week, order = (overrides.adjusted(model[n], adjusted) for n in ("fact_variance", "fact_variance_order"))
        for df in (week, order):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        sel = Selection(date(2001, 3, 5), date(2001, 4, 30))
        served = [analytics.aggregate(week, sel), analytics.kpis(week, sel), grids.grid_components(week, sel), grids.grid_details_of(order, sel),
                  analytics.distribution(week, sel, "line"), analytics.totals(order, sel)]
        for df in served:
            plan = df._jdf.queryExecution().executedPlan().toString()
            # below each join there is a scan and a sort, and no exchange
            for side in plan.split("SortMergeJoin")[1:]:
                if "adjustments" in side[:4000]:
                    assert "Exchange" not in side[: side.index("adjustments")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_keys_within_buckets_are_checked_without_a_shuffle(spark, ctx, folder):
    model = build.build(spark, ctx.sources, replace(ctx.params, buckets=4, date_from=LATE), folder)
    keys = model["fact_variance"].groupBy(*S.TABLES["fact_variance"].key).agg(F.count(F.lit(1)))
    assert "Exchange" not in keys._jdf.queryExecution().executedPlan().toString()
