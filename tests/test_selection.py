from __future__ import annotations

from datetime import date

import pytest

from bomdrift import schemas as S
from bomdrift.operators.analytics import kpis
from bomdrift.operators.selection import Selection, preset, selection_for_check


@pytest.mark.parametrize("bad", [
    {"date_from": date(2026, 2, 2), "date_to": date(2026, 1, 1)}, {"types": ("other",)},
    {"line_statuses": ("other",)}, {"tolerance": -1}, {"tolerance": 2_000_000},
    {"tolerance_pct": 101}, {"tolerance_pct": -1}, {"min_impact": -1},
])
def test_invalid_values_are_refused(bad):
    with pytest.raises(ValueError):
        Selection(**bad)


def test_lists_and_search_are_cleaned():
    sel = Selection(programs=(" A", "B", "A ", " "), search="  x ")
    assert sel.programs == ("A", "B") and sel.search == "x"
    assert Selection(search="   ").search is None


def test_previous_period():
    sel = Selection(date(2026, 3, 30), date(2026, 6, 22), weeks=(date(2026, 4, 6),), lines=("L",))
    before = sel.previous()
    assert before.date_to == date(2026, 3, 23)
    assert before.date_to - before.date_from == sel.date_to - sel.date_from
    assert before.weeks == () and before.lines == ("L",)
    open_ended = Selection(date_from=date(2026, 1, 5)).previous()
    assert open_ended.date_from is None and open_ended.date_to is None
    assert sel.without_dates() == Selection(lines=("L",))


def test_pattern_characters_are_literal(fact_rows):
    names = ["100%_x part", "100 percent", "a\\b", "ab", "Éclair"]
    fact = fact_rows([{"component_id": str(i), "component_name": n} for i, n in enumerate(names)])
    hits = lambda term: {
        r.component_id for r in Selection(search=term).apply(fact).collect()}
    assert hits("100%_X") == {"0"}
    assert hits("a\\b") == {"2"}
    assert hits("éCLAIR") == {"4"}
    assert hits("PARENT") == set("01234")
    assert hits("zzz") == set()


def test_relative_tolerance_only_adds_conformity(ctx):
    conforming = lambda s: ctx.fact.filter(s.variance_type() == S.CONFORMING).count()
    counts = [conforming(Selection(tolerance_pct=p)) for p in (None, 0, 5, 50, 100)]
    assert counts == sorted(counts) and counts[0] < counts[-1]


def test_variance_type_boundaries(fact_rows):
    fact = fact_rows([
        {"component_id": "a", "expected_qty": 0.5}, {"component_id": "b", "actual_qty": 0.5},
        {"component_id": "c", "expected_qty": 0.500001}, {"component_id": "d", "actual_qty": 1},
    ])
    got = {r.component_id: r.t for r in
           fact.select("component_id", Selection().variance_type().alias("t")).collect()}
    assert got == {"a": S.CONFORMING, "b": S.CONFORMING, "c": S.UNDER, "d": S.OVER}


def test_order_filters_are_ignored_without_the_order_axis(ctx):
    sel = Selection(orders=("OF-1",), order_statuses=("Clôturé",))
    assert sel.conditions(ctx.fact.columns) == []
    assert len(sel.conditions(ctx.fact_order.columns)) == 2


def test_presets_are_clipped_to_history(fact_rows):
    weeks = [date(2025, 12, 22), date(2026, 1, 5), date(2026, 2, 2)]
    fact = fact_rows([{"week_start": w} for w in weeks])
    bounds = lambda name: (preset(fact, name).date_from, preset(fact, name).date_to)
    assert bounds("4") == (date(2026, 1, 12), weeks[2])
    assert bounds("52") == (weeks[0], weeks[2]) == bounds("all")
    assert bounds("ytd") == (date(2026, 1, 5), weeks[2])
    assert preset(fact).date_from == weeks[0]
    assert preset(fact.limit(0)) == Selection()
    with pytest.raises(ValueError):
        preset(fact, "5")


def test_checks_without_rows_have_no_selection():
    assert selection_for_check("couverture_referentiel") is None
    assert selection_for_check("ecart_aberrant").tolerance_pct == 100


def test_tables_of_keys(fact_rows, spark):
    fact = fact_rows([{"parent_id": p, "component_id": c, "week_start": w, "expected_qty": 5}
                      for p in ("P1", "P2", "P3") for c in ("A", "B")
                      for w in (date(2026, 3, 30), date(2026, 4, 6))])
    parents = spark.createDataFrame([("P1",), ("P1",), ("P3",), (None,), ("no",)], "parent_id string")
    pairs = spark.createDataFrame([("P1", "A"), ("P2", "A")], "parent_id string, component_id string")
    other = spark.createDataFrame([("O",)], "order_id string")
    sel = Selection(tables=(parents,))
    assert sel.apply(fact).count() == 8 and sel.with_(components=("A",)).apply(fact).count() == 4
    assert sel.with_(tables=(parents, pairs)).apply(fact).count() == 2
    assert sel.with_(tables=(other,)).apply(fact).count() == 12  # no such column: does not bear on the fact
    assert sel.with_(tables=(parents.limit(0),)).apply(fact).count() == 0
    week = Selection(date(2026, 4, 6), date(2026, 4, 6), tables=(parents,))
    shown = {r.indicator: (r.value, r.change) for r in kpis(fact, week).collect()}
    assert shown["under_consumption"] == (20.0, 0.0)
