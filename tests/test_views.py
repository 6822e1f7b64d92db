from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.sources import views


def test_movements_keep_physical_live_rows_only(table):
    good = {"inventtransorigin": 1, "itemid": "A", "qty": 2, "datephysical": date(2026, 4, 1),
            "dataareaid": "C1", "isdelete": False}
    raw = table(S.SOURCES["invent_trans"], [
        good, good | {"isdelete": None}, good | {"isdelete": True}, good | {"qty": 0},
        good | {"qty": None}, good | {"datephysical": None},
        good | {"deleted_at": datetime(2026, 4, 2)}, good | {"dataareaid": "C2"},
    ])
    assert views.movements(raw).count() == 3
    assert views.movements(raw, F.col("dataareaid") == "C1").count() == 2


def test_sentinel_close_date_is_null(table):
    rows = [("a", datetime(1900, 1, 1)), ("b", datetime(1899, 12, 31, 22)), ("c", None),
            ("d", datetime(2026, 4, 1)), ("e", datetime(1901, 1, 1))]
    raw = table(S.SOURCES["prod_table"], [{"prodid": i, "finisheddate": d} for i, d in rows])
    got = {r.order_id: r.close_date for r in views.orders(raw).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": datetime(2026, 4, 1), "e": None}


def test_latest_item_version(table):
    t = [datetime(2026, 1, n) for n in range(1, 5)]
    raw = table(S.SOURCES["silver_base_article"], [
        {"item_id": "A", "item_name": "old", "product_modified_at": t[0], "product_recid": 9},
        {"item_id": "A", "item_name": "new", "product_created_at": t[2], "product_recid": 1},
        {"item_id": "A", "item_name": "never", "product_recid": 99},
        {"item_id": "B", "item_name": "low", "product_modified_at": t[1], "product_recid": 1},
        {"item_id": "B", "item_name": "high", "product_modified_at": t[1], "product_recid": 2},
        {"item_id": "C", "item_name": "none"},
    ])
    got = {r.item_id: r.item_name for r in views.items(raw).collect()}
    assert got == {"A": "new", "B": "high", "C": "none"}


def test_bom_lines_and_made_products(table):
    line = {"bomid": "B", "parent_itemid": "P", "statut": "Actif", "child_itemid": "X",
            "child_qty": 1}
    raw = table(S.SOURCES["silver_bom"], [
        line, line | {"statut": "Inactif"}, line | {"child_itemid": None},
        line | {"parent_itemid": None}, line | {"child_qty": 0}, line | {"child_qty": None},
    ])
    assert views.bom_lines(raw).count() == 1
    made = table(S.SOURCES["produits_fabriques"], [
        {"ref_parent": "P", "ligne_de_prod": "L2"}, {"ref_parent": "P", "ligne_de_prod": "L1"},
        {"ref_parent": "Q", "ligne_de_prod": "  "}, {"ref_parent": "R"},
        {"ligne_de_prod": "L1"},
    ])
    assert [(r.parent_id, r.line) for r in views.made_products(made).collect()] == [("P", "L1")]


def test_contract_reports_every_table_at_once(spark, table):
    frames = {name: table(schema, []) for name, schema in S.SOURCES.items()}
    assert views.check_source_columns(spark, frames).count() == 0
    frames["silver_bom"] = frames["silver_bom"].withColumnRenamed("bomid", "BOMID")
    assert views.check_source_columns(spark, frames).count() == 0
    frames["invent_trans"] = frames["invent_trans"].drop("qty", "itemid")
    frames["prod_table"] = ValueError("no access\nstack")
    del frames["produits_fabriques"]
    got = {r.table: (r.missing, r.available) for r in
           views.check_source_columns(spark, frames).collect()}
    assert set(got) == {"invent_trans", "prod_table", "produits_fabriques"}
    assert got["invent_trans"][0] == "itemid, qty"
    assert got["prod_table"] == ("unreadable table", "ValueError: no access\nstack")
