"""Declared schemas, primary keys and the labels shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

QTY = T.DecimalType(38, 6)
COST = T.DecimalType(18, 6)
MONEY = T.DecimalType(20, 6)
PCT = T.DecimalType(38, 4)

# Labels stored in the tables or accepted as filter values.
UNKNOWN = "UNKNOWN"
DEFAULT_UNIT = "PCE"
ACTIVE_BOM = "Actif"
RECEIPT, ISSUE = 2, 8
UNDER, OVER, CONFORMING = "under_consumption", "over_consumption", "conforming"
NOMINAL, OFF_BOM, NO_CONSUMPTION = "nominal", "off_bom", "no_consumption"
VARIANCE_TYPES = (UNDER, OVER, CONFORMING)
LINE_STATUSES = (NOMINAL, OFF_BOM, NO_CONSUMPTION)
ORDER_STATUSES = {
    0: "Aucun",
    1: "Créé",
    2: "Estimé",
    3: "Planifié",
    4: "Lancé",
    5: "Démarré",
    6: "Déclaré terminé",
    7: "Clôturé",
    8: "Annulé",
}
UNKNOWN_ORDER_STATUS = "Inconnu ("
ERROR, ALERT, INFO = "ERREUR", "ALERTE", "INFO"
LOAD_OK, LOAD_FAILED = "SUCCES", "ECHEC"



def fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


STR, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
BOOL, DATE, TS = T.BooleanType(), T.DateType(), T.TimestampType()


# Source contract: the six upstream tables and the columns the views read.
SOURCES: dict[str, T.StructType] = {
    "invent_trans": fields(
        ("inventtransorigin", LONG), ("itemid", STR), ("qty", QTY), ("datephysical", DATE),
        ("dataareaid", STR), ("isdelete", BOOL), ("deleted_at", TS),
    ),
    "invent_trans_origin": fields(
        ("recid", LONG), ("referencecategory", INT), ("referenceid", STR), ("itemid", STR),
        ("dataareaid", STR), ("isdelete", BOOL),
    ),
    "prod_table": fields(
        ("prodid", STR), ("itemid", STR), ("bomid", STR), ("prodstatus", LONG),
        ("finisheddate", TS), ("dataareaid", STR), ("isdelete", BOOL),
    ),
    "silver_bom": fields(
        ("bomid", STR), ("parent_itemid", STR), ("bom_version_name", STR), ("statut", STR),
        ("child_itemid", STR), ("child_qty", COST), ("child_unitid", STR),
        ("parent_physical_stock", COST), ("child_physical_stock", COST),
    ),
    "silver_base_article": fields(
        ("item_id", STR), ("item_name", STR), ("item_description", STR), ("categorie", STR),
        ("item_group_id", STR), ("item_group_label", STR), ("programme", STR),
        ("std_cost_price", COST), ("std_unit", STR), ("silver_refreshed_at", TS),
        ("product_recid", LONG), ("product_modified_at", TS), ("product_created_at", TS),
    ),
    "produits_fabriques": fields(
        ("ref_parent", STR), ("item_name", STR), ("type", STR), ("ligne_de_prod", STR),
    ),
}


@dataclass(frozen=True)
class Table:
    """A model table: ordered columns with their published types, and its primary key."""

    name: str
    key: tuple[str, ...]
    schema: T.StructType
    published: bool = True

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def project(self, df: DataFrame) -> DataFrame:
        """Ordered projection with the declared types; extra columns are pruned."""
        return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.schema])


def _table(name: str, key: tuple[str, ...], *columns: tuple[str, T.DataType], published=True):
    return Table(name, key, fields(*columns), published)


_WEEK = (("week_start", DATE), ("iso_year", INT), ("iso_week", INT))
_VARIANCE = (
    ("bom_coef", QTY), ("produced_qty", QTY), ("actual_qty", QTY), ("expected_qty", QTY),
    ("variance_qty", QTY), ("variance_pct", PCT), ("variance_type", STR), ("line_status", STR),
    ("unit_cost", MONEY), ("variance_value", MONEY), ("is_uniform", BOOL),
    ("product_equivalent", QTY), ("issue_count", INT), ("return_count", INT),
)
_PARENT = (
    ("parent_id", STR), ("parent_program", STR), ("parent_line", STR), ("parent_name", STR),
    ("parent_category", STR),
)

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        _table(
            "dim_item", ("item_id",),
            ("item_id", STR), ("item_name", STR), ("item_description", STR), ("category", STR),
            ("item_group_id", STR), ("item_group_label", STR), ("program", STR), ("line", STR),
            ("product_type", STR), ("unit_cost", MONEY), ("unit", STR), ("refreshed_at", TS),
        ),
        _table(
            "dim_bom", ("parent_id", "component_id"),
            ("parent_id", STR), ("component_id", STR), ("bom_id", STR), ("version_name", STR),
            ("status", STR), ("bom_coef", QTY), ("unit", STR), ("parent_stock", QTY),
            ("component_stock", QTY), ("bom_line_count", INT),
        ),
        _table(
            "dim_line_coef", ("line", "component_id"),
            ("line", STR), ("component_id", STR), ("program", STR), ("parent_count", INT),
            ("coef_min", QTY), ("coef_max", QTY), ("bom_coef", QTY), ("is_uniform", BOOL),
        ),
        _table(
            "fact_production", ("week_start", "parent_id"),
            *_WEEK, *_PARENT, ("produced_qty", QTY), ("receipt_count", INT),
            ("first_date", DATE), ("last_date", DATE),
        ),
        _table(
            "fact_consumption", ("week_start", "parent_id", "component_id"),
            *_WEEK, ("parent_id", STR), ("component_id", STR), ("parent_program", STR),
            ("actual_qty", QTY), ("issue_count", INT), ("return_count", INT),
            ("first_date", DATE), ("last_date", DATE),
        ),
        _table(
            "fact_variance", ("week_start", "parent_id", "component_id"),
            *_WEEK, *_PARENT,
            ("component_id", STR), ("component_name", STR), ("component_category", STR),
            ("component_program", STR), ("component_unit", STR), *_VARIANCE,
        ),
        _table(
            "fact_variance_order", ("week_start", "order_id", "parent_id", "component_id"),
            *_WEEK, ("order_id", STR), ("order_bom_id", STR), ("order_close_date", TS),
            ("order_status", STR), *_PARENT,
            ("component_id", STR), ("component_name", STR), ("component_category", STR),
            ("component_unit", STR), *_VARIANCE,
        ),
        _table(
            "agg_week_program_line", ("week_start", "program", "line"),
            *_WEEK, ("program", STR), ("line", STR), ("parent_count", INT),
            ("component_count", INT), ("row_count", INT), ("variance_row_count", INT),
            ("off_bom_count", INT), ("no_consumption_count", INT), ("expected_qty", QTY),
            ("actual_qty", QTY), ("variance_qty", QTY), ("under_qty", QTY), ("over_qty", QTY),
            ("variance_value", MONEY), ("under_value", MONEY), ("over_value", MONEY),
            ("abs_value", MONEY),
        ),
        _table(
            "agg_component", ("component_id", "parent_program", "parent_line"),
            ("component_id", STR), ("parent_program", STR), ("parent_line", STR),
            ("component_name", STR), ("component_category", STR), ("bom_coef", QTY),
            ("bom_coef_max", QTY), ("is_uniform", BOOL), ("parent_count", INT),
            ("active_week_count", INT), ("variance_week_count", INT), ("first_week", DATE),
            ("last_week", DATE), ("expected_qty", QTY), ("actual_qty", QTY),
            ("variance_qty", QTY), ("under_qty", QTY), ("over_qty", QTY), ("variance_pct", PCT),
            ("dominant_type", STR), ("product_equivalent", QTY), ("unit_cost", MONEY),
            ("variance_value", MONEY), ("abs_value", MONEY),
        ),
        _table(
            "dq_checks", ("check",),
            ("check", STR), ("severity", STR), ("domain", STR), ("value", LONG),
            ("threshold", LONG), ("in_anomaly", BOOL), ("message", STR),
        ),
        _table(
            "dq_missing_items", ("component_id",),
            ("component_id", STR), ("row_count", INT), ("parent_count", INT),
            ("program_count", INT), ("first_week", DATE), ("last_week", DATE),
            ("actual_qty", QTY), ("expected_qty", QTY), ("abs_qty", QTY), published=False,
        ),
        _table(
            "dq_parents_without_bom", ("parent_id",),
            ("parent_id", STR), ("parent_name", STR), ("parent_program", STR),
            ("week_count", INT), ("first_week", DATE), ("last_week", DATE),
            ("produced_qty", QTY), published=False,
        ),
    )
}

PUBLISHED = tuple(t.name for t in TABLES.values() if t.published)

# User-written tables.
EXCLUSION = fields(
    ("item_id", STR), ("reason", STR), ("modified_by", STR), ("modified_at", TS),
)
BOM_OVERRIDE = fields(
    ("parent_id", STR), ("component_id", STR), ("active", BOOL), ("bom_coef", QTY),
    ("reason", STR), ("modified_by", STR), ("modified_at", TS),
)
LOAD_LOG = fields(
    ("table_name", STR), ("source_table", STR), ("row_count", LONG), ("started_at", TS),
    ("ended_at", TS), ("duration_ms", LONG), ("status", STR), ("error_message", STR),
    ("run_id", STR),
)
COUNTS = fields(
    ("campaign_id", LONG), ("item_id", STR), ("qty_erp", MONEY), ("qty_counted", MONEY),
    ("previous_count", DATE), ("current_count", DATE),
)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
