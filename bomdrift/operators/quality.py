"""Data-quality checks, gate and detail tables.

A check is one aggregate over one input. Checks that share an input share its scan: the
whole table needs one pass per input, not one per check.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.functions.measures import number
from bomdrift.operators.combine import one_row

LOGGER = logging.getLogger("bomdrift.quality")


@dataclass(frozen=True)
class Inputs:
    """What the checks read."""

    bom_lines: DataFrame
    items: DataFrame
    raw_movements: DataFrame
    dim_bom: DataFrame
    dim_line_coef: DataFrame
    fact_production: DataFrame
    fact_variance: DataFrame
    fact_variance_order: DataFrame
    agg_week: DataFrame
    date_from: str
    dq_pct: float = 5.0


@dataclass(frozen=True)
class Check:
    key: str
    name: str
    severity: str
    domain: str
    source: str
    value: Column
    message: str
    coverage: bool = False  # compared with the coverage threshold instead of zero


def _share(part: Column, whole: Column) -> Column:
    """Rounded percentage; NULL on an empty whole."""
    ratio = 100 * part.cast("double") / whole.cast("double")
    return F.when(whole != 0, F.round(ratio).cast("long"))


def _parents_several_versions(i: Inputs) -> DataFrame:
    versions = i.bom_lines.select("parent_id", "bom_id").distinct().groupBy("parent_id").count()
    return versions.filter(F.col("count") > 1)


def _production_with_bom(i: Inputs) -> DataFrame:
    known = i.dim_bom.select("parent_id").distinct().withColumn("has_bom", F.lit(True))
    return i.fact_production.select("parent_id", "parent_line", "produced_qty").join(
        known, "parent_id", "left"
    )


def _deleted_movements(i: Inputs) -> DataFrame:
    return i.raw_movements.filter(
        (F.col("datephysical") >= F.lit(i.date_from).cast("date"))
        & ((F.col("isdelete") == F.lit(True)) | F.col("deleted_at").isNotNull())
    )


def _grain_totals(i: Inputs) -> DataFrame:
    total = lambda df, column, name: df.agg(
        F.coalesce(F.sum(column), F.lit(0)).cast(S.QTY).alias(name)
    )
    return one_row(
        total(i.fact_variance_order, "variance_qty", "order_qty"),
        i.fact_variance.agg(
            F.coalesce(F.sum("variance_qty"), F.lit(0)).cast(S.QTY).alias("week_qty"),
            F.coalesce(F.sum("variance_value"), F.lit(0)).cast(S.QTY).alias("week_value"),
        ),
        total(i.agg_week, "variance_value", "agg_value"),
    )


_SOURCES = {
    "versions": _parents_several_versions,
    "fact": lambda i: i.fact_variance,
    "items": lambda i: i.items,
    "production": _production_with_bom,
    "line_coef": lambda i: i.dim_line_coef,
    "deleted": _deleted_movements,
    "fact_order": lambda i: i.fact_variance_order,
    "totals": _grain_totals,
}


def _checks() -> list[Check]:
    c = F.col
    rows = F.count(F.lit(1))
    component_if = lambda cond: F.countDistinct(F.when(cond, c("component_id")))
    sum_if = lambda cond, x: F.sum(F.when(cond, c(x)).otherwise(0))
    off = c("variance_type") != S.CONFORMING
    no_bom = c("has_bom").isNull()
    qty_gap = F.abs(F.max("order_qty") - F.max("week_qty"))
    qty_limit = F.greatest(number("0.01"), F.abs(F.max("week_qty")) * number("0.0001"))
    value_gap = F.abs(F.max("agg_value") - F.max("week_value"))
    flag = lambda bad: F.when(bad, 1).otherwise(0)
    return [
        Check("q1", "bom_multi_version", S.ALERT, "Nomenclature", "versions", rows,
              "Parents with several active BOM versions; one of them is used."),
        Check("q2", "composant_sans_cout_standard", S.ALERT, "Référentiel", "fact",
              component_if(c("unit_cost").isNull() & off),
              "Components in variance without a standard cost; valued at zero."),
        Check("q3", "article_hors_referentiel", S.ALERT, "Référentiel", "fact",
              component_if(c("component_name").isNull()),
              "Moved components missing from the item master."),
        Check("q4", "couverture_referentiel", S.ERROR, "Référentiel", "fact",
              _share(F.count_if(c("component_name").isNull()), rows),
              "Share of rows whose component is missing from the item master, in %.", True),
        Check("q5", "cout_standard_negatif", S.ALERT, "Référentiel", "items",
              F.count_if(c("unit_cost") < 0),
              "Items with a negative standard cost; the cost is ignored."),
        Check("q6", "lignes_hors_nomenclature", S.ALERT, "Cohérence", "fact",
              F.count_if(c("line_status") == S.OFF_BOM),
              "Consumed parent/component pairs without an expected row."),
        Check("q7", "parent_produit_sans_bom", S.ALERT, "Nomenclature", "production",
              F.countDistinct(F.when(no_bom, c("parent_id"))),
              "Produced parents without an active BOM."),
        Check("q8", "couverture_nomenclature", S.ERROR, "Nomenclature", "production",
              _share(sum_if(no_bom, "produced_qty"), F.sum("produced_qty")),
              "Share of produced quantity whose parent has no active BOM, in %.", True),
        Check("q9", "parent_sans_perimetre", S.ALERT, "Référentiel", "production",
              _share(sum_if(c("parent_line") == S.UNKNOWN, "produced_qty"),
                     F.sum("produced_qty")),
              "Share of produced quantity whose parent has no production line, in %."),
        Check("q10", "coef_non_uniforme", S.INFO, "Nomenclature", "line_coef",
              F.count_if(~c("is_uniform")),
              "Line and component pairs whose coefficient is not uniform."),
        Check("q11", "ecart_aberrant", S.ALERT, "Cohérence", "fact",
              F.count_if((c("expected_qty") > 0) & (F.abs("variance_pct") > 100)),
              "Rows with a variance above 100 % of the expected quantity."),
        Check("q12", "mouvements_supprimes_exclus", S.INFO, "Source", "deleted", rows,
              "Movements marked deleted in the source and left out."),
        Check("q13", "reconciliation_of_detail", S.ERROR, "Cohérence", "totals",
              flag(qty_gap > qty_limit),
              "The order-grain variance total differs from the week-grain total."),
        Check("q14", "of_statut_inconnu", S.ALERT, "Référentiel", "fact_order",
              F.count_if(c("order_status").startswith(S.UNKNOWN_ORDER_STATUS)),
              "Order rows whose status code is not in the known life cycle."),
        Check("q15", "reconciliation_agg_detail", S.ERROR, "Cohérence", "totals",
              flag(value_gap > number("0.01")),
              "The weekly aggregate's value total differs from the fact's."),
    ]


def _run(inputs: Inputs, wanted: list[Check]) -> DataFrame:
    """One aggregation per distinct input, unfolded to one row per check."""
    frames = []
    for source in dict.fromkeys(check.source for check in wanted):
        group = [check for check in wanted if check.source == source]
        values = _SOURCES[source](inputs).agg(*[k.value.cast("long").alias(k.key) for k in group])
        rows = F.array(
            *[
                F.struct(
                    F.lit(k.name).alias("check"),
                    F.lit(k.severity).alias("severity"),
                    F.lit(k.domain).alias("domain"),
                    F.col(k.key).alias("value"),
                    F.lit(int(inputs.dq_pct) if k.coverage else 0).cast("long").alias("threshold"),
                    F.lit(k.message).alias("message"),
                )
                for k in group
            ]
        )
        frames.append(values.select(F.inline(rows)))
    return reduce(lambda a, b: a.unionByName(b), frames).select(
        "check", "severity", "domain", "value", "threshold",
        (F.col("value") > F.col("threshold")).alias("in_anomaly"), "message",
    )


def check(inputs: Inputs, key: str) -> DataFrame:
    """One check, q1 to q15, as one row."""
    return _run(inputs, [k for k in _checks() if k.key == key])


def dq_checks(inputs: Inputs) -> DataFrame:
    """All checks, one row each."""
    return _run(inputs, _checks())


class DataQualityError(RuntimeError):
    """A blocking check is in anomaly."""


def dq_gate(dq: DataFrame, fail_on_error: bool = True) -> DataFrame:
    """Log the anomalies and refuse the run when a blocking one is present.

    Reads at most one row per check on the driver. Returns the anomalies.
    """
    anomalies = dq.filter("in_anomaly")
    found = anomalies.orderBy("severity", "check").collect()
    for row in found:
        LOGGER.warning("[%s] %s = %s (%s)", row.severity, row.check, row.value, row.message)
    blocking = [row for row in found if row.severity == S.ERROR]
    if blocking and fail_on_error:
        raise DataQualityError(
            "blocking checks in anomaly: "
            + "; ".join(f"{r.check} = {r.value} (threshold {r.threshold})" for r in blocking)
        )
    return anomalies


def dq_missing_items(fact: DataFrame) -> DataFrame:
    """Components missing from the item master, with the volume they carry."""
    return (
        fact.filter(F.col("component_name").isNull())
        .groupBy("component_id")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.countDistinct("parent_id").alias("parent_count"),
            F.countDistinct("parent_program").alias("program_count"),
            F.min("week_start").alias("first_week"),
            F.max("week_start").alias("last_week"),
            F.sum("actual_qty").alias("actual_qty"),
            F.sum("expected_qty").alias("expected_qty"),
            F.sum(F.abs("variance_qty")).alias("abs_qty"),
        )
    )


def dq_parents_without_bom(production: DataFrame, dim_bom: DataFrame) -> DataFrame:
    """Parents produced without a BOM, with the volume they carry."""
    return (
        production.join(dim_bom.select("parent_id"), "parent_id", "left_anti")
        .groupBy("parent_id")
        .agg(
            F.max("parent_name").alias("parent_name"),
            F.max("parent_program").alias("parent_program"),
            F.countDistinct("week_start").alias("week_count"),
            F.min("week_start").alias("first_week"),
            F.max("week_start").alias("last_week"),
            F.sum("produced_qty").alias("produced_qty"),
        )
    )
