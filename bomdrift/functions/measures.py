"""Variance columns of one reconciled row, and order status labels."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift import schemas as S


def number(value: float | int | Decimal) -> Column:
    """Exact decimal literal."""
    return F.lit(Decimal(str(value)))


def decimal_text(value: float | int | Decimal) -> str:
    """The number as an exact SQL literal."""
    return format(Decimal(str(value)), "f")


def zero() -> Column:
    return F.lit(0).cast(S.QTY)


def positive(value: Column) -> Column:
    """The value when above zero, else zero."""
    return F.greatest(value, zero())


def filled(column: str, default: str = S.UNKNOWN) -> Column:
    """Text with blank and NULL replaced by a default."""
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(default))


def ratio_pct(part: Column, whole: Column) -> Column:
    """part / whole in percent as a double; NULL unless whole is positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100)


def fixed_type(variance: Column, tolerance: float) -> Column:
    """Variance type stored with the fact, from the absolute tolerance of the build."""
    limit = number(tolerance)
    return (
        F.when(variance > limit, S.UNDER)
        .when(variance < -limit, S.OVER)
        .otherwise(S.CONFORMING)
    )


def variance_measures(df: DataFrame, tolerance: float) -> DataFrame:
    """Add variance, percentage, stored type, value and product equivalent.

    Needs expected_qty, actual_qty, bom_coef, unit_cost and is_uniform.
    """
    variance, expected = F.col("variance_qty"), F.col("expected_qty")
    return df.withColumn("variance_qty", F.col("expected_qty") - F.col("actual_qty")).withColumns(
        {
            "variance_pct": F.when(expected > 0, variance / expected * 100).cast(S.QTY),
            "variance_type": fixed_type(variance, tolerance),
            "variance_value": (variance * F.coalesce("unit_cost", zero())).cast(S.QTY),
            "product_equivalent": F.when(
                F.col("is_uniform") & (F.col("bom_coef") > 0), variance / F.col("bom_coef")
            ).cast(S.QTY),
        }
    )


def order_status_label(status: Column) -> Column:
    """Life-cycle label of an order status; NULL stays NULL, other codes stay visible."""
    known = reduce(
        lambda chain, item: chain.when(status == item[0], F.lit(item[1])),
        S.ORDER_STATUSES.items(),
        F.when(status.isNull(), F.lit(None).cast("string")),
    )
    return known.otherwise(F.concat(F.lit(S.UNKNOWN_ORDER_STATUS), status.cast("string"), F.lit(")")))


def order_status_rank(status: Column) -> Column:
    """Position of a status label in the life cycle; unknown labels come last."""
    chain = reduce(
        lambda chain, item: chain.when(status == item[1], F.lit(item[0])),
        S.ORDER_STATUSES.items(),
        F.when(status.isNull(), F.lit(None).cast("int")),
    )
    return chain.otherwise(len(S.ORDER_STATUSES))
