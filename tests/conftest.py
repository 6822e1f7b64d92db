from __future__ import annotations

import os
import sys
import tempfile
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bomdrift import schemas as S  # noqa: E402
from bomdrift.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.maxMetadataStringLength": "5000",  # whole paths and filters in plans
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ctx(spark):
    from checks.context import context

    return context(spark, SMALL)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cast(value, kind):
    if value is None:
        return None
    return Decimal(str(value)) if isinstance(kind, S.T.DecimalType) else value


@pytest.fixture(scope="session")
def table(spark):
    """Rows of a declared schema from dicts; absent columns are NULL."""

    def make(schema, rows):
        data = [tuple(cast(r.get(f.name), f.dataType) for f in schema) for r in rows]
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture(scope="session")
def fact_rows(table):
    """A weekly fact with sensible defaults."""

    def make(rows):
        full = []
        for row in rows:
            base = {
                "week_start": date(2026, 3, 30), "parent_id": "P", "parent_program": "G",
                "parent_line": "L", "parent_name": "parent", "parent_category": "C",
                "component_id": "X", "component_name": "part", "component_category": "C",
                "component_program": "G", "component_unit": "PCE", "bom_coef": 1,
                "produced_qty": 0, "actual_qty": 0, "expected_qty": 0, "line_status": "nominal",
                "unit_cost": 1, "is_uniform": True, "issue_count": 1, "return_count": 0,
            } | row
            year, week, _ = base["week_start"].isocalendar()
            gap = base.get("variance_qty", base["expected_qty"] - base["actual_qty"])
            derived = {
                "iso_year": year, "iso_week": week, "variance_qty": gap,
                "variance_type": S.CONFORMING if abs(gap) <= 0.5 else S.UNDER if gap > 0 else S.OVER,
                "variance_value": gap * (base["unit_cost"] or 0),
            }
            if base["expected_qty"] > 0:
                derived["variance_pct"] = round(gap / base["expected_qty"] * 100, 4)
            if base["is_uniform"] and base["bom_coef"]:
                derived["product_equivalent"] = round(gap / base["bom_coef"], 6)
            full.append(derived | base)
        return table(S.TABLES["fact_variance"].schema, full)

    return make
