"""The daily job: from the source tables, by name, to a published model.

    spark-submit -m bomdrift.plans.job --sources s3a://lake/sources --out s3a://lake/model --published s3a://lake/served --date-from 2026-03-30
"""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from bomdrift.plans import build, publish
from bomdrift.plans.versions import Store
from bomdrift.session import DEFAULTS
from bomdrift.sources import views


def run(
    spark: SparkSession, params: build.Params, out_dir: str, published_dir: str, location: str | None = None,
    names: Mapping[str, str] | None = None, tables: Sequence[str] | None = None, run_id: str | None = None,
) -> dict[str, int]:
    """Read the sources from a folder or the catalog, build the model, publish it, remove old versions; rows by table.

    Every source that is missing or lacks columns is named in one error, before anything is written.
    """
    for key, value in DEFAULTS.items():  # results depend on the time zone, run time on the rest
        spark.conf.set(key, value)
    found = views.read_sources(spark, location, names)
    problems = views.check_source_columns(spark, found).collect()  # a row for each source at most
    if problems:
        raise build.SourceContractError("; ".join(f"{p.table}: {p.missing} ({p.available})" for p in problems))
    model = build.build(spark, views.Sources(**found), params, out_dir)
    counts = publish.publish(spark, model, published_dir, tables, run_id or uuid.uuid4().hex)
    for root in (out_dir, published_dir):
        Store(spark, root).vacuum()
    return counts


def main(args: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--sources", help="folder of the source tables; without it they are read from the catalog")
    parser.add_argument("--out", required=True, help="folder of the model")
    parser.add_argument("--published", required=True, help="folder of the published tables")
    parser.add_argument("--date-from", required=True, help="first day of the model, YYYY-MM-DD")
    parser.add_argument("--tolerance", type=float, default=0.5)
    parser.add_argument("--tables", nargs="*", help="tables to publish; all without it")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("bomdrift").getOrCreate()
    counts = run(spark, build.Params(given.date_from, given.tolerance), given.out, given.published, given.sources, tables=given.tables)
    print("\n".join(f"{name} {rows}" for name, rows in counts.items()))


if __name__ == "__main__":
    main()
