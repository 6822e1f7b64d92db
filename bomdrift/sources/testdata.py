"""Mapping of the driver's test tables to the source tables (FIXTURES.md §3).

Two choices keep every derived table growing with its inputs and free of hot windows:
parents come from `customer`, items from the whole of `part`, and an issue origin is one
(order, line number) pair, which repeated line numbers share as several movements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.plans import storage
from bomdrift.sources.views import Sources

# Fixed values of the mapping.
PARENTS = 40
COMPANY = "C1"
DATE_FROM = "1995-01-01"
#: Bytes of a file of order lines for which a shuffle has a partition.
BYTES_PER_PARTITION = 8_000_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.SOURCES[name]])


def _key(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _component_key() -> Column:
    p, j = F.col("p"), F.col("j")
    return 40 + (p % 8) * 7 + j + F.when(p % 16 >= 8, 2).otherwise(0)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_custkey") % PARENTS).alias("p"),
        F.col("o_orderdate").cast("date").alias("d"),
        F.col("o_orderstatus").alias("status"),
    )


def _dealt(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Order lines by order, in more tasks than a shuffle has where their files ask for it."""
    tasks = -(-storage.files_size(spark, lines) // BYTES_PER_PARTITION)
    return lines.repartition(tasks, "k") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else lines


def invent_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = _orders(spark, sf_dir).select(
        (F.col("k") * 1000).alias("inventtransorigin"),
        _key("PAR-", F.col("p")).alias("itemid"),
        (1 + F.col("k") % 50).alias("qty"),
        F.col("d").alias("datephysical"),
        F.lit(COMPANY).alias("dataareaid"),
        F.lit(False).alias("isdelete"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    lines = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"),
        F.when((F.col("l_returnflag") == "R") & (F.col("k") % 4 == 0), F.col("l_quantity"))
        .otherwise(-F.col("l_quantity")).alias("qty"),
        (F.col("l_partkey") % 3).cast("int").alias("days"),
        (F.col("l_partkey") % 101 == 0).alias("deleted"),
    )
    issues = (
        _dealt(spark, lines.filter(F.col("k") % 50 != 0))
        .join(_orders(spark, sf_dir), "k")
        .select(
            (F.col("k") * 1000 + 1 + F.col("j")).alias("inventtransorigin"),
            _key("CMP-", _component_key()).alias("itemid"),
            "qty",
            F.date_add("d", "days").alias("datephysical"),
            F.lit(COMPANY).alias("dataareaid"),
            F.col("deleted").alias("isdelete"),
            F.lit(None).cast("timestamp").alias("deleted_at"),
        )
    )
    return _typed(receipts, "invent_trans").unionByName(_typed(issues, "invent_trans"))


def invent_trans_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = [
        _key("OF-", F.col("k")).alias("referenceid"),
        F.lit(COMPANY).alias("dataareaid"),
        F.lit(False).alias("isdelete"),
    ]
    receipts = _orders(spark, sf_dir).select(
        (F.col("k") * 1000).alias("recid"),
        F.lit(S.RECEIPT).alias("referencecategory"),
        _key("PAR-", F.col("p")).alias("itemid"),
        *shared,
    )
    lines = (
        _read(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"))
        .filter(F.col("k") % 50 != 0)
    )
    # Dealt once, for the distinct rows and the join.
    pairs = _dealt(spark, lines.repartition("k")).distinct()
    issues = pairs.join(_orders(spark, sf_dir), "k").select(
        (F.col("k") * 1000 + 1 + F.col("j")).alias("recid"),
        F.lit(S.ISSUE).alias("referencecategory"),
        _key("CMP-", _component_key()).alias("itemid"),
        *shared,
    )
    name = "invent_trans_origin"
    return _typed(receipts, name).unionByName(_typed(issues, name))


def prod_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status = F.col("k"), F.col("status")
    return _typed(
        _orders(spark, sf_dir).select(
            _key("OF-", k).alias("prodid"),
            _key("PAR-", F.col("p")).alias("itemid"),
            F.concat(F.lit("BOM-"), F.col("p").cast("string"), F.lit("-V1")).alias("bomid"),
            F.when(k % 997 == 0, 9).when(status == "F", 7).when(status == "P", 5).otherwise(4)
            .alias("prodstatus"),
            F.when(status == "F", F.date_add("d", 6)).otherwise(F.lit("1900-01-01").cast("date"))
            .alias("finisheddate"),
            F.lit(COMPANY).alias("dataareaid"),
            F.lit(False).alias("isdelete"),
        ),
        "prod_table",
    )


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer")
    return customers.select((F.col("c_custkey") % PARENTS).alias("p")).distinct()


def silver_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, j = F.col("p"), F.col("j")
    lines = (
        _parents(spark, sf_dir)
        .filter(p < PARENTS - 1)
        .select("p", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("j"))
        .select("p", "j", _component_key().alias("c"))
        .withColumn("bumped", F.when((p % 16 == 3) & (j == 4), 1).otherwise(0))
        .withColumn(
            "version",
            F.explode(F.when(p % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))),
        )
    )
    version = _key("V", F.col("version"))
    return _typed(
        lines.select(
            F.concat(F.lit("BOM-"), p.cast("string"), F.lit("-"), version).alias("bomid"),
            _key("PAR-", p).alias("parent_itemid"),
            version.alias("bom_version_name"),
            F.lit(S.ACTIVE_BOM).alias("statut"),
            _key("CMP-", F.col("c")).alias("child_itemid"),
            (1 + F.col("c") % 4 + F.col("bumped") + 1 - F.col("version")).alias("child_qty"),
            F.lit("PCE").alias("child_unitid"),
            (p * 10).alias("parent_physical_stock"),
            (F.col("c") * 5).alias("child_physical_stock"),
        ),
        "silver_bom",
    )


def _item_id(key: Column) -> Column:
    return F.when(key < PARENTS, _key("PAR-", key)).otherwise(_key("CMP-", key))


def silver_base_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, stale = F.col("p_partkey"), F.col("stale")
    rows = (
        _read(spark, sf_dir, "part")
        .filter((key < PARENTS) | (key % 37 != 0))
        .withColumn(
            "stale",
            F.explode(
                F.when(key % 10 == 0, F.array(F.lit(False), F.lit(True)))
                .otherwise(F.array(F.lit(False)))
            ),
        )
    )
    cost = F.col("p_retailprice").cast(S.COST)
    return _typed(
        rows.select(
            _item_id(key).alias("item_id"),
            F.when(stale, F.concat(F.lit("old "), F.col("p_name"))).otherwise(F.col("p_name"))
            .alias("item_name"),
            F.concat_ws(" ", "p_brand", "p_type").alias("item_description"),
            F.col("p_type").alias("categorie"),
            F.col("p_brand").alias("item_group_id"),
            F.concat(F.lit("Group "), F.col("p_brand")).alias("item_group_label"),
            _key("PRG-", key % 4).alias("programme"),
            F.when(key % 25 == 0, F.lit(None)).when(key % 47 == 0, -cost).otherwise(cost)
            .alias("std_cost_price"),
            F.when(key % 6 == 0, F.lit(" ")).when(key % 5 == 0, F.lit("KG")).otherwise(F.lit("PCE"))
            .alias("std_unit"),
            F.lit("2001-08-02 00:00:00").alias("silver_refreshed_at"),
            (key * 2 + F.when(stale, 0).otherwise(1)).alias("product_recid"),
            F.when(stale, F.lit("1999-06-01 00:00:00")).otherwise(F.lit("2000-06-01 00:00:00"))
            .alias("product_modified_at"),
            F.lit("1999-01-01 00:00:00").alias("product_created_at"),
        ),
        "silver_base_article",
    )


def produits_fabriques(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return _typed(
        _parents(spark, sf_dir).filter(p % 13 != 0).select(
            _key("PAR-", p).alias("ref_parent"),
            _key("Product ", p).alias("item_name"),
            F.lit("FINISHED").alias("type"),
            _key("LINE-", p % 8).alias("ligne_de_prod"),
        ),
        "produits_fabriques",
    )


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    return Sources(
        invent_trans(spark, sf_dir),
        invent_trans_origin(spark, sf_dir),
        prod_table(spark, sf_dir),
        silver_bom(spark, sf_dir),
        silver_base_article(spark, sf_dir),
        produits_fabriques(spark, sf_dir),
    )


def item_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-written exclusions: every part key divisible by 29."""
    key = F.col("p_partkey")
    return _read(spark, sf_dir, "part").filter(key % 29 == 0).select(
        _item_id(key).alias("item_id"),
        F.lit("consumable").alias("reason"),
        F.lit("user1").alias("modified_by"),
        F.lit("2001-08-03 00:00:00").cast("timestamp").alias("modified_at"),
    )


def bom_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-written BOM overrides: corrected, deactivated and off-BOM pairs."""
    p, j = F.col("p"), F.col("j")
    coef = 1 + F.col("c") % 4
    return (
        _parents(spark, sf_dir)
        .select("p", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("j"))
        .select("p", "j", _component_key().alias("c"))
        .withColumn(
            "kind",
            F.when((p % 5 == 0) & (j == 2), "corrected")
            .when((p % 6 == 1) & (j == 3), "deactivated")
            .when((p % 9 == 2) & (j == 7), "off_bom"),
        )
        .filter(F.col("kind").isNotNull())
        .select(
            _key("PAR-", p).alias("parent_id"),
            _key("CMP-", F.col("c")).alias("component_id"),
            (F.col("kind") != "deactivated").alias("active"),
            F.when(F.col("kind") == "corrected", coef + F.lit(0.5).cast(S.QTY))
            .when(F.col("kind") == "off_bom", F.lit(2)).cast(S.QTY).alias("bom_coef"),
            F.col("kind").alias("reason"),
            F.lit("user1").alias("modified_by"),
            F.lit("2001-08-03 00:00:00").cast("timestamp").alias("modified_at"),
        )
    )


def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two count campaigns over every part."""
    key = F.col("p_partkey")
    erp = 1000 + F.col("p_size") * 10
    first = key % 2 == 0
    return _read(spark, sf_dir, "part").select(
        (1 + key % 2).cast("long").alias("campaign_id"),
        _item_id(key).alias("item_id"),
        erp.cast(S.MONEY).alias("qty_erp"),
        (erp - key % 61 + 20).cast(S.MONEY).alias("qty_counted"),
        F.when(first, F.lit("1997-01-01")).otherwise(F.lit("1998-01-07")).cast("date")
        .alias("previous_count"),
        F.when(first, F.lit("1997-07-02")).otherwise(F.lit("1998-07-01")).cast("date")
        .alias("current_count"),
    )
