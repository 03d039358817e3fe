"""Queries of sources: pushed-down scans, references, guards, validation of rows at the door."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.plans import bridges as b
from clipsift.plans.registry import query


@query("src11_pushed_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_shipdate < TIMESTAMP '2000-01-01'")
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_extendedprice")


@query("src09_column_ordinals", "SELECT ref, CASE WHEN length(letters) = 1 THEN ascii(letters) - 65 ELSE (ascii(letters) - 64) * 26 + ascii(letters[2:2]) - 65 END::INT AS ordinal FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN '' ELSE chr((65 + p_size % 3)::INT) END || chr((65 + p_partkey % 26)::INT) AS letters, CASE WHEN p_size % 2 = 0 THEN '' ELSE chr((65 + p_size % 3)::INT) END || chr((65 + p_partkey % 26)::INT) || p_size AS ref FROM part)")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.sources.analytics import column_ordinal

    p = b.table(spark, sf_dir, "part")
    ref = F.concat(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.char(65 + F.col("p_size") % 3)), F.char(65 + F.col("p_partkey") % 26), F.col("p_size"))
    return p.select(ref.alias("ref")).distinct().withColumn("ordinal", column_ordinal(F.col("ref")))


@query("src16_row_guard", "SELECT source, count(*) AS n, count(*) > 40 AS over_bound FROM documents GROUP BY 1")
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 40).alias("over_bound"))


@query("jsn01_json_defaults", "SELECT event_id, coalesce((props::JSON->>'k')::INT, 0) AS k, (props::JSON->>'missing') IS NULL AS missing FROM events")
def jsn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int, missing string"))
    return e.select("event_id", F.coalesce("p.k", F.lit(0)).alias("k"), F.col("p.missing").isNull().alias("missing"))


@query("jsn02_json_keys", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props::JSON)) AS key FROM events) GROUP BY 1")
def jsn02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("prj03_whitelist", "SELECT c_custkey, c_mktsegment FROM customer")
def prj03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")


@query("flt16_status_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def flt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@query("src05_export_tables", "SELECT c_mktsegment AS metric, count(*) AS n, sum(c_nationkey)::BIGINT AS total FROM customer GROUP BY 1")
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited export, one line a customer, parsed by header and summed."""
    lines = b.table(spark, sf_dir, "customer").select(F.concat_ws("\t", "c_mktsegment", "c_nationkey").alias("line"))
    row = F.from_csv("line", F.lit("metric string, n int"), {"sep": "\t"})
    return lines.select(row.alias("r")).groupBy(F.col("r.metric").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.sum("r.n").alias("total"))


@query("agg34_snapshot_manifest", "SELECT count(*) AS rows, count(DISTINCT clip) AS clips, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM {feedback}")
def agg34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("clip").alias("clips"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("agg44_row_digest", "SELECT clip, sha256('{\"clip\":' || clip || ',\"views\":' || views || '}') AS digest FROM {performance}")
def agg44(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a row as compact JSON with its keys in order."""
    return b.performance(spark, sf_dir).select("clip", F.sha2(F.to_json(F.struct("clip", "views")), 256).alias("digest"))
