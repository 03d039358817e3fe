"""JSON records: lines, manifests, document folders, artifacts; and sinks that appear whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines and the lines that don't fit the schema, as (file, line). Blank lines are skipped."""
    kinds = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), "value", F.from_json("value", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = raw.where("r._corrupt is null").select(*[f"r.{f.name}" for f in kinds.fields[:-1]])
    return good, raw.where("r._corrupt is not null").select("file", F.col("value").alias("line"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON document under ``path``, with the file that it comes from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_artifact(spark: SparkSession, path: str, record: str, tag: str) -> DataFrame:
    """The records of an artifact whose schema tag must be ``tag``; another tag is an error when the rows are used."""
    a = spark.read.schema(f"feature_schema string, records array<struct<{record}>>").option("multiLine", True).json(path)
    checked = F.when(F.col("feature_schema") == tag, F.col("records")).otherwise(F.raise_error(F.concat(F.lit("unexpected schema "), F.coalesce("feature_schema", F.lit("none")))))
    return a.select(F.explode(checked).alias("r")).select("r.*")


def write_whole(df: DataFrame, path: str, form: str = "json") -> None:
    """Replace ``path`` by the rows: written beside it first, then the old ones moved aside and the new ones to their place.

    Between the two moves there is no ``path``; after a failure there the old rows lie beside it under ``.old`` and are put back.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own, to = f"{path.rstrip('/')}.{uuid.uuid4().hex}", jvm.org.apache.hadoop.fs.Path(path)
    df.write.format(form).save(own)
    store = to.getFileSystem(conf)
    new, aside = jvm.org.apache.hadoop.fs.Path(own), jvm.org.apache.hadoop.fs.Path(f"{own}.old")
    held = store.exists(to)
    if held and not store.rename(to, aside):
        raise OSError(f"{path} can't be moved aside")
    if not store.rename(new, to):
        if held:
            store.rename(aside, to)
        raise OSError(f"{own} can't be moved to {path}")
    if held:
        store.delete(aside, True)


def export_manifest(df: DataFrame, order: str) -> DataFrame:
    """(rows, sha256): a digest over the rows' own digests, each keyed by ``order``; it doesn't depend on how rows are dealt to tasks."""
    own = F.sha2(F.to_json(F.struct(F.col(order), *[c for c in df.columns if c != order])), 256)
    digests = df.select(F.conv(F.substring(own, 1, 15), 16, 10).cast("long").alias("a"), F.conv(F.substring(own, 16, 15), 16, 10).cast("long").alias("b"))
    folded = digests.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    return folded.select("rows", F.sha2(F.concat_ws(":", "rows", "xa", "xb"), 256).alias("sha256"))
