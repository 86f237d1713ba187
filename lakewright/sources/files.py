"""Sources and sinks: tables, text, session logs, parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.text import TEXT_CAP, normalise

LOG_SCHEMA = "type string, uuid string, session_id string, role string, text string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files, normalised, at most TEXT_CAP characters; too long ones are flagged."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", normalise(F.left("value", F.lit(TEXT_CAP))).alias("text"), (F.length("value") > TEXT_CAP).alias("cut"))


def read_table_text(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Rows of a CSV or TSV file with quoted fields over several lines; rows of blanks only are dropped."""
    rows = spark.read.csv(path, sep=separator, multiLine=True, escape='"')
    return rows.filter(F.exists(F.array(*[F.col(c) for c in rows.columns]), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))


def read_session_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines log in place: blank lines are skipped, a line that can't be read becomes type session_corrupted."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    record = F.from_json("value", LOG_SCHEMA, {"mode": "PERMISSIVE"})
    good = F.expr("try_parse_json(value)").isNotNull()
    d = lines.select("value", good.alias("good"), record.alias("r"))
    return d.select(F.when(F.col("good"), F.col("r.type")).otherwise("session_corrupted").alias("type"), "r.uuid", "r.session_id", "r.role", F.when(F.col("good"), F.col("r.text")).otherwise(F.col("value")).alias("text"))


def write_session_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_documents(docs: DataFrame, path: str, by: str = "source") -> None:
    """Parsed documents with the SHA-256 of their text, a folder for each value of by; only the folders of docs are replaced."""
    d = docs.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
