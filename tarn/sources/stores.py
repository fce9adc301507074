"""Sources and sinks: message files, content-addressed objects, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.functions import urls as U

BAD = "_corrupt_record"


def read_messages(spark: SparkSession, path: str, schema: StructType, stream: bool = False, most_files: int = 10) -> DataFrame:
    """JSON messages, one a line; malformed ones keep their text in ``_corrupt_record``."""
    full = StructType([*schema.fields]).add(BAD, "string")
    reader = spark.readStream.option("maxFilesPerTrigger", most_files) if stream else spark.read
    return reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def decode(raw: DataFrame, column: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a text column of JSON: fields of the good, text of the bad for the dead-letter sink."""
    full = StructType([*schema.fields]).add(BAD, "string")
    parsed = raw.withColumn("m", F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    broken = F.col("m").isNull() | F.col(f"m.{BAD}").isNotNull()
    return parsed.where(~broken).select("m.*").drop(BAD), parsed.where(broken).select(F.col(column).alias("message"))


def write_messages(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def write_objects(df: DataFrame, path: str, url: str = "url", at: str = "fetched_at", body: str = "content", crawler: str = "tarn", most_plain: int = 1024) -> None:
    """Objects partitioned by encoding, date and domain, with hash, md5 of the content and length beside it.

    Contents of over ``most_plain`` bytes go to gzip files, smaller ones to
    plain files, which are no larger that way.
    """
    rows = df.select(
        F.when(F.octet_length(body) > most_plain, "gzip").otherwise("plain").alias("encoding"),
        F.date_format(at, "yyyy").alias("year"),
        F.date_format(at, "MM").alias("month"),
        F.date_format(at, "dd").alias("day"),
        U.domain(F.col(url)).alias("domain"),
        F.col(url).alias("url"),
        U.url_hash(F.col(url)).alias("url_hash"),
        F.col(body).alias("content"),
        F.md5(body).alias("content_md5"),
        F.octet_length(body).alias("bytes"),
        F.col(at).alias("uploaded_at"),
        F.lit(crawler).alias("crawler_id"),
    )
    dealt = rows.repartition("encoding", "year", "month", "day", "domain", F.pmod(F.xxhash64("url"), F.lit(16)))
    for encoding, codec in (("gzip", "gzip"), ("plain", "none")):
        dealt.where(F.col("encoding") == encoding).write.mode("append").partitionBy("encoding", "year", "month", "day", "domain").option("compression", codec).json(path)


def read_objects(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """Objects written by ``write_objects``, packed or not; a condition on date and domain prunes folders."""
    df = spark.read.json(path, schema="url string, url_hash string, content string, content_md5 string, bytes long, uploaded_at timestamp, crawler_id string, encoding string, year string, month string, day string, domain string")
    return df.where(keep) if keep is not None else df


def migration_plan(steps: DataFrame, version: str, back: bool = False) -> DataFrame:
    """Migration steps oldest first; newest first to go back."""
    return steps.orderBy(F.desc(version) if back else F.asc(version))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def put_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins: one row per key, the greatest version; minima and maxima combine map-side."""
    rows = old.unionByName(new)
    cols = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Conditional update: the new values where the condition holds, else the old row."""
    return df.withColumns({c: F.when(F.coalesce(condition, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def copy_table(spark: SparkSession, source: str, target: str, columns: dict[str, Column] | None = None) -> None:
    """A migration step: read, change columns, write under the new name."""
    df = spark.read.parquet(source)
    (df.withColumns(columns) if columns else df).write.mode("errorifexists").parquet(target)


def sample_hits(rows: DataFrame, key: str, url: str, page: int = 1, size: int = 30) -> DataFrame:
    """A page of hits in the order of their keys, for lists without a score or a title."""
    hits = rows.select(F.col(key).alias("id"), F.concat(F.lit("Result "), F.col(key).cast("string")).alias("title"), F.col(url).alias("url"))
    return hits.orderBy("id").offset((page - 1) * size).limit(size)
