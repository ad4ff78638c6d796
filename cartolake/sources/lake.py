"""Lake tables: tolerant reading, partitioned writing, swaps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files united by name, with partition columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def columns_of(spark: SparkSession, path: str) -> set[str]:
    """Columns of a table, none if it can't be read."""
    try:
        return set(spark.read.parquet(path).columns)
    except AnalysisException:
        return set()


def pick(df: DataFrame, wanted: Mapping[str, tuple[str, str]], required: Sequence[str] = ()) -> DataFrame:
    """name: (expression, type) for each output column; where the expression's column is not there, a typed null. Missing required columns raise."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")

    def one(name: str, expression: str, kind: str) -> Column:
        root = expression.split(".")[0].split("[")[0]
        return (F.expr(expression).try_cast(kind) if root in df.columns else F.lit(None).cast(kind)).alias(name)

    return df.select(*[one(n, e, k) for n, (e, k) in wanted.items()])


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one with the schema where it can't be read or lacks columns."""
    empty = spark.createDataFrame([], schema)
    return spark.read.parquet(path).select(empty.columns) if set(empty.columns) <= columns_of(spark, path) else empty


def write_partitioned(df: DataFrame, path: str, *by: str, rows_per_file: int = 5_000_000) -> None:
    """Partition folders are replaced, others stay; rows of a folder are spread by a rebalance, so a large one gets several tasks."""
    df.hint("rebalance", *by).write.partitionBy(*by).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def append_part(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rewrite(spark: SparkSession, path: str, change) -> None:
    """Replace a table by a function of itself: written beside it, then renamed, since a path can't be overwritten while it is read."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    old, new, gone = fs_path(path), fs_path(f"{path}.new"), fs_path(f"{path}.old")
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{path}.new")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(gone, True)
    fs.rename(old, gone)
    fs.rename(new, old)
    fs.delete(gone, True)


def manifest(df: DataFrame, path: str, **facts: str) -> None:
    """A one-row JSON file with the row count and given facts."""
    df.agg(F.count("*").alias("rows")).select("rows", *[F.lit(v).alias(k) for k, v in facts.items()]).coalesce(1).write.mode("overwrite").json(path)


def json_sequence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Record-separated JSON lines: separators, byte order marks and blank lines go."""
    line = F.regexp_replace("value", "^[\\x1e\\ufeff]+", "")
    return spark.read.text(path).select(line.alias("value")).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def partition_value(name: str) -> Column:
    """A partition's value out of the file's path."""
    return F.regexp_extract(F.col("_metadata.file_path"), f"{name}=([^/]+)", 1)


def write_bucketed(df: DataFrame, path: str, key: str) -> None:
    """Documents in 4096 folders by the hash of their key, so that one is found by reading a single folder."""
    dealt = df.withColumn("bucket", hash_bucket(F.col(key).cast("string")))
    dealt.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").option("compression", "zstd").mode("overwrite").parquet(path)


def look_up(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """The documents of a key out of its bucket: a partition filter, then a filter that reaches the scan. Three hex digits with one e look
    like numbers, so the bucket's type is given."""
    schema = spark.read.parquet(path).drop("bucket").schema.add("bucket", "string")
    bucket = hashlib.sha256(str(value).encode()).hexdigest()[:3]
    return spark.read.schema(schema).parquet(path).where((F.col("bucket") == bucket) & (F.col(key) == value)).drop("bucket")


def ledger(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """name, size, sha256 of each file under a folder, hashed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """name, state ('new', 'changed', 'gone') of the files that differ between two ledgers."""
    both = now.select("name", F.col("sha256").alias("n")).join(before.select("name", F.col("sha256").alias("b")), "name", "full")
    return both.where("NOT n <=> b").select("name", F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "gone").otherwise("changed").alias("state"))


def build_parts(spark: SparkSession, path: str, parts: Mapping[str, Callable[[], DataFrame]]) -> list[str]:
    """Builds the named parts that aren't complete, one folder each, and returns their names. A part is complete when its write has left its
    mark, so a build that was stopped goes on where it ended."""
    built = []
    for name, make in parts.items():
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            make().write.mode("overwrite").parquet(f"{path}/{name}")
            built.append(name)
    return built


def bulk_export(df: DataFrame, path: str, version: str, per_file: int = 2000) -> None:
    """Records for a search index as JSON lines, `per_file` to a file between 100 and 10,000. The version is made the current one only
    after its records were counted again."""
    target = f"{path}/{version}"
    df.write.option("maxRecordsPerFile", max(100, min(10_000, per_file))).mode("overwrite").json(target)
    found, wanted = df.sparkSession.read.text(target).count(), df.count()
    if found != wanted:
        raise ValueError(f"{found} records were written of {wanted}")
    df.sparkSession.createDataFrame([(version, found)], "version string, records long").coalesce(1).write.mode("overwrite").json(f"{path}/current")
