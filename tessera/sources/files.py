"""Landing and leaving: JSON documents, inboxes, snapshots behind a pointer, event logs, reports, backups."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, faults) of a folder of JSON files, one document a file.

    Documents have name, topic (the folder's name) and body; faults have name and reason: not_json, not_an_object or the
    required keys that are missing. A blank file is not_json; files of no bytes aren't read.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name"), F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("topic"), F.col("value").alias("body")
    )
    missing = F.filter(F.array(*(F.lit(k) for k in required)), lambda k: ~F.array_contains(F.json_object_keys("body"), k))
    reason = F.when(F.try_parse_json("body").isNull(), "not_json").when(F.json_object_keys("body").isNull(), "not_an_object").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
    judged = files.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").select("name", "reason")


def newest_file(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of the newest file that matches; ties go to the last name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"), "length")
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(1)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of every file under a path that isn't empty; two manifests are compared by a join."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def publish_snapshot(df: DataFrame, root: str) -> str:
    """Writes `df` to a new folder under `root` and then moves the pointer `current` to it; returns the folder.

    Readers see the old snapshot or the new one, never a part. Runs with one writer a root.
    """
    spark = df.sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    fs, at, Path = _fs(spark, root)
    draft, current = Path(at, f".{name}.pointer"), Path(at, "current")
    out = fs.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    # one rename that replaces the pointer: a reader finds the old one or the new one
    jvm = spark._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, current, overwrite)
    return f"{root}/{name}"


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that the pointer names."""
    return spark.read.parquet(f"{root}/{spark.read.text(f'{root}/current').first()[0]}")


def content_digest(df: DataFrame) -> tuple[int, int]:
    """Rows, and a hash of them that doesn't depend on their order: what tells whether a copy is complete."""
    # sums of 64-bit hashes as decimals can't overflow
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(rows), int(total)


def publish_if_changed(df: DataFrame, root: str) -> bool:
    """publish_snapshot, unless the current snapshot holds the same rows."""
    fs, at, Path = _fs(df.sparkSession, root)
    if fs.exists(Path(at, "current")) and content_digest(current_snapshot(df.sparkSession, root)) == content_digest(df):
        return False
    publish_snapshot(df, root)
    return True


def append_events(df: DataFrame, path: str) -> None:
    """Appends rows to a log of JSON lines, nulls kept as missing fields."""
    df.write.mode("append").json(path)


def backup(df: DataFrame, path: str) -> tuple[int, int]:
    """Copies a table to a path that doesn't exist yet and checks the copy against the original."""
    df.write.mode("errorifexists").parquet(path)
    copy, original = content_digest(df.sparkSession.read.parquet(path)), content_digest(df)
    if copy != original:
        raise ValueError(f"the copy at {path} has {copy}, the original {original}")
    return copy


def restore(spark: SparkSession, path: str, to: str, expected: tuple[int, int]) -> DataFrame:
    """A backup copied to a path that doesn't exist yet, after its rows and digest (of backup()) are found as they were."""
    if path.rstrip("/") == to.rstrip("/"):
        raise ValueError(f"{to} is the backup itself")
    df = spark.read.parquet(path)
    if (found := content_digest(df)) != expected:
        raise ValueError(f"the backup at {path} has {found}, not {expected}")
    backup(df, to)
    return spark.read.parquet(to)


def markdown_table(df: DataFrame, title: str, order: list[str], limit: int) -> DataFrame:
    """(value) lines of a Markdown report of the first `limit` rows: a heading and a table, with pipes escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    rows = df.orderBy(*order).limit(limit).select(F.row_number().over(Window.orderBy(*order)).alias("_line"), F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |")).alias("value"))
    heads = [(-2, f"# {title}\n"), (-1, "| " + " | ".join(df.columns) + " |"), (0, "|" + " --- |" * len(df.columns))]
    return df.sparkSession.createDataFrame(heads, "_line int, value string").union(rows).orderBy("_line").select("value")


def required_keys(schema: str) -> list[str]:
    """The required keys that a JSON Schema text declares."""
    return list(json.loads(schema).get("required", []))
