"""Sources, sinks and streams as queries: what is written to the shared folder and read back must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.records import manifest_drift, retry_after
from tessera.operators.versions import deliveries, outcome_class
from tessera.sources.files import append_events, backup, content_digest, current_snapshot, json_documents, manifest, markdown_table, newest_file, publish_if_changed, publish_snapshot, restore
from tessera.sources.tables import load, shared_dir
from tessera.streaming.inbox import append_new, daily_quota, event_stream, failure_counts, to_table


def _publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "publishers").select("publisher_id", "canonical_name", "host", "zone_name")


def json_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers left in an inbox as one JSON file each, and read from there; those without a zone lack a required key."""
    path = f"{shared_dir(spark)}/publishers"
    rows = _publishers(spark, sf_dir)
    rows.repartition(rows.count(), "publisher_id").write.json(path)
    good, bad = json_documents(spark, path, ["publisher_id", "zone_name"])
    lines = good.select("topic", F.explode(F.split("body", "\n")).alias("body")).filter("body <> ''")
    return lines.select("topic", F.get_json_object("body", "$.publisher_id").alias("publisher_id"), F.get_json_object("body", "$.zone_name").alias("zone_name")).unionByName(
        bad.filter("reason like 'missing:%'").groupBy().agg(F.lit("faults").alias("topic"), F.lit(None).cast("string").alias("publisher_id"), F.when(F.count("*") > 0, "missing").alias("zone_name"))
    )


def snapshot_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers behind a pointer: published, left alone while equal, replaced when changed; the snapshot that readers see last."""
    root, rows = shared_dir(spark), _publishers(spark, sf_dir)
    publish_snapshot(rows.limit(0), root)
    publish_if_changed(rows, root)
    publish_if_changed(rows.repartition(3), root)
    return current_snapshot(spark, root)


def restored_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after a backup and its restoration."""
    root, rows = shared_dir(spark), load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    digest = backup(rows, f"{root}/backup")
    return restore(spark, f"{root}/backup", f"{root}/restored", digest)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log of JSON lines in two parts, and read from it."""
    path, e = f"{shared_dir(spark)}/log", load(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    append_events(e.filter("event_id % 2 = 0"), path)
    append_events(e.filter("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long, user_id long, event_type string").json(path)


def merged_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written in two versions of a table, the second with a further column, and read as one: rows and filled values by version."""
    path, n = f"{shared_dir(spark)}/nations", load(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").withColumn("version", (F.col("n_nationkey") % 2 + 1).cast("int"))
    n.filter("version = 1").drop("n_regionkey").write.parquet(path)
    n.filter("version = 2").write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path).groupBy("version").agg(F.count("*").alias("rows"), F.count("n_regionkey").alias("filled"))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two manifests of a folder of lists of topics, by kind of drift; and whether the newest file is one of them."""
    root, topics = shared_dir(spark), load(spark, sf_dir, "documents", "topic").filter("topic is not null").distinct()
    for name, rows in (("old", topics), ("new", topics.filter("topic <> 'laundry'"))):
        rows.select(F.col("topic").alias("value")).coalesce(1).write.text(f"{root}/{name}/list")
    frozen, now = (manifest(spark, f"{root}/{n}").filter("name like '%.txt'").select(F.lit("list").alias("name"), "sha256") for n in ("old", "new"))
    drift = manifest_drift(frozen, now).groupBy("drift").agg(F.count("*").alias("files"))
    return drift.union(newest_file(spark, root, "*.txt").select(F.lit("newest"), F.col("path").like("%/new/list/%").cast("long")))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as the lines of a Markdown report."""
    return markdown_table(load(spark, sf_dir, "region", "r_regionkey", "r_name"), "Regions", ["r_regionkey"], 100)


def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to wait by headers of several forms, at one instant; nulls where a header says nothing that can be kept."""
    headers = ("120", " 5 ", "0", "-3", "soon", "", "Wed, 01 May 2024 00:10:00 GMT", "Wed, 01 May 2020 00:00:00 GMT", "Wed, 99 May 2024 00:00:00 GMT")
    rows = spark.createDataFrame([(h, "2024-05-01 00:00:00") for h in headers], "header string, now string").withColumn("now", F.to_timestamp("now"))
    return rows.select("header", retry_after("header", "now").alias("seconds"))


def streamed_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by UTC day and type, as a stream that runs over the files there are and ends."""
    root = shared_dir(spark)
    load(spark, sf_dir, "events", "event_id", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(f"{root}/in")
    name = "quota_" + root.rsplit("/", 1)[1]
    to_table(daily_quota(event_stream(spark, f"{root}/in", "event_id long, ts timestamp, event_type string"), "3650 days"), name, f"{root}/checkpoint").awaitTermination()
    return spark.table(name)


def streamed_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts as a stream that is delivered twice, stored once each."""
    root = shared_dir(spark)
    load(spark, sf_dir, "fetch_attempts", "id", "url").repartition(2).write.parquet(f"{root}/in")
    for n in range(2):
        append_new(event_stream(spark, f"{root}/in", "id long, url string", 1), f"{root}/out", ["id"], f"{root}/checkpoint{n}").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def streamed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each url since its last success, by a stream with state for each url."""
    root = shared_dir(spark)
    a = deliveries(spark, sf_dir, "id", "url", "attempted_at", "outcome").withColumn("bad", outcome_class().isin("error", "blocked")).drop("outcome")
    a.repartition(1).write.parquet(f"{root}/in")
    stream, path = failure_counts(event_stream(spark, f"{root}/in", "id long, url string, attempted_at timestamp, bad boolean")), f"{root}/out"
    write = lambda batch, _: batch.write.mode("append").parquet(path)
    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("url string, failures long, attempts long").parquet(path).groupBy("url").agg(F.max_by("failures", "attempts").alias("failures"), F.max("attempts").alias("attempts"))


def copy_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of small tables, and whether their digest stays the same in another order of rows."""
    names = ("region", "nation", "publishers")
    rows = [(n, *(d := content_digest(load(spark, sf_dir, n)))[:1], d == content_digest(load(spark, sf_dir, n).repartition(3))) for n in names]
    return spark.createDataFrame(rows, "name string, rows long, same boolean")


QUERIES = {f.__name__: f for f in (json_inbox, snapshot_pointer, restored_backup, event_log, merged_schema, file_manifest, report_lines, waits, streamed_quota, streamed_inbox, streamed_failures, copy_digests)}
_CLASS = "case when t like 'ok%' or t = 'success' then 'ok' when t like 'block%' then 'blocked' when t like 'skip%' or t = 'policy' then 'skipped_policy' when t like 'er%' then 'error' else 'other' end"
_A = "(select distinct on (id) *, lower(trim(coalesce(outcome, ''))) as t from fetch_attempts)"
SQL = {
    "snapshot_pointer": "select publisher_id, canonical_name, host, zone_name from publishers",
    "restored_backup": "select o_orderkey, o_custkey, o_orderstatus from orders",
    "event_log": "select event_id, user_id, event_type from events",
    "merged_schema": "select n_nationkey % 2 + 1 as version, count(*) as rows, case when n_nationkey % 2 = 1 then count(*) else 0 end as filled from nation group by 1, n_nationkey % 2",
    "file_manifest": "select 'changed' as drift, 1 as files where exists (select 1 from documents where topic = 'laundry') union all select 'newest', 1",
    "report_lines": "select value from (select -3 as n, '# Regions' || chr(10) as value union all select -2, '| r_regionkey | r_name |' union all select -1, '| --- | --- |' union all select r_regionkey, '| ' || r_regionkey || ' | ' || replace(r_name, '|', chr(92) || '|') || ' |' from region) order by n",
    "waits": "select * from (values ('120', 120), (' 5 ', 5), ('0', 0), ('-3', null), ('soon', null), ('', null), ('Wed, 01 May 2024 00:10:00 GMT', 600), ('Wed, 01 May 2020 00:00:00 GMT', null), ('Wed, 99 May 2024 00:00:00 GMT', null)) v(header, seconds)",
    "streamed_quota": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as events from events group by 1, 2",
    "streamed_inbox": "select distinct on (id) id, url from fetch_attempts",
    "streamed_failures": f"with a as (select id, url, attempted_at, {_CLASS} in ('error', 'blocked') as bad from {_A} where url is not null), b as (select *, sum((not bad)::int) over (partition by url order by attempted_at, id rows unbounded preceding) as island from a), s as (select *, sum(bad::int) over (partition by url, island order by attempted_at, id rows unbounded preceding) as failures from b) select url, arg_max(failures, (attempted_at, id))::bigint as failures, count(*) as attempts from s group by url",
    "copy_digests": "select 'region' as name, count(*) as rows, true as same from region union all select 'nation', count(*), true from nation union all select 'publishers', count(*), true from publishers",
}
