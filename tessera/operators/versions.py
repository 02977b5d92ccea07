"""Append-only versions of pages: numbering, pointers, streaks and change detection, by windows over their natural keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import load


def first_contents(rows: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """The first row of each (key, content) in the given order: what a store keeps that ignores known contents."""
    w = Window.partitionBy(key, content).orderBy(*order)
    return rows.filter(F.col(key).isNotNull() & F.col(content).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def numbered(rows: DataFrame, key: str, order: list[str], id_col: str = "id") -> DataFrame:
    """`rows` with version (1, 2, ...) and supersedes (the id before) within each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("version", F.row_number().over(w).cast("long")).withColumn("supersedes", F.lag(id_col).over(w))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, all columns."""
    w = Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def deliveries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """fetch_attempts without rows that were delivered twice."""
    return load(spark, sf_dir, "fetch_attempts").dropDuplicates(["id"]).select(*columns)


def outcome_class(column: str = "outcome") -> F.Column:
    """ok, blocked, skipped_policy, error or other, whatever the spelling."""
    text = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    return (
        F.when(text.startswith("ok") | (text == "success"), "ok").when(text.startswith("block"), "blocked")
        .when(text.startswith("skip") | (text == "policy"), "skipped_policy").when(text.startswith("er"), "error").otherwise("other")
    )


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "evidence", "id", "url", "content_hash", "fetched_at")


def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each url: distinct contents in order of arrival, each with the one it supersedes."""
    return numbered(first_contents(_evidence(spark, sf_dir), "url", "content_hash", ["fetched_at", "id"]), "url", ["fetched_at", "id"]).select("url", "id", "version", "supersedes")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of each url."""
    return latest(_evidence(spark, sf_dir), "url", ["fetched_at", "id"]).select("url", "id", "content_hash")


def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct document text once: its SHA-256, first id, copies and sources."""
    documents = load(spark, sf_dir, "documents", "doc_id", "text", "source").filter("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("content"))
    return documents.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.countDistinct("source").alias("sources"))


def unchanged_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat an earlier content of their url, with the first row that had it."""
    w = Window.partitionBy("url", "content_hash").orderBy("fetched_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    return _evidence(spark, sf_dir).withColumn("unchanged_from", F.first("id").over(w)).filter("unchanged_from is not null").select("id", "url", "unchanged_from")


def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at which a user's event type differs from the one before (the first counts)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = load(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").withColumn("previous", F.lag("event_type").over(w))
    return events.filter(~F.col("previous").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type", "previous")


def pointer_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that each url's last observation shows: the first row with that content, not the newest version."""
    e = _evidence(spark, sf_dir)
    first = first_contents(e, "url", "content_hash", ["fetched_at", "id"]).select("url", "content_hash", F.col("id").alias("current_id"))
    return latest(e, "url", ["fetched_at", "id"]).select("url", "content_hash", F.col("id").alias("observed_id")).join(first, ["url", "content_hash"]).select("url", "observed_id", "current_id")


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("url").orderBy("attempted_at", "id")
    rows = deliveries(spark, sf_dir, "id", "url", "attempted_at", "outcome").withColumn("class", outcome_class()).filter("url is not null")
    rows = rows.withColumn("bad", F.col("class").isin("error", "blocked")).withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("url", "island").orderBy("attempted_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("failures", F.sum(F.col("bad").cast("long")).over(inside))


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By url: attempts, the longest run of failures, and the run that is still open."""
    newest = F.max_by("failures", F.struct("attempted_at", "id"))
    return _streaks(spark, sf_dir).groupBy("url").agg(F.count("*").alias("attempts"), F.max("failures").alias("longest"), newest.alias("open_failures"))


def next_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each url is due again: a week after success, else by a ladder of hours for errors and one for blocks, by open
    failures. Blocks stall from the third failure on; errors never do."""
    rung = lambda steps: F.element_at(F.array(*(F.lit(h) for h in steps)), F.least(F.col("open_failures"), F.lit(len(steps))).cast("int"))
    blocked = F.col("class") == "blocked"
    hours = F.when(F.col("open_failures") == 0, 168).when(blocked, rung((168, 720))).otherwise(rung((1, 4, 24, 72, 168)))
    at = F.struct("attempted_at", "id")
    last = _streaks(spark, sf_dir).groupBy("url").agg(F.max_by("failures", at).alias("open_failures"), F.max_by("class", at).alias("class"), F.unix_micros(F.max("attempted_at")).alias("last_us"))
    return last.select("url", "open_failures", (F.col("last_us") + hours.cast("long") * 3_600_000_000).alias("due_us"), (blocked & (F.col("open_failures") >= 3)).alias("stalled"))


def last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest attempt of each url."""
    rows = deliveries(spark, sf_dir, "id", "url", "attempted_at", "http_status").filter("url is not null")
    return latest(rows, "url", ["attempted_at", "id"]).select("url", "id", F.unix_micros("attempted_at").alias("attempted_us"), F.col("http_status").cast("long").alias("http_status"))


def ordinal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles made unique within a source: the second of a name gets #2 and so on."""
    documents = load(spark, sf_dir, "documents", "doc_id", "source", "title").filter("title is not null")
    n = F.row_number().over(Window.partitionBy("source", "title").orderBy("doc_id"))
    return documents.withColumn("n", n).select("doc_id", F.when(F.col("n") > 1, F.concat("title", F.lit(" #"), F.col("n").cast("string"))).otherwise(F.col("title")).alias("name"))


QUERIES = {f.__name__: f for f in (version_chain, latest_version, distinct_contents, unchanged_from, content_changes, pointer_current, failure_streaks, next_check, last_attempt, ordinal_names)}

_FIRST = "select * from evidence where url is not null and content_hash is not null qualify row_number() over (partition by url, content_hash order by fetched_at, id) = 1"
_CLASS = """case when t like 'ok%' or t = 'success' then 'ok' when t like 'block%' then 'blocked' when t like 'skip%' or t = 'policy' then 'skipped_policy' when t like 'er%' then 'error' else 'other' end"""
_DELIVERED = "(select distinct on (id) *, lower(trim(coalesce(outcome, ''))) as t from fetch_attempts)"
_ISLANDS = f"""with a as (select id, url, attempted_at, {_CLASS} as class, {_CLASS} in ('error', 'blocked') as bad from {_DELIVERED} where url is not null),
b as (select *, sum(case when bad then 0 else 1 end) over (partition by url order by attempted_at, id rows unbounded preceding) as island from a),
s as (select *, cast(sum(bad::int) over (partition by url, island order by attempted_at, id rows unbounded preceding) as bigint) as failures from b)"""
SQL = {
    "version_chain": f"with f as ({_FIRST}) select url, id, row_number() over w as version, lag(id) over w as supersedes from f window w as (partition by url order by fetched_at, id)",
    "latest_version": "select url, id, content_hash from evidence qualify row_number() over (partition by url order by fetched_at desc nulls last, id desc) = 1",
    "distinct_contents": "select sha256(text) as content, min(doc_id) as first_id, count(*) as copies, count(distinct source) as sources from documents where text is not null group by 1",
    "unchanged_from": "select * from (select id, url, first_value(id) over (partition by url, content_hash order by fetched_at, id rows between unbounded preceding and 1 preceding) as unchanged_from from evidence) where unchanged_from is not null",
    "content_changes": "select event_id, user_id, event_type, previous from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events) where previous is distinct from event_type",
    "pointer_current": f"with f as ({_FIRST}), l as (select * from evidence qualify row_number() over (partition by url order by fetched_at desc nulls last, id desc) = 1) select l.url, l.id as observed_id, f.id as current_id from l join f on l.url = f.url and l.content_hash = f.content_hash",
    "failure_streaks": f"{_ISLANDS} select url, count(*) as attempts, max(failures) as longest, arg_max(failures, (attempted_at, id)) as open_failures from s group by url",
    "next_check": f"{_ISLANDS}, l as (select url, arg_max(failures, (attempted_at, id)) as open_failures, arg_max(class, (attempted_at, id)) as class, epoch_us(max(attempted_at)) as last_us from s group by url) select url, open_failures, last_us + (case when open_failures = 0 then 168 when class = 'blocked' then [168, 720][least(open_failures, 2)] else [1, 4, 24, 72, 168][least(open_failures, 5)] end)::bigint * 3600000000 as due_us, class = 'blocked' and open_failures >= 3 as stalled from l",
    "last_attempt": f"select url, id, epoch_us(attempted_at) as attempted_us, http_status::bigint as http_status from {_DELIVERED} where url is not null qualify row_number() over (partition by url order by attempted_at desc nulls last, id desc) = 1",
    "ordinal_names": "select doc_id, case when n > 1 then title || ' #' || n else title end as name from (select *, row_number() over (partition by source, title order by doc_id) as n from documents where title is not null)",
}
