"""Mutations as new snapshots: a snapshot and changes give the next snapshot, without an update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import load


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """`stored` and those rows of `incoming` whose keys it lacks; of incoming rows with equal keys one is kept."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """The next snapshot of `stored`; `rules` name for each column what a change does.

    overwrite: the change's value; coalesce: unless it is null; keep: the stored one unless it is missing; greatest: the
    larger; add: the sum; nonempty: the change's array unless empty. Keys of either side come out once.
    """
    o, n = stored.alias("o"), changes.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    made = {
        "overwrite": lambda c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")),
        "coalesce": lambda c: F.coalesce(f"n.{c}", f"o.{c}"),
        "keep": lambda c: F.coalesce(f"o.{c}", f"n.{c}"),
        "greatest": lambda c: F.greatest(f"o.{c}", f"n.{c}"),
        "add": lambda c: F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0)),
        "nonempty": lambda c: F.when(F.size(f"n.{c}") > 0, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")),
    }
    return o.join(n, on, "full").select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(made[r](c).alias(c) for c, r in rules.items()))


def upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events folded into one row a user: last known value, greatest value, times seen, first and last instant."""
    order = F.struct("ts", "event_id")
    return load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").groupBy("user_id").agg(
        F.max_by("event_type", order).alias("last_type"),
        F.max_by("value", F.when(F.col("value").isNotNull(), order)).alias("last_value"),
        F.max("value").alias("top_value"), F.count("*").alias("times_seen"), F.min("event_id").alias("first_event"),
    )


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before 1998 as the snapshot by customer, those since as changes: overwrite, coalesce, greatest, add."""
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    of = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"), F.min("o_orderkey").alias("first_order"), F.max("o_totalprice").alias("top_price"), F.count("*").alias("times"))
    old, new = orders.filter("o_orderdate < '1998-01-01'"), orders.filter("o_orderdate >= '1998-01-01'")
    return upsert(of(old), of(new), ["o_custkey"], {"last_order": "coalesce", "first_order": "keep", "top_price": "greatest", "times": "add"})


def keep_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each url: those of its newest row that has any."""
    rows = load(spark, sf_dir, "evidence", "id", "url", "fetched_at", "injection_flags").filter(F.size("injection_flags") > 0)
    return rows.groupBy("url").agg(F.max_by("injection_flags", F.struct("fetched_at", "id")).alias("f")).select("url", F.array_join("f", ",").alias("flags"))


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents stored before 2024, and contents that arrived since and were unknown, counted by url."""
    e = load(spark, sf_dir, "evidence", "id", "url", "content_hash", "fetched_at")
    one = lambda rows, when: rows.groupBy("url", "content_hash").agg(F.min("id").alias("id")).withColumn("batch", F.lit(when))
    old, new = one(e.filter("fetched_at < timestamp '2024-01-01 00:00:00 UTC'"), "stored"), one(e.filter("fetched_at >= timestamp '2024-01-01 00:00:00 UTC'"), "new")
    return insert_or_ignore(old, new, ["url", "content_hash"]).groupBy("url").agg(F.count("*").alias("contents"), F.count_if(F.col("batch") == "new").alias("inserted"))


def oldest_payload_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows applied newest first, each overwriting: the oldest event of a user and type stays."""
    return load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min_by("value", F.struct("ts", "event_id")).alias("value")
    )


QUERIES = {f.__name__: f for f in (upsert_fold, upsert_snapshot, keep_nonempty, insert_ignore, oldest_payload_wins)}
SQL = {
    "upsert_fold": "select user_id, arg_max(event_type, (ts, event_id)) as last_type, arg_max(value, (ts, event_id)) filter (value is not null) as last_value, max(value) as top_value, count(*) as times_seen, min(event_id) as first_event from events group by user_id",
    "upsert_snapshot": "select o_custkey, coalesce(max(o_orderkey) filter (o_orderdate >= '1998-01-01'), max(o_orderkey)) as last_order, coalesce(min(o_orderkey) filter (o_orderdate < '1998-01-01'), min(o_orderkey)) as first_order, max(o_totalprice) as top_price, count(*) as times from orders group by o_custkey",
    "keep_nonempty": "select url, array_to_string(arg_max(injection_flags, (fetched_at, id)), ',') as flags from evidence where len(injection_flags) > 0 group by url",
    "insert_ignore": "with c as (select url, content_hash, min(fetched_at) < timestamptz '2024-01-01 00:00:00+00' as stored from evidence group by 1, 2) select url, count(*) as contents, count(*) filter (not stored) as inserted from c group by url",
    "oldest_payload_wins": "select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id, arg_min(value, (ts, event_id)) as value from events group by 1, 2",
}
