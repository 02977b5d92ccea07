"""Aggregates over the store: roll-ups, vocabularies, comparisons, digests and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.relations import host
from tessera.operators.versions import deliveries, outcome_class
from tessera.sources.tables import load

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "evidence", "evidence_text", "fetch_attempts", "dev_cases", "holdout_cases", "publishers", "reading_labels")


def classify(cases: list[tuple[str, F.Column]], otherwise: str) -> F.Column:
    """The name of the first case that holds: exactly one class a row."""
    made = None
    for name, holds in cases:
        made = F.when(holds, name) if made is None else made.when(holds, name)
    return F.lit(otherwise) if made is None else made.otherwise(otherwise)


def first_failing(gates: list[tuple[str, F.Column]]) -> F.Column:
    """The name of the first gate whose condition holds, or null; conditions that are null don't hold."""
    return F.coalesce(*(F.when(failing, name) for name, failing in gates))


def all_failing(gates: list[tuple[str, F.Column]]) -> F.Column:
    """The sorted names of all gates whose condition holds."""
    return F.array_sort(F.filter(F.array(*(F.when(failing, name) for name, failing in gates)), lambda x: x.isNotNull()))


def host_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By host: documents, urls, versions, attempts and outcomes; hosts with attempts alone are kept."""
    e = load(spark, sf_dir, "evidence", "id", "url", "version_no").groupBy(host("url").alias("host")).agg(F.count("*").alias("documents"), F.countDistinct("url").alias("urls"), F.max("version_no").cast("long").alias("versions"))
    a = deliveries(spark, sf_dir, "id", "url", "outcome").filter("url is not null").groupBy(host("url").alias("host")).agg(F.count("*").alias("attempts"), F.count_if(outcome_class() == "ok").alias("ok"), F.count_if(outcome_class().isin("error", "blocked")).alias("failed"))
    return e.join(a, "host", "full").select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "urls", "versions", "attempts", "ok", "failed")))


def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by exactly one class of their text, counted, by language tag."""
    text = F.col("text")
    kind = classify([("null", text.isNull()), ("empty", text == ""), ("blank", F.trim(F.regexp_replace(text, r"\s", "")) == ""), ("wrong_length", ~F.col("n_chars").eqNullSafe(F.length(text).cast("long"))), ("short", F.length(text) < 400)], "plain")
    return load(spark, sf_dir, "documents", "text", "n_chars", "lang").groupBy(F.coalesce(F.lower(F.trim("lang")), F.lit("none")).alias("lang"), kind.alias("kind")).agg(F.count("*").alias("documents"))


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by age on 1998-08-01: unknown (or later), within 730 days, older."""
    age = F.datediff(F.lit("1998-08-01"), F.to_date("o_orderdate"))
    bucket = classify([("unknown", age.isNull() | (age < 0)), ("within", age <= 730)], "older")
    return load(spark, sf_dir, "orders", "o_orderdate", "o_orderstatus").groupBy(bucket.alias("bucket"), "o_orderstatus").agg(F.count("*").alias("orders"))


def fixed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a fixed vocabulary of event types, zeros included."""
    words = spark.createDataFrame([(w,) for w in ("click", "error", "purchase", "refund", "signup", "view")], "event_type string")
    counts = load(spark, sf_dir, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    return words.join(counts, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("events"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dev cases: support and problem labels against a rule on the text, as counts gained and lost."""
    d = load(spark, sf_dir, "dev_cases", "support", "problem", "text").withColumn("rule", F.coalesce(F.col("text").contains("because"), F.lit(False)))
    hit = lambda c, says, rule: F.count_if((F.col(c) == says) & (F.col("rule") == rule))
    return d.agg(*(hit(c, s, r).alias(f"{c}_{'true' if s else 'false'}_{'found' if r else 'missed'}") for c in ("support", "problem") for s in (True, False) for r in (True, False)))


def null_safe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose final url differs from the url, nulls counting as values, by kind of difference."""
    e = load(spark, sf_dir, "evidence", "url", "final_url").filter(~F.col("url").eqNullSafe(F.col("final_url")))
    kind = classify([("no_final", F.col("final_url").isNull()), ("other_host", host("url") != host("final_url"))], "same_host")
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("rows"))


def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a JSON array in order of date and key; none give []."""
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("x"))
    rows = load(spark, sf_dir, "customer", "c_custkey").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce(F.to_json(F.transform("x", lambda r: F.struct(r["o_orderkey"].alias("k"), r["o_orderstatus"].alias("s")))), F.lit("[]")).alias("orders"))


def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest customer of each nation and segment, nulls last, ties by key."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")
    return load(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def link_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each url's set of contents that doesn't depend on their order."""
    e = load(spark, sf_dir, "evidence", "url", "content_hash").filter("content_hash is not null")
    return e.groupBy("url").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("content_hash")), ","), 256).alias("digest"))


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table: what a backup is compared with."""
    counts = [load(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def gate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by the first data-quality gate that it fails."""
    e = load(spark, sf_dir, "evidence", "title", "attribution", "final_url", "excerpt", "text_chars", "injection_flags")
    gates = [("no_excerpt", F.col("excerpt").isNull()), ("no_title", F.col("title").isNull()), ("flagged", F.size("injection_flags") > 0), ("short_text", F.col("text_chars") < F.length("excerpt")), ("no_attribution", F.col("attribution").isNull()), ("no_final_url", F.col("final_url").isNull())]
    return e.groupBy(F.coalesce(first_failing(gates), F.lit("none")).alias("reason")).agg(F.count("*").alias("rows"))


def gate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All data-quality gates that an evidence row fails, for rows that fail any."""
    e = load(spark, sf_dir, "evidence", "id", "title", "attribution", "final_url", "excerpt", "modified_at")
    gates = [(f"{c}_missing", F.col(c).isNull() | (F.trim(c) == "")) for c in ("title", "attribution", "final_url", "excerpt")]
    return e.select("id", F.array_join(all_failing(gates), ",").alias("reasons")).filter("reasons <> ''")


def status_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by UTC day and outcome class."""
    return deliveries(spark, sf_dir, "id", "attempted_at", "outcome").groupBy(F.date_format("attempted_at", "yyyy-MM-dd").alias("day"), outcome_class().alias("class")).agg(F.count("*").alias("attempts"))


def topic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source with one column a language."""
    d = load(spark, sf_dir, "documents", "source", "lang").withColumn("lang", F.lower(F.trim("lang")))
    return d.groupBy("source").pivot("lang", ["en", "de", "es", "fr"]).count().na.fill(0)


QUERIES = {
    f.__name__: f
    for f in (host_rollup, text_classes, freshness, fixed_vocabulary, confusion, null_safe_diff, json_lists, newest_per_key, link_digest, table_profile, gate_first, gate_all, status_by_day, topic_matrix)
}

_HOST = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
_A = "(select distinct on (id) *, lower(trim(coalesce(outcome, ''))) as t from fetch_attempts)"
_CLASS = "case when t like 'ok%' or t = 'success' then 'ok' when t like 'block%' then 'blocked' when t like 'skip%' or t = 'policy' then 'skipped_policy' when t like 'er%' then 'error' else 'other' end"
SQL = {
    "host_rollup": f"with e as (select {_HOST.format('url')} as host, count(*) as documents, count(distinct url) as urls, max(version_no)::bigint as versions from evidence group by 1), a as (select {_HOST.format('url')} as host, count(*) as attempts, count(*) filter ({_CLASS} = 'ok') as ok, count(*) filter ({_CLASS} in ('error', 'blocked')) as failed from {_A} where url is not null group by 1) select host, coalesce(documents, 0) as documents, coalesce(urls, 0) as urls, coalesce(versions, 0) as versions, coalesce(attempts, 0) as attempts, coalesce(ok, 0) as ok, coalesce(failed, 0) as failed from e full join a using (host)",
    "text_classes": r"select coalesce(lower(trim(lang)), 'none') as lang, case when text is null then 'null' when text = '' then 'empty' when regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g') = '' then 'blank' when n_chars is distinct from length(text) then 'wrong_length' when length(text) < 400 then 'short' else 'plain' end as kind, count(*) as documents from documents group by all",
    "freshness": "select case when d is null or d < 0 then 'unknown' when d <= 730 then 'within' else 'older' end as bucket, o_orderstatus, count(*) as orders from (select date_diff('day', o_orderdate::date, date '1998-08-01') as d, o_orderstatus from orders) group by all",
    "fixed_vocabulary": "select w as event_type, count(event_id) as events from unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) v(w) left join events on event_type = w group by w",
    "confusion": "with d as (select support, problem, coalesce(contains(text, 'because'), false) as rule from dev_cases) select " + ", ".join(f"count(*) filter ({c} = {s} and rule = {r}) as {c}_{s}_{'found' if r == 'true' else 'missed'}" for c in ("support", "problem") for s in ("true", "false") for r in ("true", "false")) + " from d",
    "null_safe_diff": f"select case when final_url is null then 'no_final' when {_HOST.format('url')} <> {_HOST.format('final_url')} then 'other_host' else 'same_host' end as kind, count(*) as rows from evidence where url is distinct from final_url group by 1",
    "json_lists": """select c_custkey, coalesce('[' || string_agg('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}', ',' order by o_orderdate, o_orderkey) || ']', '[]') as orders from customer left join orders on o_custkey = c_custkey group by 1""",
    "newest_per_key": "select c_custkey, c_nationkey, c_mktsegment, c_acctbal from customer qualify row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc nulls last, c_custkey) = 1",
    "link_digest": "select url, sha256(string_agg(distinct content_hash, ',' order by content_hash)) as digest from evidence where content_hash is not null group by url",
    "table_profile": " union all ".join(f"select '{t}' as name, count(*) as rows from {t}" for t in TABLES),
    "gate_first": "select case when excerpt is null then 'no_excerpt' when title is null then 'no_title' when len(injection_flags) > 0 then 'flagged' when text_chars < length(excerpt) then 'short_text' when attribution is null then 'no_attribution' when final_url is null then 'no_final_url' else 'none' end as reason, count(*) as rows from evidence group by 1",
    "gate_all": "select id, concat_ws(',', case when attribution is null or trim(attribution) = '' then 'attribution_missing' end, case when excerpt is null or trim(excerpt) = '' then 'excerpt_missing' end, case when final_url is null or trim(final_url) = '' then 'final_url_missing' end, case when title is null or trim(title) = '' then 'title_missing' end) as reasons from evidence where reasons <> ''",
    "status_by_day": f"select strftime(attempted_at at time zone 'UTC', '%Y-%m-%d') as day, {_CLASS} as class, count(*) as attempts from {_A} group by all",
    "topic_matrix": "with d as (select source, lower(trim(lang)) as lang from documents) select source, " + ", ".join(f"count(*) filter (lang = '{x}') as {x}" for x in ("en", "de", "es", "fr")) + " from d group by source",
}
