"""Joins, selections, set operations and graphs over the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.versions import deliveries, latest, outcome_class
from tessera.sources.tables import load, persisted


def host(column: str | Column) -> Column:
    """The lower-case host of a url, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def reserved_top(rows: DataFrame, limit: int, order: list[Column], unexplored: Column) -> DataFrame:
    """The first `limit` rows in `order`, a third of the places (one at least) kept for unexplored rows if there are any.

    The reserve decides which rows are picked; they come out in `order` all the same.
    """
    share = max(1, limit // 3)
    first = rows.withColumn("_new", unexplored)
    picked = first.filter("_new").orderBy(*order).limit(share)
    key = rows.columns[0]
    rest = first.join(picked.select(key), key, "left_anti").orderBy(*order).limit(limit)
    ranked = picked.withColumn("_r", F.lit(0)).unionByName(rest.withColumn("_r", F.lit(1)))
    return ranked.orderBy("_r", *order).limit(limit).orderBy(*order).drop("_new", "_r")


def roots(edges: DataFrame, child: str, parent: str, levels: int = 5) -> DataFrame:
    """(child, root, depth): each child's topmost ancestor within `levels` steps; an unknown or null parent ends the walk,
    a cycle ends after `levels`. One broadcastable self-join a level, without collecting."""
    up = edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p"))
    at = edges.select(F.col(child), F.col(child).alias("root"), F.lit(0).cast("long").alias("depth"))
    for _ in range(levels):
        known = up.join(up.select(F.col("_c").alias("_k")), F.col("_p") == F.col("_k"), "left_semi")
        at = at.join(known, at["root"] == known["_c"], "left").select(child, F.coalesce("_p", "root").alias("root"), (F.col("depth") + F.col("_p").isNotNull().cast("long")).alias("depth"))
    return at


def components(links: DataFrame) -> DataFrame:
    """(node, component): connected components of links (a BIGINT, b BIGINT); a component's name is its least node.

    Large-star and small-star steps in turn, until nothing changes; each step is written, so lineage stays short and a
    lost executor costs one step. A hub's neighbours are spread by the shuffle on nodes, and minima are pre-aggregated.
    Null ends and loops are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    edges = persisted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b")))
        edges = persisted(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()


def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permitted urls whose last attempt is over a week before the newest attempt, oldest first, 500 at most."""
    attempts = deliveries(spark, sf_dir, "id", "url", "attempted_at", "robots_status").filter("url is not null")
    last = latest(attempts, "url", ["attempted_at", "id"]).filter("robots_status is null or robots_status <> 'disallowed'")
    due = last.filter(F.col("attempted_at") < attempts.agg(F.max("attempted_at")).scalar() - F.expr("interval 7 days"))
    return due.orderBy("attempted_at", "url").limit(500).select("url", F.unix_micros("attempted_at").alias("last_us"))


def exploration_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 customers by balance, a third of the places kept for those without an order in 1998."""
    recent = load(spark, sf_dir, "orders", "o_custkey", "o_orderdate").filter("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_seen", F.lit(True))
    rows = load(spark, sf_dir, "customer", "c_custkey", "c_acctbal").join(recent, "c_custkey", "left")
    picked = reserved_top(rows, 30, [F.desc("c_acctbal"), F.asc("c_custkey")], F.col("_seen").isNull())
    # 30 rows: one window over them numbers the places
    return picked.select("c_custkey", "c_acctbal", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("place"))


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 25 evidence rows whose text was never stored."""
    e, t = load(spark, sf_dir, "evidence", "id", "url", "fetched_at"), load(spark, sf_dir, "evidence_text", "evidence_id")
    return e.join(t, e["id"] == t["evidence_id"], "left_anti").orderBy(F.desc("fetched_at"), F.desc("id")).limit(25).select("id", "url")


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts matched to a publisher by its host or, failing that, by one version's attribution: a disjunctive lookup as two equi-joins."""
    e = load(spark, sf_dir, "evidence", "url", "attribution").select(host("url").alias("host"), "attribution").groupBy("host").agg(F.max("attribution").alias("attribution"))
    p = load(spark, sf_dir, "publishers", "publisher_id", "canonical_name", "host")
    by_host, by_name = p.select(F.col("host"), F.col("publisher_id").alias("h")), p.select(F.col("canonical_name").alias("attribution"), F.col("publisher_id").alias("n"))
    return e.join(by_host, "host", "left").join(by_name, "attribution", "left").select("host", F.coalesce("h", "n").alias("publisher_id"), F.when(F.col("h").isNotNull(), "host").when(F.col("n").isNotNull(), "alias").alias("by"))


def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that stored something with their evidence, and its text where there is one."""
    a = deliveries(spark, sf_dir, "id", "evidence_id").filter("evidence_id is not null")
    e, t = load(spark, sf_dir, "evidence", "id", "version_no").withColumnRenamed("id", "evidence_id"), load(spark, sf_dir, "evidence_text", "evidence_id", "text")
    return a.join(e, "evidence_id").join(t, "evidence_id", "left").select("id", "evidence_id", F.col("version_no").cast("long").alias("version_no"), F.length("text").cast("long").alias("chars"))


def current_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with the evidence they stored, where its text is stored and no newer version of its url is."""
    a = deliveries(spark, sf_dir, "id", "evidence_id").filter("evidence_id is not null")
    e, t = load(spark, sf_dir, "evidence", "id", "url", "version_no").withColumnRenamed("id", "evidence_id"), load(spark, sf_dir, "evidence_text", "evidence_id")
    newest = e.groupBy("url").agg(F.max("version_no").alias("version_no"))
    return a.join(e, "evidence_id").join(t, "evidence_id", "left_semi").join(newest, ["url", "version_no"]).select("id", "evidence_id", "url")


def latest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dev case's newest evidence of its source, or null: a correlated scalar subquery as one ranked join."""
    e = load(spark, sf_dir, "evidence", "id", "url", "fetched_at").withColumn("source", host("url"))
    newest = e.groupBy("source").agg(F.max_by("id", F.struct("fetched_at", "id")).alias("evidence_id"))
    return load(spark, sf_dir, "dev_cases", "name", "source").join(newest, "source", "left").select("name", "evidence_id")


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and their next words of each document title, paired by position."""
    d = load(spark, sf_dir, "documents", "doc_id", "title").filter("title is not null").withColumn("w", F.split("title", " "))
    pairs = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("x"), F.slice("w", 2, F.size("w") - 1).alias("y"))
    return d.filter(F.size("w") > 1).select("doc_id", F.posexplode(pairs).alias("n", "p")).select("doc_id", F.col("n").cast("long").alias("n"), "p.x", "p.y")


def set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of differences and intersections of evidence, texts and attempts."""
    e = load(spark, sf_dir, "evidence", "id")
    t = load(spark, sf_dir, "evidence_text").select(F.col("evidence_id").alias("id"))
    a = load(spark, sf_dir, "fetch_attempts", "evidence_id").filter("evidence_id is not null").select(F.col("evidence_id").alias("id")).distinct()
    sizes = [("without_text", e.join(t, "id", "left_anti")), ("never_attempted", e.join(a, "id", "left_anti")), ("both", t.join(a, "id", "left_semi")), ("either", t.union(a).distinct())]
    one = sizes[0][1].agg(F.count("*").alias("n")).select(F.lit(sizes[0][0]).alias("what"), "n")
    for what, df in sizes[1:]:
        one = one.union(df.agg(F.count("*").alias("n")).select(F.lit(what), "n"))
    return one


def keep_first_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from three lists in order of priority, each name (letter case apart) kept where it comes first."""
    parts = [load(spark, sf_dir, "publishers").select(F.lit(1).alias("rank"), F.col("canonical_name").alias("name"), F.lit("publisher").alias("via")),
             load(spark, sf_dir, "evidence").select(F.lit(2), F.col("attribution"), F.lit("evidence")),
             load(spark, sf_dir, "documents").select(F.lit(3), F.col("topic"), F.lit("topic"))]
    rows = parts[0].union(parts[1]).union(parts[2]).filter("name is not null")
    return rows.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("rank", "name", "via")).alias("m")).select("key", "m.name", "m.via")


def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each case's document against the allowed ones: missing, surplus, and whether unknown fields overlap."""
    allowed = F.array(*(F.lit(k) for k in ("name", "completeness", "conflicts", "unknown_fields")))
    d = load(spark, sf_dir, "holdout_cases", "case_id", "document").withColumn("keys", F.json_object_keys("document")).filter("keys is not null")
    return d.select("case_id", F.array_join(F.array_sort(F.array_except(allowed, "keys")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("keys", allowed)), ",").alias("surplus"), F.arrays_overlap(allowed, "keys").alias("overlap"))


def publisher_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topmost owner of each publisher and how far away it is."""
    return roots(load(spark, sf_dir, "publishers", "publisher_id", "parent_publisher"), "publisher_id", "parent_publisher")


def independent_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By content that several urls share: urls, publishers, and publishers of different owners."""
    p = load(spark, sf_dir, "publishers", "publisher_id", "canonical_name", "parent_publisher")
    of = roots(p, "publisher_id", "parent_publisher").join(p.select("publisher_id", "canonical_name"), "publisher_id").select(F.col("canonical_name").alias("attribution"), "publisher_id", "root")
    e = load(spark, sf_dir, "evidence", "content_hash", "url", "attribution").join(of, "attribution", "left")
    return e.groupBy("content_hash").agg(F.countDistinct("url").alias("urls"), F.countDistinct("publisher_id").alias("publishers"), F.countDistinct("root").alias("owners")).filter("urls > 1")


def ancestry(links: DataFrame) -> DataFrame:
    """(id, ancestor, depth): all that each row of `links` (id, ancestor), one row an id, comes from, with the distance.

    By pointer doubling: a round joins each id's ancestor at 2^r steps with what that one reaches within 2^r steps, so a
    chain of n links takes log n rounds. Of a cycle each member comes out once, at its least distance."""
    every = persisted(links.filter("ancestor is not null").select("id", "ancestor", F.lit(1).cast("long").alias("depth")))
    jump, reach = every.select("id", "ancestor"), 1
    while True:
        onward = every.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_a"), "depth")
        met = jump.join(onward, "ancestor").groupBy("id", F.col("_a").alias("ancestor")).agg((F.min("depth") + reach).alias("depth"))
        new = persisted(met.join(every.select("id", "ancestor"), ["id", "ancestor"], "left_anti").select("id", "ancestor", "depth"))
        if new.isEmpty():
            return every
        # an id without new ancestors is done; one that leads to it has met all of them in this round
        far = jump.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_a"))
        jump = persisted(jump.join(new.select("id").distinct(), "id", "left_semi").join(far, "ancestor").select("id", F.col("_a").alias("ancestor")))
        every, reach = every.union(new), 2 * reach


def version_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each evidence row along supersedes_id, with their distance."""
    return ancestry(load(spark, sf_dir, "evidence", "id", "supersedes_id").select("id", F.col("supersedes_id").alias("ancestor")))


def content_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows connected by an equal content or an equal final url: each with its group's least id."""
    e = load(spark, sf_dir, "evidence", "id", "content_hash", "final_url")
    star = lambda c: e.filter(F.col(c).isNotNull()).withColumn("b", F.min("id").over(Window.partitionBy(c))).select(F.col("id").alias("a"), "b")
    return components(star("content_hash").union(star("final_url"))).select(F.col("node").alias("id"), "component")


def slot_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose (brand, size) no other part has: groups of several are dropped altogether."""
    w = Window.partitionBy("p_brand", "p_size")
    return load(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").withColumn("n", F.count("*").over(w)).filter("n = 1").select("p_partkey", "p_brand", "p_size")


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur more than once in fetch_attempts, and in how many different rows."""
    a = load(spark, sf_dir, "fetch_attempts")
    return a.groupBy("id").agg(F.count("*").alias("rows"), F.countDistinct("url", "outcome", "attempted_at").alias("forms")).filter("rows > 1")


def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next open order of each market segment: by priority, then age."""
    o, c = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate").filter("o_orderstatus = 'O'"), load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderdate", "o_orderkey")).alias("o_orderkey"))


def idempotent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest attempt under each idempotency key (run and url)."""
    rows = deliveries(spark, sf_dir, "id", "run_id", "url", "attempted_at").withColumn("key", F.concat_ws(":", "run_id", "url"))
    return rows.groupBy("key").agg(F.max_by("id", F.struct("attempted_at", "id")).alias("id"), F.count("*").alias("tries"))


def daily_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of arrival, the first 100 of a UTC day granted and the others refused, counted by day."""
    rows = load(spark, sf_dir, "events", "event_id", "ts").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")))
    return rows.groupBy("day").agg(F.count_if(F.col("n") <= 100).alias("granted"), F.count_if(F.col("n") > 100).alias("refused"))


def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by outcome class and robots status."""
    return deliveries(spark, sf_dir, "id", "outcome", "robots_status").groupBy(outcome_class().alias("class"), "robots_status").agg(F.count("*").alias("attempts"))


QUERIES = {
    f.__name__: f
    for f in (due_sources, exploration_reserve, backlog, alias_lookup, three_way, current_attempts, latest_lookup, positional_zip, set_sizes, keep_first_union, array_sets, publisher_roots, independent_publishers,
              version_ancestry, content_components, slot_collisions, duplicate_keys, queue_claim, idempotent_lookup, daily_ledger, attempt_outcomes)
}

_HOST = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
_ROOTS = """with recursive w as (select publisher_id, publisher_id as root, 0::bigint as depth from publishers
union all select w.publisher_id, p.parent_publisher, w.depth + 1 from w join publishers p on p.publisher_id = w.root where w.depth < 5 and p.parent_publisher in (select publisher_id from publishers)),
r as (select publisher_id, root, depth from w qualify row_number() over (partition by publisher_id order by depth desc) = 1)"""
_A = "(select distinct on (id) *, lower(trim(coalesce(outcome, ''))) as t from fetch_attempts)"
SQL = {
    "due_sources": f"with l as (select * from {_A} where url is not null qualify row_number() over (partition by url order by attempted_at desc nulls last, id desc) = 1) select url, epoch_us(attempted_at) as last_us from l where (robots_status is null or robots_status <> 'disallowed') and attempted_at < (select max(attempted_at) from fetch_attempts where url is not null) - interval 7 day order by attempted_at, url limit 500",
    "exploration_reserve": "select *, row_number() over (order by c_acctbal desc, c_custkey) as place from (with r as (select c_custkey, c_acctbal, c_custkey not in (select o_custkey from orders where o_orderdate >= '1998-01-01') as fresh from customer), p as (select * from r where fresh order by c_acctbal desc, c_custkey limit 10) select c_custkey, c_acctbal from (select c_custkey, c_acctbal, 0 as k from p union all (select c_custkey, c_acctbal, 1 as k from r where c_custkey not in (select c_custkey from p) order by c_acctbal desc, c_custkey limit 30)) order by k, c_acctbal desc, c_custkey limit 30)",
    "backlog": "select id, url from evidence where id not in (select evidence_id from evidence_text) order by fetched_at desc, id desc limit 25",
    "alias_lookup": f"with e as (select {_HOST.format('url')} as host, max(attribution) as attribution from evidence group by 1) select e.host, coalesce(h.publisher_id, n.publisher_id) as publisher_id, case when h.publisher_id is not null then 'host' when n.publisher_id is not null then 'alias' end as by from e left join publishers h on h.host = e.host left join publishers n on n.canonical_name = e.attribution",
    "three_way": "select a.id, a.evidence_id, version_no::bigint as version_no, length(text) as chars from (select distinct id, evidence_id from fetch_attempts where evidence_id is not null) a join evidence e on e.id = a.evidence_id left join evidence_text t on t.evidence_id = a.evidence_id",
    "current_attempts": "select a.id, a.evidence_id, e.url from (select distinct id, evidence_id from fetch_attempts where evidence_id is not null) a join evidence e on e.id = a.evidence_id where e.id in (select evidence_id from evidence_text) and version_no = (select max(version_no) from evidence x where x.url = e.url)",
    "latest_lookup": f"with n as (select {_HOST.format('url')} as source, arg_max(id, (fetched_at, id)) as evidence_id from evidence group by 1) select name, evidence_id from dev_cases left join n using (source)",
    "positional_zip": "select doc_id, i as n, w[i + 1] as x, w[i + 2] as y from (select doc_id, string_split(title, ' ') as w from documents where title is not null) t, range(0, len(w) - 1) r(i)",
    "set_sizes": "with t as (select evidence_id as id from evidence_text), a as (select distinct evidence_id as id from fetch_attempts where evidence_id is not null) select 'without_text' as what, count(*) as n from evidence where id not in (from t) union all select 'never_attempted', count(*) from evidence where id not in (from a) union all select 'both', count(*) from t where id in (from a) union all select 'either', count(*) from (from t union from a)",
    "keep_first_union": "with r as (select 1 as rank, canonical_name as name, 'publisher' as via from publishers union all select 2, attribution, 'evidence' from evidence union all select 3, topic, 'topic' from documents) select lower(name) as key, name, via from r where name is not null qualify row_number() over (partition by lower(name) order by rank, name, via) = 1",
    "array_sets": "with k as (select case_id, json_keys(document) as keys from holdout_cases where try_cast(document as json) is not null), a as (select ['name', 'completeness', 'conflicts', 'unknown_fields'] as allowed) select case_id, coalesce(array_to_string(list_sort(list_filter(allowed, lambda x: not list_contains(keys, x))), ','), '') as missing, coalesce(array_to_string(list_sort(list_filter(keys, lambda x: not list_contains(allowed, x))), ','), '') as surplus, list_has_any(allowed, keys) as overlap from k, a where keys is not null",
    "publisher_roots": f"{_ROOTS} select publisher_id, root, depth from r",
    "independent_publishers": f"{_ROOTS}, o as (select canonical_name as attribution, publisher_id, root from r join publishers using (publisher_id)) select content_hash, count(distinct url) as urls, count(distinct publisher_id) as publishers, count(distinct root) as owners from evidence left join o using (attribution) group by content_hash having count(distinct url) > 1",
    "version_ancestry": "with recursive w as (select id, supersedes_id as ancestor, 1::bigint as depth from evidence where supersedes_id is not null union all select w.id, e.supersedes_id, depth + 1 from w join evidence e on e.id = w.ancestor where e.supersedes_id is not null) select * from w",
    "content_components": "with recursive e as (select id, content_hash, final_url from evidence), s as (select id as a, min(id) over (partition by content_hash) as b from e where content_hash is not null union select id, min(id) over (partition by final_url) from e where final_url is not null), l as (select a, b from s where a <> b union select b, a from s where a <> b), r as (select a, a as b from l union select r.a, l.b from r join l on l.a = r.b) select a as id, min(b) as component from r group by 1",
    "slot_collisions": "select p_partkey, p_brand, p_size from part qualify count(*) over (partition by p_brand, p_size) = 1",
    "duplicate_keys": "select id, count(*) as rows, count(distinct (url, outcome, attempted_at)) filter (url is not null and outcome is not null and attempted_at is not null) as forms from fetch_attempts group by id having count(*) > 1",
    "queue_claim": "select c_mktsegment, arg_min(o_orderkey, (o_orderpriority, o_orderdate, o_orderkey)) as o_orderkey from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O' group by 1",
    "idempotent_lookup": f"select concat_ws(':', run_id, url) as key, arg_max(id, (attempted_at, id)) as id, count(*) as tries from {_A} group by 1",
    "daily_ledger": "with r as (select strftime(ts, '%Y-%m-%d') as day, row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts, event_id) as n from events) select day, count(*) filter (n <= 100) as granted, count(*) filter (n > 100) as refused from r group by day",
    "attempt_outcomes": f"select case when t like 'ok%' or t = 'success' then 'ok' when t like 'block%' then 'blocked' when t like 'skip%' or t = 'policy' then 'skipped_policy' when t like 'er%' then 'error' else 'other' end as class, robots_status, count(*) as attempts from {_A} group by all",
}
