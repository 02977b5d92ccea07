"""Who may be read, what is waiting, and corrections of what is stored: permissions, hints, reviews, lineage and updates.

Each query reads whole tables. Null keys take no part unless the docstring says so; repeated deliveries of an attempt count
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.records import _SPECIAL, KIND_SQL, _HOST_OR_ADDRESS, host_kind
from tessera.operators.relations import components, host, roots
from tessera.operators.texts import _KEYWORDS
from tessera.operators.versions import deliveries, latest, outcome_class
from tessera.sources.tables import load, persisted

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_LOGIN = "(?i)/(accounts/)?(login|signin|sign-in|auth)(/|$)"
#: Pairs of a destination and the url that was allowed, for the rules that the store's urls never break.
_DESTINATIONS = (("ftp://hearthlane.example/x", "ftp://hearthlane.example/x"), ("http://127.0.0.1/", "http://127.0.0.1/"), ("https://hearthlane.example/Login/x", "https://hearthlane.example/"), ("https://hearthlane.example/login", "https://hearthlane.example/login?next=1"), ("https://hearthlane.example/auth", "https://hearthletters.example/auth"))


def robots_state(status: str) -> Column:
    """What an origin's robots file says by the status of its answer: fetched, absent (no rules) or unavailable; null is no answer."""
    s = F.col(status)
    return F.when(s == 200, "fetched").when((s >= 400) & (s < 500), "absent").otherwise("unavailable")


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, status): the landed answers, by the newest attempt of each host that has a status."""
    a = deliveries(spark, sf_dir, "id", "url", "attempted_at", "http_status").withColumn("host", host("url")).filter("url is not null")
    return latest(a, "host", ["attempted_at", "id"]).select("host", F.col("http_status").cast("long").alias("status"))


def robots_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by the state of their newest answer."""
    return _robots(spark, sf_dir).groupBy(robots_state("status").alias("state")).agg(F.count("*").alias("hosts"))


def permission_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts' destinations by the first rule that refuses them: scheme, host, origin, login page, robots; else permitted."""
    a = deliveries(spark, sf_dir, "id", "url", "final_url").filter("url is not null").select(F.coalesce("final_url", "url").alias("to"), F.col("url").alias("allowed"))
    rows = a.union(spark.createDataFrame(list(_DESTINATIONS), "to string, allowed string")).withColumn("host", host("to"))
    rows = rows.join(_robots(spark, sf_dir), "host", "left")
    origin, path = (lambda c: F.lower(F.regexp_extract(c, _ORIGIN, 1))), (lambda c: F.regexp_extract(c, _PATH, 1))
    rule = (
        F.when(~F.lower("to").rlike("^https?://"), "not_http").when(host_kind("to").isin("none", "local", "private_address"), "private_host").when(origin("to") != origin("allowed"), "other_origin")
        .when(path("to").rlike(_LOGIN) & ~path("allowed").rlike(_LOGIN), "login_page").when(robots_state("status") == "unavailable", "robots_unavailable").otherwise("permitted")
    )
    return rows.groupBy(rule.alias("rule")).agg(F.count("*").alias("destinations"))


def effective_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers whose host, or whose owner's host as an alias, is listed as not permitted in any case: which one denies."""
    surface = load(spark, sf_dir, "holdout_cases", "surface").select(host(F.get_json_object("surface", "$.url")).alias("host"), F.get_json_object("surface", "$.access_status").alias("status")).filter("host <> ''")
    listed = surface.groupBy("host").agg(F.max((F.col("status") != "permitted").cast("int")).alias("refused"))
    p = load(spark, sf_dir, "publishers", "publisher_id", "host", "parent_publisher")
    owner = p.select(F.col("publisher_id").alias("parent_publisher"), F.col("host").alias("alias"))
    rows = p.join(owner, "parent_publisher", "left").join(listed, "host", "left").join(listed.select(F.col("host").alias("alias"), F.col("refused").alias("by_alias")), "alias", "left")
    return rows.select("publisher_id", F.when(F.col("refused") == 1, "host").when(F.col("by_alias") == 1, "alias").otherwise("none").alias("denied_by"))


def unassessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 oldest attempts that were refused or failed without any status, in order."""
    a = deliveries(spark, sf_dir, "id", "url", "attempted_at", "http_status", "reason").filter("reason is not null and http_status is null")
    return a.orderBy("attempted_at", "id").limit(50).select("id", "url")


def permitted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls that may be read under an open licence without constraints, in the shape of a source list."""
    e = load(spark, sf_dir, "evidence", "url", "source_type", "attribution", "access_basis", "usage_constraints")
    return e.filter("access_basis = 'open_licence' and usage_constraints is null").select("url", "source_type", "attribution", F.lit(True).alias("fetch")).distinct()


def human_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by who reviewed them: a named person, something else, nobody."""
    who = F.col("reviewed_by")
    kind = F.when(who.rlike(r"^human:\s*\S"), "human").when(who.isNull(), "nobody").otherwise("other")
    return load(spark, sf_dir, "holdout_cases", "reviewed_by").groupBy(kind.alias("kind")).agg(F.count("*").alias("cases"))


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, upstream, link): what each evidence row derives from, the version it supersedes and the first row with its content."""
    e = load(spark, sf_dir, "evidence", "id", "supersedes_id", "content_hash")
    first = e.filter("content_hash is not null").withColumn("upstream", F.min("id").over(Window.partitionBy("content_hash"))).filter("upstream <> id").select("id", "upstream", F.lit("same_content").alias("link"))
    return e.filter("supersedes_id is not null").select("id", F.col("supersedes_id").alias("upstream"), F.lit("supersedes").alias("link")).union(first)


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by state: those without an outcome are ambiguous if their url was tried again later, else still reserved."""
    a = deliveries(spark, sf_dir, "id", "url", "attempted_at", "outcome").withColumn("next", F.lead("id").over(Window.partitionBy("url").orderBy("attempted_at", "id")))
    state = F.when(F.col("outcome").isNotNull(), "done").when(F.col("next").isNotNull() & F.col("url").isNotNull(), "ambiguous").otherwise("reserved")
    return a.groupBy(state.alias("state")).agg(F.count("*").alias("attempts"))


def reset_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing urls after the sources of publishers with an owner were reset by hand: whose failures count from zero again."""
    a = deliveries(spark, sf_dir, "id", "url", "attempted_at", "outcome").filter("url is not null").withColumn("bad", outcome_class().isin("error", "blocked"))
    last = latest(a, "url", ["attempted_at", "id"]).filter("bad").select("url", host("url").alias("host"))
    by = load(spark, sf_dir, "publishers", "host", "parent_publisher").filter("parent_publisher is not null").select("host", F.lit(True).alias("reset"))
    return last.join(by, "host", "left").select("url", F.coalesce("reset", F.lit(False)).alias("reset"))


def corrected_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose stored size is missing or wrong, with the size of their text (0 without one): the update that puts them right."""
    d = load(spark, sf_dir, "documents", "doc_id", "text", "n_chars").withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return d.filter(~F.col("n_chars").eqNullSafe(F.col("size"))).select("doc_id", F.col("n_chars").alias("stored"), "size")


_SENTINELS = ("pub_001", "pub_002", "pub_003")


def owner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from publishers to owners, but for those from sentinel publishers, with the key that makes them unique."""
    p = load(spark, sf_dir, "publishers", "publisher_id", "parent_publisher").filter(F.col("parent_publisher").isNotNull() & ~F.col("publisher_id").isin(*_SENTINELS)).distinct()
    return p.select("publisher_id", "parent_publisher", F.substring(F.sha2(F.concat_ws("|", "publisher_id", F.lit("owned_by"), "parent_publisher"), 256), 1, 32).alias("key"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split: cases whose fingerprint is the observed content (matched), another one (revoked), or not given (orphan)."""
    c = load(spark, sf_dir, "holdout_cases", "split", "content_fingerprint", "observed").withColumn("seen", F.lower("observed.content_hash"))
    split = F.lower(F.regexp_replace(F.coalesce("split", F.lit("")), "[^A-Za-z0-9]+", ""))
    print_ = F.lower("content_fingerprint")
    return c.groupBy(split.alias("split")).agg(F.count_if(print_ == F.col("seen")).alias("matched"), F.count_if(print_ != F.col("seen")).alias("revoked"), F.count_if(print_.isNull() | F.col("seen").isNull()).alias("orphan"))


def case_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases as one corpus: by split and host, how many have a text, and how many a fingerprint that is their own text's."""
    dev = load(spark, sf_dir, "dev_cases").select(F.lit("train").alias("split"), "source", "text", F.lit(None).cast("string").alias("print"))
    hold = load(spark, sf_dir, "holdout_cases").select(F.lower(F.regexp_replace(F.coalesce("split", F.lit("")), "[^A-Za-z0-9]+", "")).alias("split"), "source", F.col("evidence_text").alias("text"), F.lower("content_fingerprint").alias("print"))
    return dev.union(hold).groupBy("split", "source").agg(F.count("*").alias("cases"), F.count_if(F.col("text") != "").alias("with_text"), F.count_if(F.sha2("text", 256) == F.col("print")).alias("own_print"))


def run_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by the parts of their names (kind, day, number), and their state: failed if all attempts did, open if one has no outcome, else done."""
    a = deliveries(spark, sf_dir, "id", "run_id", "outcome").filter("run_id is not null").withColumn("bad", outcome_class().isin("error", "blocked"))
    runs = a.groupBy("run_id").agg(F.count("*").alias("attempts"), F.min(F.col("bad").cast("int")).alias("all_bad"), F.max(F.col("outcome").isNull().cast("int")).alias("open"))
    part = lambda n: F.regexp_extract("run_id", "^([a-z]+)-([0-9]{8})-([0-9]+)$", n)
    return runs.select("run_id", part(1).alias("kind"), part(2).alias("day"), part(3).try_cast("long").alias("number"), "attempts", F.when(F.col("all_bad") == 1, "failed").when(F.col("open") == 1, "open").otherwise("done").alias("state"))


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 hosts that are most worth reading next: share of successes times the logarithm of attempts, rounded, names breaking ties."""
    a = deliveries(spark, sf_dir, "id", "url", "outcome").filter("url is not null").select(host("url").alias("host"), (outcome_class() == "ok").cast("int").alias("ok"))
    score = F.round(F.avg("ok") * F.ln(F.count("*") + F.lit(1.0)), 4)
    return a.groupBy("host").agg(score.alias("score"), F.count("*").alias("attempts")).orderBy(F.desc("score"), "host").limit(50)


def seeded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs to fetch evidence whose text is missing, under a key of kind, id and version; those whose url was attempted after it was stored are not seeded again."""
    e, t = load(spark, sf_dir, "evidence", "id", "url", "version_no", "fetched_at"), load(spark, sf_dir, "evidence_text", "evidence_id")
    waiting = e.join(t, e["id"] == t["evidence_id"], "left_anti")
    tried = deliveries(spark, sf_dir, "id", "url", "attempted_at").filter("url is not null").groupBy("url").agg(F.max("attempted_at").alias("tried_at"))
    jobs = waiting.join(tried, "url", "left").filter("tried_at is null or tried_at <= fetched_at")
    return jobs.select(F.concat_ws(":", F.lit("fetch"), "id", "version_no").alias("key"), "url")


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted score of each document: keywords hit (up to 6) count 0.30, relevant ones (up to 5) 0.15, and 0.075 is given; detected from a density of 0.30 on."""
    d = load(spark, sf_dir, "documents", "doc_id", "text").withColumn("l", F.lower("text"))
    hits = sum((F.coalesce(F.col("l").contains(k).cast("int"), F.lit(0)) for k in _KEYWORDS), F.lit(0))
    relevant = sum((F.coalesce(F.col("l").contains(k).cast("int"), F.lit(0)) for k in _KEYWORDS[:5]), F.lit(0))
    score = 0.30 * F.least(F.lit(1.0), hits / F.lit(6.0)) + 0.15 * F.least(F.lit(1.0), relevant / F.lit(5.0)) + 0.075
    return d.select("doc_id", F.round(score, 4).alias("score"), (F.least(F.lit(1.0), hits / F.lit(6.0)) >= 0.30).alias("detected"))


def span_label(seconds: Column) -> Column:
    """A span of seconds as minutes, hours or days: 5m, 7h, 12d."""
    whole = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def age_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each url was last attempted, seen from 2024-06-01: 5d ago, in 3h; and the day a week after it, in words."""
    a = latest(deliveries(spark, sf_dir, "id", "url", "attempted_at").filter("url is not null"), "url", ["attempted_at", "id"])
    age = F.lit(1717200000) - F.unix_seconds("attempted_at")
    label = F.when(age.isNull(), "never").when(age < 0, F.concat(F.lit("in "), span_label(-age))).otherwise(F.concat(span_label(age), F.lit(" ago")))
    return a.select("url", label.alias("age"), F.date_format(F.col("attempted_at") + F.expr("interval 7 days"), "d MMM yyyy").alias("follow_up"))


def independent_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By title that several rows have: rows, groups of rows that are independent (no common content and no common owner), and owners."""
    p = load(spark, sf_dir, "publishers", "publisher_id", "canonical_name", "parent_publisher")
    owner = roots(p, "publisher_id", "parent_publisher").join(p.select("publisher_id", "canonical_name"), "publisher_id").groupBy("canonical_name").agg(F.min("root").alias("root"))
    e = load(spark, sf_dir, "evidence", "id", "title", "content_hash", "attribution").filter("title is not null")
    e = persisted(e.join(owner, e["attribution"] == owner["canonical_name"], "left").select("id", "title", "content_hash", "root"))
    star = lambda c: e.filter(F.col(c).isNotNull()).withColumn("b", F.min("id").over(Window.partitionBy("title", c))).select(F.col("id").alias("a"), "b")
    joined = components(star("content_hash").union(star("root")))
    rows = e.join(joined, e["id"] == joined["node"], "left")
    return rows.groupBy("title").agg(F.count("*").alias("rows"), F.countDistinct(F.coalesce("component", "id")).alias("independent"), F.array_join(F.array_sort(F.collect_set("root")), ",").alias("owners")).filter("rows > 1")


QUERIES = {
    f.__name__: f
    for f in (robots_states, permission_chain, effective_deny, unassessed, permitted_sources, human_reviews, lineage_edges, settled, reset_sources, corrected_sizes, owner_edges, corrections, case_corpus, run_queue, frontier, seeded_jobs,
              source_quality, age_spans, independent_support)
}

_HOST = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
_CLASS = "case when t like 'ok%' or t = 'success' then 'ok' when t like 'block%' then 'blocked' when t like 'skip%' or t = 'policy' then 'skipped_policy' when t like 'er%' then 'error' else 'other' end"
_A = "(select distinct on (id) *, lower(trim(coalesce(outcome, ''))) as t from fetch_attempts)"
_LAST = f"(select * from {_A} where url is not null qualify row_number() over (partition by url order by attempted_at desc nulls last, id desc) = 1)"
_ROBOTS = f"(select host, http_status::bigint as status from (select *, {_HOST.format('url')} as host from {_A} where url is not null) qualify row_number() over (partition by host order by attempted_at desc nulls last, id desc) = 1)"
_STATE = "case when status = 200 then 'fetched' when status >= 400 and status < 500 then 'absent' else 'unavailable' end"
_SPLIT = "lower(regexp_replace(coalesce(split, ''), '[^A-Za-z0-9]+', '', 'g'))"
_hits = lambda ks: "(" + " + ".join(f"coalesce(contains(lower(text), '{k}')::int, 0)" for k in ks) + ")"
_span = lambda s: f"case when {s} < 3600 then ({s} // 60) || 'm' when {s} < 86400 then ({s} // 3600) || 'h' else ({s} // 86400) || 'd' end"
_TO = f"(select coalesce(final_url, url) as final_url, url as allowed from {_A} where url is not null union all select * from (values {', '.join(map(repr, _DESTINATIONS))}))"
SQL = {
    "robots_states": f"select {_STATE} as state, count(*) as hosts from {_ROBOTS} group by 1",
    "permission_chain": f"with d as (select *, {_HOST.format('final_url')} as host, lower(regexp_extract(final_url, '{_HOST_OR_ADDRESS}', 1)) as h from {_TO}) select case when not regexp_matches(lower(final_url), '^https?://') then 'not_http' when {KIND_SQL} in ('none', 'local', 'private_address') then 'private_host' when lower(regexp_extract(final_url, '{_ORIGIN}', 1)) <> lower(regexp_extract(allowed, '{_ORIGIN}', 1)) then 'other_origin' when regexp_matches(regexp_extract(final_url, '{_PATH}', 1), '{_LOGIN}') and not regexp_matches(regexp_extract(allowed, '{_PATH}', 1), '{_LOGIN}') then 'login_page' when {_STATE} = 'unavailable' then 'robots_unavailable' else 'permitted' end as rule, count(*) as destinations from d left join {_ROBOTS} r using (host) group by 1",
    "effective_deny": f"with s as (select {_HOST.format(chr(117))} as host, max((status <> 'permitted')::int) as refused from (select s->>'$.url' as u, s->>'$.access_status' as status from (select try_cast(surface as json) as s from holdout_cases)) group by 1) select p.publisher_id, case when a.refused = 1 then 'host' when b.refused = 1 then 'alias' else 'none' end as denied_by from publishers p left join publishers o on o.publisher_id = p.parent_publisher left join s a on a.host = p.host left join s b on b.host = o.host",
    "unassessed": f"select id, url from {_A} where reason is not null and http_status is null order by attempted_at, id limit 50",
    "permitted_sources": "select distinct url, source_type, attribution, true as fetch from evidence where access_basis = 'open_licence' and usage_constraints is null",
    "human_reviews": r"select case when regexp_matches(reviewed_by, '^human:\s*\S') then 'human' when reviewed_by is null then 'nobody' else 'other' end as kind, count(*) as cases from holdout_cases group by 1",
    "lineage_edges": "select id, supersedes_id as upstream, 'supersedes' as link from evidence where supersedes_id is not null union all select e.id, m.m, 'same_content' from evidence e join (select content_hash, min(id) as m from evidence group by 1) m using (content_hash) where m.m <> e.id",
    "settled": f"select case when outcome is not null then 'done' when n is not null and url is not null then 'ambiguous' else 'reserved' end as state, count(*) as attempts from (select *, lead(id) over (partition by url order by attempted_at, id) as n from {_A}) group by 1",
    "reset_sources": f"select url, {_HOST.format('url')} in (select host from publishers where parent_publisher is not null) as reset from {_LAST} where {_CLASS} in ('error', 'blocked')",
    "corrected_sizes": "select doc_id, n_chars as stored, coalesce(length(text), 0) as size from documents where n_chars is distinct from coalesce(length(text), 0)",
    "owner_edges": f"select distinct publisher_id, parent_publisher, substring(sha256(concat_ws('|', publisher_id, 'owned_by', parent_publisher)), 1, 32) as key from publishers where parent_publisher is not null and publisher_id not in {_SENTINELS}",
    "corrections": f"select {_SPLIT} as split, count(*) filter (p = s) as matched, count(*) filter (p <> s) as revoked, count(*) filter (p is null or s is null) as orphan from (select split, lower(content_fingerprint) as p, lower(observed.content_hash) as s from holdout_cases) group by 1",
    "case_corpus": f"select split, source, count(*) as cases, count(*) filter (text <> '') as with_text, count(*) filter (sha256(text) = p) as own_print from (select 'train' as split, source, text, null as p from dev_cases union all select {_SPLIT}, source, evidence_text, lower(content_fingerprint) from holdout_cases) group by 1, 2",
    "run_queue": f"select run_id, regexp_extract(run_id, '^([a-z]+)-([0-9]{{8}})-([0-9]+)$', 1) as kind, regexp_extract(run_id, '^([a-z]+)-([0-9]{{8}})-([0-9]+)$', 2) as day, try_cast(regexp_extract(run_id, '^([a-z]+)-([0-9]{{8}})-([0-9]+)$', 3) as bigint) as number, count(*) as attempts, case when bool_and({_CLASS} in ('error', 'blocked')) then 'failed' when bool_or(outcome is null) then 'open' else 'done' end as state from {_A} where run_id is not null group by run_id",
    "frontier": f"select {_HOST.format('url')} as host, round(avg(({_CLASS} = 'ok')::int) * ln(count(*) + 1.0), 4) as score, count(*) as attempts from {_A} where url is not null group by 1 order by score desc, host limit 50",
    "seeded_jobs": f"with t as (select url, max(attempted_at) as tried_at from {_A} where url is not null group by 1) select concat_ws(':', 'fetch', e.id, version_no) as key, e.url from evidence e left join t using (url) where e.id not in (select evidence_id from evidence_text) and (tried_at is null or tried_at <= fetched_at)",
    "source_quality": f"select doc_id, round(0.30::double * least(1.0::double, {_hits(_KEYWORDS)} / 6.0::double) + 0.15::double * least(1.0::double, {_hits(_KEYWORDS[:5])} / 5.0::double) + 0.075::double, 4) as score, least(1.0::double, {_hits(_KEYWORDS)} / 6.0::double) >= 0.30 as detected from documents",
    "age_spans": f"select url, case when a is null then 'never' when a < 0 then 'in ' || {_span('(-a)')} else {_span('a')} || ' ago' end as age, strftime(attempted_at + interval 7 day, '%-d %b %Y') as follow_up from (select url, attempted_at, 1717200000 - floor(epoch_us(attempted_at) / 1000000)::bigint as a from {_LAST})",
    "independent_support": """with recursive w as (select publisher_id, publisher_id as root, 0 as depth from publishers union all select w.publisher_id, p.parent_publisher, w.depth + 1 from w join publishers p on p.publisher_id = w.root where w.depth < 5 and p.parent_publisher in (select publisher_id from publishers)),
o as (select canonical_name as attribution, min(root) as root from (select * from w qualify row_number() over (partition by publisher_id order by depth desc) = 1) join publishers using (publisher_id) group by 1),
e as (select id, title, content_hash, root from evidence left join o using (attribution) where title is not null),
l as (select a.id as a, b.id as b from e a join e b on a.title = b.title and (a.content_hash = b.content_hash or a.root = b.root)),
r as (select id as a, id as b from e union select r.a, l.b from r join l on l.a = r.b),
c as (select a as id, min(b) as component from r group by 1)
select title, count(*) as rows, count(distinct component) as independent, coalesce(array_to_string(list_sort(list(distinct root) filter (root is not null)), ','), '') as owners from e join c using (id) group by 1 having count(*) > 1""",
}
