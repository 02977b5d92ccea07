"""Records in texts and around them: located units with spans, bindings, claims, labels, keys and summaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.versions import deliveries
from tessera.sources.tables import load, spread


def identity(name: str | None) -> str | None:
    """A name as it is compared across scripts and spellings: NFKC, case folded, other signs as blanks."""
    return None if name is None else " ".join(re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", name).casefold()).split())


def bind_units(text: str | None, units: list[str] | None) -> list[tuple[int, int, str]]:
    """(start, end, how) of each unit in the text, in code points; (-1, -1, 'missing') where it isn't.

    A unit takes the first place after the unit before it that no other has taken: an exact one if there is any, else one
    that is equal but for blanks, if that names one wording only ('ambiguous' otherwise). Empty units are missing.
    """
    out, at = [], 0
    for unit in units or []:
        found = (text or "").find(unit, at) if unit and unit.strip() else -1
        if found >= 0:
            out.append((found, found + len(unit), "exact"))
            at = found + len(unit)
            continue
        words = unit.split() if unit else []
        places = [m for m in re.finditer(r"\s+".join(map(re.escape, words)), text or "") if m.start() >= at] if words else []
        if places and len({m[0] for m in places}) == 1:
            out.append((places[0].start(), places[0].end(), "folded"))
            at = places[0].end()
        else:
            out.append((-1, -1, "ambiguous" if places else "missing"))
    return out


def bound(rows: DataFrame) -> DataFrame:
    """(id, n, start, end, how) of `rows` (id BIGINT, text STRING, units ARRAY<STRING>); n counts units from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(i, n, *b) for i, t, us in zip(p["id"], p["text"], p["units"]) for n, b in enumerate(bind_units(t, None if us is None else list(us)))], columns=["id", "n", "start", "end", "how"])

    return rows.select("id", "text", "units").mapInPandas(run, "id long, n int, start int, end int, how string")


def retry_after(value: str, now: str) -> F.Column:
    """Seconds to wait by a Retry-After header (column `value`) at the instant `now` (column): a whole number, or an HTTP
    date; null for anything else and for dates that have passed."""
    text = F.trim(F.col(value))
    # a pattern with the weekday's name isn't supported, so it goes
    date = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]+, *", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    wait = F.unix_seconds(date) - F.unix_seconds(F.col(now))
    return F.coalesce(F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("long")), F.when(wait > 0, wait))


def manifest_drift(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """(name, drift) of files that were changed, removed or added between two manifests (name, sha256)."""
    o, n = frozen.select("name", F.col("sha256").alias("old")), current.select("name", F.col("sha256").alias("new"))
    drift = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed")
    return o.join(n, "name", "full").select("name", drift.alias("drift")).filter("drift is not null")


def forest_faults(edges: DataFrame, child: str, parent: str, deepest: int = 4) -> DataFrame:
    """(child, fault): unknown_parent, too_deep (more than `deepest` steps to the top) or cycle, where there is one."""
    up = edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p"))
    at = edges.select(child, F.col(parent).alias("_at"), F.lit(False).alias("_loop"))
    unknown = edges.join(up.select(F.col("_c").alias(parent)), parent, "left_anti").filter(F.col(parent).isNotNull()).select(child, F.lit("unknown_parent").alias("fault"))
    for _ in range(deepest):
        at = at.join(up, at["_at"] == up["_c"], "left").select(child, F.col("_p").alias("_at"), (F.col("_loop") | F.coalesce(F.col("_at") == F.col(child), F.lit(False))).alias("_loop"))
    far = at.select(child, F.when(F.col("_loop"), "cycle").when(F.col("_at").isNotNull(), "too_deep").alias("fault")).filter("fault is not null")
    return unknown.union(far)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "evidence_text", "evidence_id", "text").filter("text is not null")
    lines = t.select("evidence_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("evidence_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


_HEADS = {"ingredients": ("Ingredients", "Zutaten", "Ingredientes", "Ingrédients"), "steps": ("Method", "Zubereitung", "Preparación", "Préparation")}


def heading_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under a recipe heading as units with half-open spans in the text."""
    rows = _lines(spark, sf_dir).withColumn("bare", F.regexp_replace("line", "\r$", ""))
    head = F.when(F.col("bare").isin(*_HEADS["ingredients"]), "ingredients").when(F.col("bare").isin(*_HEADS["steps"]), "steps")
    role = F.last("head", ignorenulls=True).over(Window.partitionBy("evidence_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("head", head).withColumn("role", role).filter("head is null and role is not null and bare <> ''")
    return rows.select("evidence_id", "role", "start", (F.col("start") + F.length("bare")).alias("end"))


def verified_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the title of each page stands in its text at the span found for it in its excerpt, which may be out of date."""
    e, t = load(spark, sf_dir, "evidence", "id", "title", "excerpt"), load(spark, sf_dir, "evidence_text", "evidence_id", "text")
    rows = e.filter("title <> ''").withColumn("start", F.instr(F.regexp_replace("excerpt", r"\r", ""), F.col("title")) - 1).filter("start >= 0").join(t, e["id"] == t["evidence_id"])
    return rows.select("id", F.col("start").cast("long").alias("start"), F.coalesce(F.substring("text", F.col("start") + 1, F.length("title")) == F.col("title"), F.lit(False)).alias("verified"))


def bound_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and headings bound in order to the page texts, by how they were found."""
    e, t = load(spark, sf_dir, "evidence", "id", "title"), load(spark, sf_dir, "evidence_text", "evidence_id", "text")
    rows = spread(e.join(t, e["id"] == t["evidence_id"]).select("id", "text", F.array(F.coalesce("title", F.lit("")), F.lit("Ingredients"), F.lit("Method")).alias("units")))
    return bound(rows).groupBy("n", "how").agg(F.count("*").alias("units"))


def surrounding_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each text that name a cookie in any letter case, with their numbers from 1."""
    rows = _lines(spark, sf_dir).filter(F.contains(F.lower("line"), F.lit("cookie")))
    return rows.select("evidence_id", (F.col("n") + 1).cast("long").alias("number"), F.regexp_replace("line", "\r$", "").alias("line"))


# What a text claims about offers, by wordings; a buy guide is no offer.
_CLAIMS = {
    "discount": r"\b(\d+\s?% off|on sale|discount(ed)?|deal of the day|promo code|coupon)\b",
    "price": r"[$€£]\s?\d|\b\d+([.,]\d+)?\s?(usd|dollars|eur|gbp)\b",
    "purchase": r"\b(buy|purchase|add to cart)\b|\border (the|a|an|it|now|today|online|from|yours)\b|(?:^|[.!?]\s+)order\b|\bshop (for|the|now|at|it)\b",
    "stock": r"\b(in|out of|back in|low) stock\b|\b(sold out|available (now|today)|ships (today|tomorrow)|limited (stock|quantity))\b",
}
_OFFERS = ("Buy it today, 20% off!", "A buy guide.", "It costs 12.50 eur. Order now", "Sold out, ships tomorrow", "No offer here", "$ 5")


def claim_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of commercial claims in page texts, and in some sentences (with negative ids), sorted, where there are any."""
    t = load(spark, sf_dir, "evidence_text", "evidence_id", "text").union(spark.createDataFrame([(-n, x) for n, x in enumerate(_OFFERS, 1)], "evidence_id long, text string"))
    t = t.withColumn("l", F.regexp_replace(F.lower("text"), r"\bbuy\s+guide", "guide"))
    return t.select("evidence_id", F.concat_ws(",", *(F.when(F.col("l").rlike(p), k) for k, p in _CLAIMS.items())).alias("kinds")).filter("kinds <> ''")


def proper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised words within the titles of documents that their texts don't hold."""
    d = load(spark, sf_dir, "documents", "doc_id", "title", "text").filter("title is not null and text is not null")
    runs = d.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[a-z] ([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), 1))).alias("name"))
    return runs.filter(~F.contains("text", F.col("name"))).select("doc_id", "name")


def response_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by the first rule that their response meets: status, wall, robots."""
    a = deliveries(spark, sf_dir, "id", "http_status", "robots_status", "reason")
    kind = (
        F.when(F.col("robots_status") == "disallowed", "robots").when(F.col("http_status").isin(401, 403), "blocked").when(F.col("reason").contains("login wall") | F.col("reason").contains("paywall"), "wall")
        .when(F.col("http_status") == 404, "missing").when(F.col("http_status") >= 400, "error").when(F.col("http_status").isNull(), "none").otherwise("ok")
    )
    return a.groupBy(kind.alias("kind")).agg(F.count("*").alias("attempts"))


_SEARCHED = ("hearthlane.example", "hearthletters.example")


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two hosts whose title or topic holds a word in any letter case: the first 100 by folded title, with their places."""
    d = load(spark, sf_dir, "documents", "doc_id", "title", "topic", "source").filter(F.col("source").isin(*_SEARCHED))
    hits = d.filter(F.contains(F.lower(F.concat_ws(" ", "title", "topic")), F.lit("a"))).select("doc_id", F.lower("title").alias("title"), "source")
    top = hits.orderBy(F.asc_nulls_last("title"), "doc_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("title"), "doc_id")).cast("long"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of each url's final url: only an address not seen before makes a new one."""
    e = load(spark, sf_dir, "evidence", "id", "url", "final_url", "fetched_at").filter("final_url is not null")
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("url", "final_url").orderBy("fetched_at", "id"))).filter("k = 1")
    return first.select("url", "id", F.row_number().over(Window.partitionBy("url").orderBy("fetched_at", "id")).cast("long").alias("revision"))


def order_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's events keep rising in value, by a fold over them in order: how many do, none falling back."""
    e = load(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0).cast("long").alias("n"))
    step = lambda s, r: F.when(r["value"] > s["top"], F.struct(r["value"].alias("top"), (s["n"] + 1).alias("n"))).otherwise(s)
    return e.select("user_id", F.aggregate("x", start, step)["n"].alias("records"), F.size("x").cast("long").alias("events"))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's name for readers: its attribution before a semicolon without a trailing bracket, else the host without www."""
    e = load(spark, sf_dir, "evidence", "attribution", "url")
    short = F.trim(F.regexp_replace(F.regexp_extract("attribution", "^([^;]*)", 1), r" *\([^()]*\)$", ""))
    named = F.coalesce(F.nullif(short, F.lit("")), F.regexp_replace(F.regexp_extract("url", "^[^:]+://([^/]+)", 1), "^www[.]", ""))
    return e.groupBy(named.alias("name")).agg(F.count("*").alias("rows"))


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles escaped for HTML and for a Markdown table."""
    d = load(spark, sf_dir, "documents", "doc_id", "title").filter("title is not null")
    web = F.replace(F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return d.select("doc_id", web.alias("html"), F.replace("title", F.lit("|"), F.lit("\\|")).alias("markdown"))


def minute_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minutes that documents name, all of them, as labels like 1 hr 20 min, counted."""
    m = load(spark, sf_dir, "documents", "text").select(F.explode(F.regexp_extract_all("text", F.lit("([0-9]{1,4}) minutes"), 1)).alias("m")).select(F.col("m").cast("long").alias("m"))
    hours, rest = F.expr("m div 60"), F.col("m") % 60
    label = F.when(hours == 0, F.concat(rest.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(hours.cast("string"), F.lit(" hr"))).otherwise(F.concat(hours.cast("string"), F.lit(" hr "), rest.cast("string"), F.lit(" min")))
    return m.groupBy(label.alias("label")).agg(F.count("*").alias("mentions"))


def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before 2025-01-01 each document was fetched, in words, counted."""
    age = F.lit(1735689600) - F.unix_seconds("fetched_at")
    label = F.when(age.isNull(), "unknown").when(age < 0, "later").when(age < 3600, "minutes").when(age < 86400, "hours").when(age < 86400 * 30, "days").otherwise("months")
    return load(spark, sf_dir, "documents", "fetched_at").groupBy(label.alias("label")).agg(F.count("*").alias("documents"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of attempts that were delivered more than once: accepted if the rows agree, refused if they differ."""
    a = load(spark, sf_dir, "fetch_attempts")
    forms = a.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in a.columns))).alias("forms")).filter("n > 1")
    return forms.groupBy(F.when(F.col("forms") == 1, "accepted").otherwise("refused").alias("verdict")).agg(F.count("*").alias("ids"))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: counts, and the newest 25 evidence ids as a JSON array."""
    e = load(spark, sf_dir, "evidence", "id", "fetched_at")
    newest = e.orderBy(F.desc("fetched_at"), F.desc("id")).limit(25).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros("fetched_at")).alias("t"), (-F.col("id")).alias("i")))), lambda x: -x["i"])).alias("newest"))
    counts = load(spark, sf_dir, "fetch_attempts", "id").agg(F.countDistinct("id").alias("attempts"))
    return e.agg(F.count("*").alias("evidence")).select("evidence", counts.scalar().alias("attempts"), newest.scalar().alias("newest"))


def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct document titles by identity key: how many spellings each has."""
    titles = load(spark, sf_dir, "documents", "title").filter("title is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"key": p["title"].map(identity)})

    return titles.mapInPandas(run, "key string").groupBy("key").agg(F.count("*").alias("spellings"))


def private_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final urls, and some urls of special hosts, by the kind of host: none, local, a private or public address, public."""
    urls = load(spark, sf_dir, "evidence", "final_url").union(spark.createDataFrame([(u,) for u in _SPECIAL], "final_url string"))
    return urls.groupBy(host_kind("final_url").alias("kind")).agg(F.count("*").alias("rows"))


_SPECIAL = ("http://localhost:80/", "http://printer.local/", "http://0.0.0.0/", "http://10.1.2.3/x", "http://100.64.9.9/", "http://172.20.0.1/", "http://198.18.0.1/", "http://240.1.1.1/", "http://8.8.8.8/", "http://[::1]/", "http://[fe80::1]/a",
            "http://[fd00::2]:81/", "http://[2606:4700::1]/", "http://user@192.168.0.9/", "mailto:nobody", "")
#: Addresses that no public host has: private, loopback, link-local, shared, for tests and documents, and reserved ones.
_PRIVATE_4 = "^(0|10|127|192[.]168|192[.]0[.](0|2)|169[.]254|172[.](1[6-9]|2[0-9]|3[01])|100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])|198[.](1[89]|51[.]100)|203[.]0[.]113|2[2-5][0-9])[.]"
_PRIVATE_6 = r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*|::ffff:.*)\]$"
_HOST_OR_ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]+)"


def host_kind(column: str) -> F.Column:
    """none, local, private_address, address or public: what kind of host a url (column) names."""
    h = F.lower(F.regexp_extract(column, _HOST_OR_ADDRESS, 1))
    local = (h == "localhost") | h.rlike("[.](local|internal|localhost)$")
    return F.when(F.col(column).isNull() | (h == ""), "none").when(local, "local").when(h.rlike(_PRIVATE_4) | h.rlike(_PRIVATE_6), "private_address").when(h.rlike("^[0-9.]+$") | h.startswith("["), "address").otherwise("public")


QUERIES = {
    f.__name__: f
    for f in (heading_units, verified_spans, bound_sentences, surrounding_line, claim_kinds, proper_names, response_classes, search, revisions, order_guard, display_names, escaped, minute_labels, age_labels, intents,
              dashboard, identity_keys, private_hosts)
}

_LINES = "l as (select evidence_id, n, line, coalesce(sum(length(line) + 1) over (partition by evidence_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select evidence_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from evidence_text where text is not null))"
_A = "(select distinct on (id) * from fetch_attempts)"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
KIND_SQL = f"case when h is null or h = '' then 'none' when h = 'localhost' or regexp_matches(h, '[.](local|internal|localhost)$') then 'local' when regexp_matches(h, '{_PRIVATE_4}') or regexp_matches(h, '{_PRIVATE_6}') then 'private_address' when regexp_matches(h, '^[0-9.]+$') or h like '[%' then 'address' else 'public' end"
SQL = {
    "heading_units": f"with {_LINES}, b as (select *, rtrim(line, chr(13)) as bare from l), h as (select *, case when bare in {_in(_HEADS['ingredients'])} then 'ingredients' when bare in {_in(_HEADS['steps'])} then 'steps' end as head from b), r as (select *, last_value(head ignore nulls) over (partition by evidence_id order by n rows unbounded preceding) as role from h) select evidence_id, role, start, start + length(bare) as end from r where head is null and role is not null and bare <> ''",
    "verified_spans": "select id, s - 1 as start, coalesce(substring(text, s, length(title)) = title, false) as verified from (select id, title, instr(replace(excerpt, chr(13), ''), title) as s from evidence where title <> '') join evidence_text on id = evidence_id where s > 0",
    "surrounding_line": f"with {_LINES} select evidence_id, n as number, regexp_replace(line, '\\r$', '') as line from l where contains(lower(line), 'cookie')",
    "claim_kinds": "select evidence_id, concat_ws(',', " + ", ".join(f"case when regexp_matches(t, '{p}') then '{k}' end" for k, p in _CLAIMS.items()) + ") as kinds from (select evidence_id, regexp_replace(lower(text), '\\bbuy\\s+guide', 'guide', 'g') as t from (select evidence_id, text from evidence_text union all select -generate_subscripts(x, 1), unnest(x) from (select [" + ", ".join(f"'{x}'" for x in _OFFERS) + "] as x))) where kinds <> ''",
    "proper_names": "select doc_id, name from (select doc_id, text, unnest(list_distinct(regexp_extract_all(title, '[a-z] ([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1))) as name from documents where title is not null and text is not null) where not contains(text, name)",
    "response_classes": f"select case when robots_status = 'disallowed' then 'robots' when http_status in (401, 403) then 'blocked' when contains(reason, 'login wall') or contains(reason, 'paywall') then 'wall' when http_status = 404 then 'missing' when http_status >= 400 then 'error' when http_status is null then 'none' else 'ok' end as kind, count(*) as attempts from {_A} group by 1",
    "search": f"select doc_id, lower(title) as title, source, row_number() over (order by lower(title) nulls last, doc_id) as place from documents where source in {_in(_SEARCHED)} and contains(lower(concat_ws(' ', title, topic)), 'a') order by place limit 100",
    "revisions": "with f as (select * from evidence where final_url is not null qualify row_number() over (partition by url, final_url order by fetched_at, id) = 1) select url, id, row_number() over (partition by url order by fetched_at, id) as revision from f",
    "order_guard": "with r as (select user_id, value, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as top from events) select user_id, count(*) filter (value > coalesce(top, '-infinity'::double)) as records, count(*) as events from r group by 1",
    "display_names": r"select coalesce(nullif(trim(regexp_replace(regexp_extract(attribution, '^([^;]*)', 1), ' *\([^()]*\)$', '')), ''), regexp_replace(regexp_extract(url, '^[^:]+://([^/]+)', 1), '^www[.]', '')) as name, count(*) as rows from evidence group by 1",
    "escaped": "select doc_id, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as html, replace(title, '|', '\\|') as markdown from documents where title is not null",
    "minute_labels": "select case when m // 60 = 0 then m || ' min' when m % 60 = 0 then (m // 60) || ' hr' else (m // 60) || ' hr ' || (m % 60) || ' min' end as label, count(*) as mentions from (select unnest(regexp_extract_all(text, '([0-9]{1,4}) minutes', 1))::bigint as m from documents) group by 1",
    "age_labels": "select case when a is null then 'unknown' when a < 0 then 'later' when a < 3600 then 'minutes' when a < 86400 then 'hours' when a < 86400 * 30 then 'days' else 'months' end as label, count(*) as documents from (select 1735689600 - floor(epoch_us(fetched_at) / 1000000) as a from documents) group by 1",
    "intents": "with f as (select id, count(*) as n, count(distinct to_json(fetch_attempts)::varchar) as forms from fetch_attempts group by id) select case when forms = 1 then 'accepted' else 'refused' end as verdict, count(*) as ids from f where n > 1 group by 1",
    "dashboard": "select (select count(*) from evidence) as evidence, (select count(distinct id) from fetch_attempts) as attempts, (select '[' || string_agg(id, ',' order by fetched_at desc, id desc) || ']' from (select id, fetched_at from evidence order by fetched_at desc, id desc limit 25)) as newest",
    "private_hosts": f"with h as (select final_url, lower(regexp_extract(final_url, '{_HOST_OR_ADDRESS}', 1)) as h from (select final_url from evidence union all select unnest([{', '.join(repr(u) for u in _SPECIAL)}]))) select {KIND_SQL} as kind, count(*) as rows from h group by 1",
}
