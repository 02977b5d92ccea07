"""Pages as they are fetched: what is extracted from their HTML, their links, and the records in them.

The store keeps texts, not pages, so the queries mark texts up as pages first; extraction sees nothing but the HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.html import decoded, extract_page, site_links
from tessera.functions.recipes import bindings, located
from tessera.operators.grammar import text_sql
from tessera.operators.texts import _INJECTION_SQL, injections
from tessera.sources.tables import load, spread


def _escaped(c: Column | str, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    e, t = load(spark, sf_dir, "evidence", "id", "title", *columns), load(spark, sf_dir, "evidence_text", "evidence_id", "text")
    return e.join(t, e["id"] == t["evidence_id"]).filter("text is not null").drop("evidence_id")


def _page(head: Column, title: Column, body: Column) -> Column:
    return F.concat(F.lit("<html><head><title>"), _escaped(F.coalesce(title, F.lit(""))), F.lit("</title>"), head, F.lit("</head><body><nav>menu</nav>"), body, F.lit("<aside>more</aside></body></html>"))


def _paragraphs() -> Column:
    return F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))), "")


def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is extracted from each page: title, dates and where they stand (metadata in order of precedence, else JSON-LD), digest of the text, flags, excerpt's length."""
    meta = lambda name, c: F.concat(F.lit(f'<meta name="{name}" content="'), _escaped(F.coalesce(c, F.lit("")), True), F.lit('">'))
    day, changed = F.col("published_at"), F.col("modified_at")
    blob = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.array(F.struct(day.alias("datePublished"), changed.alias("dateModified"))).alias("@graph"))), F.lit("</script>"))
    form = F.pmod("id", F.lit(4))
    head = F.when(form == 0, F.concat(meta("article:published_time", day), meta("dateModified", changed))).when(form == 1, F.concat(meta("pubdate", day), meta("date", F.concat(day, F.lit("x"))), meta("datemodified", changed))).when(form == 2, blob).otherwise(F.lit(""))
    rows = spread(_texts(spark, sf_dir, "published_at", "modified_at").select("id", _page(head, F.col("title"), _paragraphs()).alias("html")))
    p = rows.select("id", extract_page("html").alias("p")).select("id", "p.*")
    return p.select("id", "title", "published_at", "basis", "modified_at", F.sha2("text", 256).alias("digest"), injections("text").alias("flags"), F.length(F.left("text", F.lit(1200))).cast("long").alias("excerpt"))


def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New links of each page that stay on its site, under its folder and off login pages, without query, fragment, repeats and itself, in order."""
    links = F.array(F.concat(F.lit("page-"), F.col("n"), F.lit("#top")), F.lit("?q=1"), F.lit("login/x"), F.lit("https://else.example/a"), F.concat(F.lit("page-"), F.col("n")), F.lit("sub/deep.html?x=1"), F.lit("../up"), F.lit("mailto:a"), F.lit("http://["))
    urls = load(spark, sf_dir, "evidence", "id", "url").filter("url is not null").groupBy("url").agg(F.min("id").cast("string").alias("n"))
    body = F.array_join(F.transform(links, lambda x: F.concat(F.lit('<a href="'), x, F.lit('">x</a>'))), " ")
    found = spread(urls.select("url", body.alias("html"))).select("url", extract_page("html")["links"].alias("links")).select("url", F.posexplode(site_links("url", "links")).alias("n", "link"))
    return found.select("url", F.col("n").cast("long").alias("n"), "link")


def _recipe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, text, html) of pages with a list of ingredients and steps: as JSON-LD, as microdata, or by their headings alone."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", "")))
    rows = _texts(spark, sf_dir).select("id", "title", "text", lines.alias("l")).withColumns({"i": F.array_position("l", F.lit("Ingredients")), "m": F.array_position("l", F.lit("Method"))}).filter("i > 0 and m > i + 1 and m < size(l)")
    filled = lambda xs: F.filter(xs, lambda x: x != "")
    rows = rows.withColumns({"things": filled(F.expr("slice(l, int(i + 1), int(m - i - 1))")), "steps": filled(F.expr("slice(l, int(m + 1), int(size(l) - m))"))})
    blob = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Recipe").alias("@type"), F.col("title").alias("name"), F.col("things").alias("recipeIngredient"), F.transform("steps", lambda x: F.struct(x.alias("text"))).alias("recipeInstructions"), F.lit("PT20M").alias("prepTime"))), F.lit("</script>"))
    item = lambda xs, name: F.array_join(F.transform(xs, lambda x: F.concat(F.lit(f'<span itemprop="{name}">'), _escaped(x), F.lit("</span>"))), "")
    form = F.pmod("id", F.lit(3))
    return spread(rows.select("id", "title", "text", _page(F.when(form == 0, blob).otherwise(F.lit("")), F.col("title"), F.concat(F.when(form == 1, F.concat(item("things", "recipeIngredient"), item("steps", "recipeInstructions"))).otherwise(F.lit("")), _paragraphs())).alias("html")))


def record_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the records located in recipe pages: tier, kind, span, how the structured reading corresponds to the text."""
    r = _recipe_pages(spark, sf_dir).select("id", "text", F.explode(located("html", "text", "title")).alias("r")).select("id", "text", "r.tier", "r.slot", F.explode("r.units").alias("u"))
    literal = F.when(F.col("u.start") >= 0, F.substring("text", F.col("u.start") + 1, F.col("u.end") - F.col("u.start")))
    return r.select("id", "tier", "slot", "u.kind", "u.start", "u.end", "u.how", literal.alias("literal"))


def record_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe pages by completeness of their first record as it binds to its own text, and by the reasons that stand against it."""
    b = _recipe_pages(spark, sf_dir).select(bindings("html", "text", "title").alias("b")).select("b.*")
    return b.groupBy(F.coalesce("completeness", F.lit("none")).alias("completeness"), F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons")).agg(F.count("*").alias("pages"))


def name_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of each host as slots: a key of the folded name, numbered from the second page of one name on."""
    e = load(spark, sf_dir, "evidence", "id", "url", "title").filter("title is not null")
    site = F.lower(F.regexp_extract("url", "^[^:]+://([^/?#:]+)", 1))
    key = F.concat(F.lit("name:"), F.substring(F.sha2(F.lower(F.trim(F.regexp_replace("title", "[ \t\r\n]+", " "))), 256), 1, 16))
    rows = e.select("id", site.alias("site"), key.alias("key")).withColumn("n", F.row_number().over(Window.partitionBy("site", "key").orderBy("id")))
    return rows.select("id", F.when(F.col("n") > 1, F.concat("key", F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("key")).alias("slot"))


def anchored_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's title stands in its text as a whole line, blanks at the ends apart."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", "")))
    return _texts(spark, sf_dir).filter("title is not null").select("id", F.array_contains(lines, F.trim("title")).alias("anchored"))


def decoded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of documents, escaped and decoded again, in folded letter case: how many there are of each length."""
    d = spread(load(spark, sf_dir, "documents", "title").filter("title is not null"))
    return d.select(decoded(_escaped("title", True)).alias("t")).groupBy(F.length("t").cast("long").alias("chars")).agg(F.count("*").alias("titles"), F.min(F.lower("t")).alias("first"))


#: Responses as status, content type and body, for the rules that need a body.
_BODIES = ((200, "text/html", "<p>fine <b>words</b></p>"), (403, "text/html", "x"), (404, "", "x"), (500, "text/html", ""), (200, "text/html", '<form><input TYPE="password"></form>'), (200, "text/html", "Subscribe to continue reading this"), (200, "image/png", "x"), (200, "", "plain"), (200, "application/xhtml+html", "To continue reading " + "word " * 500))


def body_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal responses by the first rule they meet (denied, missing, error, login wall, paywall, content type; else ok), with their words outside of tags."""
    r = spark.createDataFrame([(n, *b) for n, b in enumerate(_BODIES)], "id long, status int, kind string, body string").withColumn("low", F.lower("body"))
    text = F.trim(F.regexp_replace(F.regexp_replace("body", "<[^>]+>", " "), "\\s+", " "))
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("long")
    short, wall = words < 400, F.contains("low", F.lit('type="password"'))
    paid = F.col("low").rlike("subscribe to continue|subscription required|to continue reading")
    rule = F.when(F.col("status").isin(401, 403), "denied").when(F.col("status") == 404, "missing").when(F.col("status") >= 400, "error").when(wall & short, "login_wall").when(paid & short, "paywall").when((F.col("kind") != "") & ~F.col("kind").rlike("html|text"), "content_type").otherwise("ok")
    return r.select("id", rule.alias("rule"), words.alias("words"))


QUERIES = {f.__name__: f for f in (page_extraction, link_discovery, record_units, record_bindings, name_slots, anchored_titles, decoded_titles, body_classes)}
_WHITE = r"[ \t\r\n\f\x0B\x{00A0}]+"
_BODY = rf"array_to_string(list_filter(list_transform(list_prepend(coalesce(title, ''), string_split(text, chr(10))), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B\x{{00A0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
_RESPONSES = ", ".join(f"({n}, {s}, {text_sql(k)}, {text_sql(b)})" for n, (s, k, b) in enumerate(_BODIES))
SQL = {
    "anchored_titles": "select id, list_contains(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\r$', ''), ' ')), trim(title, ' ')) as anchored from evidence join evidence_text on id = evidence_id where title is not null and text is not null",
    "decoded_titles": "select length(title) as chars, count(*) as titles, min(lower(title)) as first from documents where title is not null group by 1",
    "body_classes": rf"""with r as (select *, lower(body) as low, trim(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as t from (values {_RESPONSES}) v(id, status, kind, body)), w as (select *, case when t = '' then 0 else len(string_split(t, ' ')) end as words from r) select id, case when status in (401, 403) then 'denied' when status = 404 then 'missing' when status >= 400 then 'error' when contains(low, 'type="password"') and words < 400 then 'login_wall' when regexp_matches(low, 'subscribe to continue|subscription required|to continue reading') and words < 400 then 'paywall' when kind <> '' and not regexp_matches(kind, 'html|text') then 'content_type' else 'ok' end as rule, words from w""",
    "page_extraction": f"with p as (select id, nullif(trim(regexp_replace(title, '{_WHITE}', ' ', 'g')), '') as title, id % 4 as f, nullif(published_at, '') as d, nullif(modified_at, '') as m, {_BODY} as text from evidence join evidence_text on id = evidence_id where text is not null) select id, title, case f when 1 then d || 'x' when 3 then null else d end as published_at, case when d is null or f = 3 then 'unknown' when f = 0 then 'meta:article:published_time' when f = 1 then 'meta:date' else 'jsonld:datePublished' end as basis, case when f <> 3 then m end as modified_at, sha256(text) as digest, {_INJECTION_SQL} as flags, length(left(text, 1200)) as excerpt from p",
    "link_discovery": "select url, n, case n when 0 then d || 'page-' || i else d || 'sub/deep.html' end as link from (select url, min(id)::varchar as i, lower(regexp_extract(url, '^([^:]+://[^/]+)', 1)) || regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*/)', 1) as d from evidence where url is not null group by url), (values (0), (1)) v(n)",
    "name_slots": r"select id, case when n > 1 then k || '#' || n else k end as slot from (select id, k, row_number() over (partition by s, k order by id) as n from (select id, lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) as s, 'name:' || substring(sha256(lower(trim(regexp_replace(title, '[ \t\r\n]+', ' ', 'g')))), 1, 16) as k from evidence where title is not null))",
}
