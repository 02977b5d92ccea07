"""JSON payloads: books of seeds exploded, one shape for several versions, and documents held against a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.html import block, canonical, nested
from tessera.operators.grammar import literals, text_sql
from tessera.sources.tables import load, spread

_BOOK = '{"clusters": {"meals": {"accounts": ["@plum", "@leek"]}, "cleaning": {"accounts": []}, "plans": {"accounts": ["@list"]}}, "queries": {"meals": ["plum jam", "leek pie"], "plans": ["week plan"]}}'
_PAYLOADS = (
    '{"schema": "v2", "creators": [{"handle": "plum"}, {"handle": "leek"}]}', '{"schema": "v2", "competitors": [{"name": "Shelf"}]}', '{"schema": "v1", "items": [{"handle": "z"}, {"name": "y"}]}', '{"schema": "v2", "creators": []}', '{"x": 1}', "{broken", "",
)


def book_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts and queries of a book of seeds, one row each, with their cluster and place; the first 50 of a kind."""
    shape = "clusters map<string, struct<accounts: array<string>>>, queries map<string, array<string>>"
    book = spark.createDataFrame([(_BOOK,)], "book string").select(F.from_json("book", shape).alias("b"))
    accounts = book.select(F.explode("b.clusters").alias("cluster", "c")).select("cluster", F.lit("account").alias("kind"), F.posexplode("c.accounts").alias("place", "value"))
    queries = book.select(F.explode("b.queries").alias("cluster", "q")).select("cluster", F.lit("query").alias("kind"), F.posexplode("q").alias("place", "value"))
    top = lambda rows: rows.orderBy("cluster", "place").limit(50)
    return top(accounts).union(top(queries)).select("cluster", "kind", F.col("place").cast("long").alias("place"), "value")


def adapted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of the second version in the shape of the first (creators or competitors as items), others as they are; broken ones have no items."""
    p = spark.createDataFrame(list(enumerate(_PAYLOADS)), "id long, body string").withColumn("v", F.try_parse_json("body"))
    items = lambda key: F.try_variant_get("v", f"$.{key}", "array<struct<handle: string, name: string>>")
    schema = F.try_variant_get("v", "$.schema", "string")
    one = F.when(schema == "v2", F.coalesce(items("creators"), items("competitors"))).otherwise(items("items"))
    return p.select("id", F.when(schema == "v2", "v1").otherwise(schema).alias("schema"), F.array_join(F.transform(one, lambda x: F.coalesce(x["handle"], x["name"])), ",").alias("items"))


_ALLOWED = ("name", "completeness", "conflicts", "provenance", "schema_version", "unknown_fields")


def schema_errors(column: str) -> Column:
    """All errors of a JSON document (column) against the schema of cases, in order: not_json or not_object alone, else missing
    keys, unknown keys, a name that is no text or empty, lists that are none."""
    v, keys = F.try_parse_json(column), F.json_object_keys(column)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    listed = lambda xs, error: F.transform(xs, lambda k: F.concat(F.lit(f"{error}:"), k))
    required = F.array(*(F.lit(k) for k in _ALLOWED[:3]))
    has = lambda k: F.array_contains(keys, k)
    checks = F.array(
        F.when(has("name") & ((kind("$.name") != "STRING") | (F.try_variant_get(v, "$.name", "string") == "")), "name:minLength"),
        *(F.when(has(k) & ~kind(f"$.{k}").startswith("ARRAY"), f"{k}:type") for k in ("conflicts", "unknown_fields")),
    )
    every = F.concat(listed(F.array_except(required, keys), "missing"), listed(F.array_sort(F.array_except(keys, F.array(*(F.lit(k) for k in _ALLOWED)))), "unknown"), F.filter(checks, lambda x: x.isNotNull()))
    return F.when(v.isNull(), F.array(F.lit("not_json"))).when(keys.isNull(), F.array(F.lit("not_object"))).otherwise(every)


_DOCUMENTS = ('{"name": "", "completeness": "x", "conflicts": {}}', '{"name": 5, "b": 1, "a": 2}', "[1]", "7", "{", '{"name": "n", "completeness": null, "conflicts": [], "unknown_fields": "x"}')


def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of cases, and some that break every rule, by their errors."""
    d = load(spark, sf_dir, "holdout_cases", "document").union(spark.createDataFrame([(x,) for x in _DOCUMENTS], "document string")).filter("document is not null")
    return d.groupBy(F.array_join(schema_errors("document"), ",").alias("errors")).agg(F.count("*").alias("documents"))


def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first content hash at any depth of each case's document and of nested literal ones, in order of the document; null where there is none."""
    rows = load(spark, sf_dir, "holdout_cases", "case_id", "document").union(spark.createDataFrame([(f"literal {n}", x) for n, x in enumerate(_NESTED)], "case_id string, document string"))
    return spread(rows).select("case_id", nested("document", F.lit("content_hash")).alias("content_hash"))


_NESTED = ('{"a": [{"b": 1}, {"c": {"content_hash": "deep"}}], "content_hash": "top"}', '[[{"content_hash": 5}, {"content_hash": "second"}]]', '{"content_hash": null}', "{", "7")
_NOISY = ('note ```json\n{"a": 1}\n``` end', "no block", 'x {"s": "}{"} y', "[1, [2]] tail", '{"open": 1', "{not json} [3]", "")


def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON object or array in literal noisy texts; null where none parses."""
    return literals(spark, _NOISY).select("id", block("text").alias("block"))


def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of the canonical form of each case's document; null where it doesn't parse."""
    rows = spread(load(spark, sf_dir, "holdout_cases", "case_id", "document"))
    return rows.select("case_id", F.sha2(canonical("document"), 256).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (book_seeds, adapted_payloads, schema_validation, nested_values, json_blocks, canonical_documents)}
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
SQL = {
    "nested_values": f"select case_id, case when case_id = 'literal 0' then 'top' when case_id = 'literal 1' then 'second' else try_cast(document as json)->>'$.provenance.content_hash' end as content_hash from (select case_id, document from holdout_cases union all select unnest([{', '.join(repr(f'literal {n}') for n in range(len(_NESTED)))}]), unnest([{', '.join(map(text_sql, _NESTED))}]))",
    "json_blocks": """select * from (values (-1, '{"a": 1}'), (-2, null), (-3, '{"s": "}{"}'), (-4, '[1, [2]]'), (-5, null), (-6, '[3]'), (-7, null)) v(id, block)""",
    "canonical_documents": "select case_id, sha256(try_cast(document as json)::json::varchar) as fingerprint from (select case_id, case when try_cast(document as json) is not null then json(document)::varchar end as document from holdout_cases)",
    "book_seeds": f"with b as (select '{_BOOK}'::json as b), c as (select unnest(json_keys(b->'$.clusters')) as cluster, b from b), q as (select unnest(json_keys(b->'$.queries')) as cluster, b from b), a as (select cluster, 'account' as kind, from_json(b->'$.clusters'->cluster->'$.accounts', '[\"varchar\"]') as l from c union all select cluster, 'query', from_json(b->'$.queries'->cluster, '[\"varchar\"]') from q) select cluster, kind, generate_subscripts(l, 1) - 1 as place, unnest(l) as value from a",
    "adapted_payloads": f"with p as (select unnest({_list(_PAYLOADS)}) as body, generate_subscripts({_list(_PAYLOADS)}, 1) - 1 as id), v as (select id, case when body = '' then null else try_cast(body as json) end as v from p), i as (select id, v->>'$.schema' as s, case when v->>'$.schema' = 'v2' then coalesce(v->'$.creators', v->'$.competitors') else v->'$.items' end as i from v) select id, case when s = 'v2' then 'v1' else s end as schema, case when i is not null then coalesce(array_to_string(list_transform(from_json(i, '[\"json\"]'), lambda x: coalesce(x->>'$.handle', x->>'$.name')), ','), '') end as items from i",
    "schema_validation": f"with d as (select document from holdout_cases where document is not null union all select unnest({_list(_DOCUMENTS)})), v as (select try_cast(document as json) as v from d), k as (select v, case when json_type(v) = 'OBJECT' then json_keys(v) end as k from v), e as (select case when v is null then ['not_json'] when k is null then ['not_object'] else list_concat(list_transform(list_filter({_list(_ALLOWED[:3])}, lambda x: not list_contains(k, x)), lambda x: 'missing:' || x), list_transform(list_sort(list_filter(k, lambda x: not list_contains({_list(_ALLOWED)}, x))), lambda x: 'unknown:' || x), list_filter([case when list_contains(k, 'name') and (json_type(v->'$.name') <> 'VARCHAR' or v->>'$.name' = '') then 'name:minLength' end, case when list_contains(k, 'conflicts') and json_type(v->'$.conflicts') <> 'ARRAY' then 'conflicts:type' end, case when list_contains(k, 'unknown_fields') and json_type(v->'$.unknown_fields') <> 'ARRAY' then 'unknown_fields:type' end], lambda x: x is not null)) end as e from k) select array_to_string(e, ',') as errors, count(*) as documents from e group by 1",
}
