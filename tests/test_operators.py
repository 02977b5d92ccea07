import random

from tessera.operators.merges import insert_or_ignore, upsert
from tessera.operators.relations import ancestry, components, reserved_top, roots
from tessera.operators.reports import all_failing, classify, first_failing
from tessera.operators.texts import folded, rejoined, sentence_key, sentences
from tessera.operators.versions import first_contents, latest, numbered
from pyspark.sql import functions as F


def test_versions_ignore_known_contents(spark):
    rows = spark.createDataFrame([(1, "u", "a", 1), (2, "u", "b", 2), (3, "u", "a", 3), (4, None, "a", 4), (5, "u", None, 5)], "id long, url string, hash string, at int")
    out = numbered(first_contents(rows, "url", "hash", ["at", "id"]), "url", ["at", "id"]).orderBy("id").collect()
    assert [(r["id"], r["version"], r["supersedes"]) for r in out] == [(1, 1, None), (2, 2, 1)]
    assert latest(rows.filter("url = 'u'"), "url", ["at", "id"]).first()["id"] == 5
    assert numbered(first_contents(rows.limit(0), "url", "hash", ["at", "id"]), "url", ["at", "id"]).count() == 0


def test_upsert_rules(spark):
    old = spark.createDataFrame([("k", 1, 5, 2, [1]), ("only", 1, 1, 1, None)], "key string, a int, b int, c int, d array<int>")
    new = spark.createDataFrame([("k", None, 3, 7, []), ("new", 9, 9, 9, [9])], "key string, a int, b int, c int, d array<int>")
    out = {r["key"]: tuple(r)[1:] for r in upsert(old, new, ["key"], {"a": "coalesce", "b": "greatest", "c": "add", "d": "nonempty"}).collect()}
    assert out == {"k": (1, 5, 9, [1]), "only": (1, 1, 1, None), "new": (9, 9, 9, [9])}
    assert upsert(old, old, ["key"], {"a": "overwrite"}).count() == 2


def test_replay_inserts_nothing(spark):
    stored = spark.createDataFrame([("u", "a", 1)], "url string, hash string, id int")
    incoming = spark.createDataFrame([("u", "a", 2), ("u", "b", 3), ("u", "b", 4)], "url string, hash string, id int")
    once = insert_or_ignore(stored, incoming, ["url", "hash"])
    assert once.count() == 2
    assert insert_or_ignore(once, incoming, ["url", "hash"]).count() == 2


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(None, 3), (5, 5)] + [(200, x) for x in range(201, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    expected = {x: min(y for y in parent if find(y) == find(x)) for x in parent}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots_end_at_unknown_parents_and_cycles(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "zz"), ("x", "y"), ("y", "x")], "id string, parent string")
    out = {r["id"]: (r["root"], r["depth"]) for r in roots(edges, "id", "parent").collect()}
    assert out["c"] == ("a", 2) and out["d"] == ("d", 0) and out["a"] == ("a", 0) and out["x"][1] == 5


def test_ancestry_of_long_chains_and_cycles(spark):
    links = [(i, i - 1) for i in range(1, 46)] + [(100, 45), (0, None), (200, 201), (201, 202), (202, 200), (203, 200), (300, 300)]
    of, expected = dict(links), set()
    for start in of:
        at, depth, met = of[start], 1, set()
        while at is not None and at not in met:
            met.add(at)
            expected.add((start, at, depth))
            at, depth = of.get(at), depth + 1
    rows = spark.createDataFrame(links, "id long, ancestor long")
    got = [tuple(r) for r in ancestry(rows).collect()]
    assert len(got) == len(expected) and set(got) == expected and max(d for *_, d in got) == 46
    assert ancestry(rows.limit(0)).count() == 0


def test_reserved_top(spark):
    rows = spark.createDataFrame([(i, i < 8) for i in range(12)], "id int, seen boolean")
    out = [r["id"] for r in reserved_top(rows, 6, [F.asc("id")], ~F.col("seen")).collect()]
    assert sorted(out) == [0, 1, 2, 3, 8, 9]
    assert reserved_top(rows.limit(0), 6, [F.asc("id")], ~F.col("seen")).count() == 0


def test_gates(spark):
    rows = spark.createDataFrame([(None, 1), ("x", 0), ("x", 1)], "a string, b int")
    gates = [("no_a", F.col("a").isNull()), ("no_b", F.col("b") == 0)]
    out = rows.select(first_failing(gates), all_failing(gates), classify(gates, "fine")).collect()
    assert [tuple(r) for r in out] == [("no_a", ["no_a"], "no_a"), ("no_b", ["no_b"], "no_b"), (None, [], "fine")]


def test_texts(spark):
    row = spark.createDataFrame([(" a \t b\r\n\n\n c ", "One. Two!\nThree", "a line\nbroken here.\nNext", "It’s  SO.")], "a string, b string, c string, d string")
    got = row.select(folded("a"), sentences("b"), rejoined("c"), sentence_key(F.col("d"))).first()
    assert tuple(got) == ("a b\nc", ["One.", "Two!", "Three"], "a line broken here.\nNext", "it's so")
    empty = spark.createDataFrame([(None,), ("",)], "a string").select(folded("a").alias("f"), sentences("a").alias("s")).collect()
    assert [tuple(r) for r in empty] == [(None, None), ("", [])]
