import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.boilerplate import boilerplate, site_lines
from tessera.llm.near_duplicates import all_pairs, near_duplicates
from tessera.llm.packing import packed
from tessera.llm.reading_level import reading_levels
from tessera.llm.residue import NONE, label, residue, similarity, simhashes, unit
from tessera.llm.shingles import distinct_shingles, jaccard
from tessera.llm.split_overlap import overlaps
from tessera.llm.tokens import FLAGS, RANKS, Encoder, recurring, token_counts, token_ids

WORDS = [a + b for a in "plum leek salt jar towel clean wipe shelf kettle broth".split() for b in "ab cd ef gh ij kl mn op qr st".split()]


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1, 2])] = ["new" + str(rng.randrange(10**6))]
    return " ".join(w)


def family(rng, n, length):
    base = [" ".join(rng.choice(WORDS) for _ in range(length)) for _ in range(n // 4)]
    return base + [edited(rng, rng.choice(base), rng.choice([0, 1, 2, 4, 6, 9])) for _ in range(n - len(base))]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    texts = [*family(rng, 160, 90), None, "", "short text", "x " * 100, "x " * 100, "y" * 200_000]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, a string")
    links, members = near_duplicates(rows)
    got = {tuple(r) for r in all_pairs(links, members).collect()}
    sets = {i: distinct_shingles(t, 3) for i, t in enumerate(texts) if t and len(t.split()) >= 60}
    true = {(i, j): s for i in sets for j in sets if i < j and (s := jaccard(sets[i], sets[j])) >= 0.6}
    assert got <= set(true)
    assert len(got) >= 0.99 * len(true) and all(p in got for p, s in true.items() if s >= 0.7)
    empty = near_duplicates(rows.limit(0))
    assert all_pairs(*empty).count() == 0 and empty[1].count() == 0


def test_overlaps_against_brute_force(spark):
    rng = random.Random(2)
    left = [*family(rng, 80, 90), None, "", "two words", "one two three", "a b c d e f"]
    right = [*(edited(rng, t, rng.choice([0, 1, 3, 6])) for t in left[:80]), *family(rng, 20, 40), "One, two THREE!", "a b c d e f", "a b c d e f", None]
    of = lambda xs, p: spark.createDataFrame([(f"{p}{i}", t, 1) for i, t in enumerate(xs)], "id string, text string, a int")
    links, members = overlaps(of(left, "l"), of(right, "r"))
    rep = {(r["side"], r["id"]): r["rep"] for r in members.collect()}
    linked = {(r["a"], r["b"]) for r in links.collect()}
    got = {(a, b) for (s, a), x in rep.items() if not s for (t, b), y in rep.items() if t and (x, y) in linked}
    sets = lambda xs, p: {f"{p}{i}": distinct_shingles(t, 3) for i, t in enumerate(xs) if t}
    a, b = sets(left, "l"), sets(right, "r")
    assert got == {(i, j) for i in a for j in b if jaccard(a[i], b[j]) >= 0.6}
    assert all(0 < r["coverage_a"] <= 1 for r in links.collect())
    assert overlaps(of(left, "l").limit(0), of(right, "r"))[0].count() == 0


def test_overlaps_of_short_and_repeated_texts_against_brute_force(spark):
    rng = random.Random(8)
    left = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (*range(3, 101), *([15] * 150))]
    right = [edited(rng, t, rng.choice([1, 1, 2, 3])) for t in left]
    right += [" ".join(w for n, w in enumerate(t.split()) if n != len(t.split()) // 2) for t in left]
    # the distinct shingles of a repeated text are as few as those of the text that is repeated
    left += [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (20, 45, 59)]
    right += [" ".join([t] * 4) for t in left[-3:]] + ["x " * 100, "salt and jar " * 60]
    left += ["x " * 3, "salt and jar " * 2]
    of = lambda xs, p: spark.createDataFrame([(f"{p}{i}", t) for i, t in enumerate(xs)], "id string, text string")
    links, members = overlaps(of(left, "l"), of(right, "r"))
    rep = {(r["side"], r["id"]): r["rep"] for r in members.collect()}
    linked = {(r["a"], r["b"]) for r in links.collect()}
    a, b = ([distinct_shingles(t, 3) for t in xs] for xs in (left, right))
    true = {(rep[False, f"l{i}"], rep[True, f"r{j}"]) for i, s in enumerate(a) for j, t in enumerate(b) if jaccard(s, t) >= 0.6}
    assert len(true) > 200 and linked == true


def test_token_ids_of_nulls_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello <|endoftext|>", "x"), (3, "Hello <|endoftext|>", "x")], "doc_id long, text string, ids string")
    out = sorted(map(tuple, token_ids(rows).collect()))
    assert out[0] == (1, []) and out[1] == (2, []) and out[2] == out[3] and len(out[2][1]) > 5 and 50256 not in out[2][1]
    assert sorted(r["tokens"] for r in token_counts(rows).collect()) == [0, 0, len(out[2][1]), len(out[2][1])]
    assert token_ids(rows.limit(0)).count() == 0


def test_token_ids_of_shared_passages(spark):
    encode, rng = Encoder(RANKS).encode, random.Random(9)
    passages = [" ".join(rng.choice(WORDS) for _ in range(120)) for _ in range(5)] + ["漢字かな交じり文、" * 60]
    texts = [rng.choice("AB ") + rng.choice(passages) + rng.choice(["", "!", " 12x"]) + rng.choice(passages)[rng.randrange(50) :] for _ in range(60)] + ["", None, passages[0]]
    rows = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["ids"]) for r in token_ids(rows).collect())
    assert got == sorted((i if i % 7 and i else -1, encode(t) if t else []) for i, t in enumerate(texts))
    assert recurring(rows.select("text")).count(0) < FLAGS // 8 and recurring(rows.limit(1).select("text")).count(0) == FLAGS // 8


def test_packed_keeps_every_token(spark):
    rng = random.Random(3)
    sizes = [None, 0, 5000, 2048, 2049, *([700] * 300), *(rng.randrange(1, 900) for _ in range(300))]
    rows = spark.createDataFrame([(i // 2, s, 9) for i, s in enumerate(sizes)], "id long, size int, container int")
    out = packed(rows).collect()
    full = {}
    for r in out:
        if r["container"] is not None:
            full[r["container"]] = full.get(r["container"], 0) + r["size"]
    assert max(full.values()) <= 2048 and sum(full.values()) == sum(s or 0 for s in sizes)
    assert sorted(r["size"] for r in out if r["container"] is None) == [0, 0]
    assert min(full) == 0 and max(full) == len(full) - 1 and len(full) <= -(-sum(full.values()) // 2048) + 35
    assert packed(rows.limit(0)).count() == 0


def test_residue_spreads_to_near_duplicates_only(spark):
    longs = ["We have moved the whole list " + " ".join(WORDS[:n]) + " because the link is out of date" for n in range(50, 90)]
    nears = [x.replace("the link is", "the links is") for x in longs]
    apart = [bin(int(a) ^ int(b)).count("1") for a, b in (simhashes([unit(x), unit(y)]) for x, y in zip(longs, nears))]
    long, near = longs[int(np.argmin(apart))], nears[int(np.argmin(apart))]
    assert min(apart) <= 3 and label(near) == NONE and similarity(unit(long), unit(near)) >= 0.8
    rows = [
        ("e", 1, "A title\nPlease enable JavaScript to view this page."),
        ("e", 2, "Please enable JavaScript in order to view this page."),
        ("e", 3, long),
        ("e", 4, near),
        ("e", 5, "A real sentence about scripts."),
        ("e", 6, None), ("e", 7, ""), ("e", 8, "z" * 100_000), ("f", 1, "{{ outcome }}"), ("f", 1, "{{ outcome }}"),
    ]
    got = {tuple(r) for r in residue(spark.createDataFrame([(*r, 0) for r in rows], "kind string, id long, text string, unit int")).collect()}
    assert {("e", 1), ("e", 3), ("e", 4), ("f", 1)} <= got and not {("e", 5), ("e", 6), ("e", 7), ("e", 8)} & got
    assert residue(spark.createDataFrame([], "kind string, id long, text string")).count() == 0


def test_reading_levels(spark):
    rng = random.Random(4)
    easy = lambda: " ".join(f"The {rng.choice('cat dog bun'.split())} has a {rng.choice('red big wet'.split())} hat." for _ in range(20))
    hard = lambda: " ".join(f"Notwithstanding {rng.choice(['methodological', 'interfacial'])} heterogeneity, comparative investigations corroborate considerable {rng.choice(['asymmetrical', 'enzymatic'])} correspondence." for _ in range(8))
    docs = [(i, easy() if i % 2 else hard(), f"s{i % 5}", 0.5) for i in range(120)] + [(500, None, "s", 0.5), (501, "", None, 0.5), (502, "🙂 ?!", "s", 0.5), (1, easy(), "s1", 0.5)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string, reading_level double")
    labels = spark.createDataFrame([(i, "r", 1 if i % 2 else 5) for i in range(80)] + [(3, "q", None), (5, "r", 1), (9999, "r", 3)], "doc_id long, rater string, reader_level int")
    out = {r["doc_id"]: r["reading_level"] for r in reading_levels(rows, labels).collect()}
    assert out[500] is None and out[501] is None and out[502] is None
    assert all(out[i] < 2 for i in range(81, 120, 2)) and all(out[i] > 4 for i in range(80, 120, 2))
    assert reading_levels(rows, labels.limit(0)).filter("reading_level is not null").count() == 0
    assert reading_levels(rows.limit(0), labels).count() == 0


def test_boilerplate_and_site_lines(spark):
    notice = "Readers keep this site going: a small share of each order may come back, as noted in part"
    pages = [(i, f"Page {i} title words\nThis is an article about {WORDS[i]} and it says something new here.\n{notice} {i}", "s", f"Page {i} title words", 0) for i in range(8)]
    pages += [(100 + i, "Copy title\nThis very long article line is stored again and again as a copy.", "s", "Copy title", 0) for i in range(20)] + [(200, None, "s", None, 0), (201, "", None, None, 0)]
    rows = spark.createDataFrame(pages, "id long, text string, site string, title string, line_no int")
    recurring = site_lines(rows, rows)
    assert {tuple(r) for r in recurring.collect()} == {(i, 3) for i in range(8)}
    marked = rows.join(recurring.groupBy("id").agg(F.collect_set("line_no").alias("recurring")), "id", "left")
    assert {tuple(r) for r in boilerplate(marked).collect()} == {(i, 3) for i in range(8)}
    assert boilerplate(marked.limit(0)).count() == 0 and site_lines(rows.limit(0), rows).count() == 0


def test_pairs_links_and_classes_agree(spark):
    from tessera.llm.near_duplicates import QUERIES as P3
    from tessera.llm.split_overlap import QUERIES as P5

    at = "/root/testdata/sf0.001"
    run = lambda qs, name: qs[name](spark, at)
    pairs = run(P3, "p3_found").count()
    sizes = run(P3, "p3_classes").groupBy("class_id").count().collect()
    within = sum(r["count"] * (r["count"] - 1) // 2 for r in sizes)
    assert pairs == within + (run(P3, "p3_links").agg(F.sum("pairs")).first()[0] or 0)
    alike = run(P5, "p5_links").agg(F.sum("pairs")).first()[0]
    report = run(P5, "p5_report").agg(F.sum("pairs")).first()[0]
    found = run(P5, "p5_found")
    assert found.count() == found.distinct().count() == report >= alike > 0
    linked = run(P5, "p5_classes").filter("links > 0 and split = 'holdout'").select("name")
    assert linked.join(found.select(F.col("case_id").alias("name")), "name", "left_anti").count() == 0
