"""The same or almost the same text in two splits, by an exact prefix filter and chains of winnowed fingerprints.

Two texts with a likeness of t or more share at least ceil(t x n) of the n distinct shingles of either. So if the shingles
of all texts are put in one order, the first n - ceil(t x n) + 1 of both texts have one in common; these are a text's
seeds. The order puts shingles first that only one split holds, then those that make few pairs (counted exactly), so a
phrase that many texts hold is joined only where a text has little else. Common seeds are joined across the splits unless the numbers of shingles, or of those behind the seed, already rule the likeness out, or the maps of BITMAP bits do:
each bit that only one of two maps has stands for a shingle that only one text holds. Thus no pair is missed, whatever the
length of the texts. What is left is verified: the likeness is computed exactly, the fingerprints of both
texts (the least hashes of each WINDOW consecutive shingles) are chained where they are collinear, extended over equal
words to both sides, and the coverage of both texts is measured. Texts with equal words form a class, of which one member
is compared.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shingles import batch_shingles, jaccard, mix, shingle_hashes, signed, word_hashes, words
from tessera.sources.tables import load, persisted, spread

WINDOW = 4
#: Bits of the map of a text's shingles by which pairs are ruled out within the join.
BITMAP = 256


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least values of each window, ascending; of ties the last. Shorter texts are one window."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    window = min(window, len(hashes))
    rows = np.lib.stride_tricks.sliding_window_view(mix(hashes), window)
    return np.unique(window - 1 - rows[:, ::-1].argmin(axis=1) + np.arange(len(rows)))


def chain(a: np.ndarray, b: np.ndarray, k: int) -> tuple[float, float]:
    """Coverage of two texts (their word hashes) by the collinear chain of their common fingerprints, extended over equal words."""
    h = [mix(sum((x[i : len(x) - k + 1 + i] * np.uint64(2 * i + 0x9E3779B97F4A7C15) for i in range(k)), np.uint64(0))) if len(x) >= k else x[:0] for x in (a, b)]
    at = [winnowed(x) for x in h]
    where: dict[int, list[int]] = {}
    for j in at[1].tolist():
        where.setdefault(int(h[1][j]), []).append(j)
    # longest increasing chain: candidates in order of a, and of falling b within one position of a
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    points = [(i, j) for i in at[0].tolist() for j in reversed(where.get(int(h[0][i]), ()))]
    for n, (_, j) in enumerate(points):
        p = bisect_left(tails, j)
        back.append(ends[p - 1] if p else -1)
        tails[p : p + 1], ends[p : p + 1] = [j], [n]
    n = ends[-1] if ends else -1
    best = []
    while n >= 0:
        best.append(points[n])
        n = back[n]
    covered = [np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)]
    to_a = to_b = 0
    for i, j in reversed(best):
        if i < to_a or j < to_b:
            continue
        e = k
        while i + e < len(a) and j + e < len(b) and a[i + e] == b[j + e]:
            e += 1
        s = 0
        while i - s > to_a and j - s > to_b and a[i - s - 1] == b[j - s - 1]:
            s += 1
        covered[0][i - s : i + e] = covered[1][j - s : j + e] = True
        to_a, to_b = i + e, j + e
    return tuple(float(c.mean()) if len(c) else 0.0 for c in covered)


def _shingled(texts: DataFrame, k: int) -> DataFrame:
    """(id, side, hi, lo, text, n, bits, shingles) of (id STRING, side BOOLEAN, text STRING) rows with at least k words.

    hi and lo are the 128 bits of the class of equal word sequences, shingles the n distinct ones, and bits the BITMAP
    bits that they fall on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 1000):
                part = whole.iloc[start : start + 1000]
                rows = [(i, s, t, ts) for i, s, t in zip(part["id"], part["side"], part["text"]) if t and len(ts := words(t)) >= k]
                values, offsets = batch_shingles([ts for *_, ts in rows], k)
                digests = [xxhash.xxh3_128_intdigest(" ".join(ts)) for *_, ts in rows]
                sets = [np.unique(values[s:e]) for s, e in zip(offsets[:-1], offsets[1:])]
                bits = np.zeros((len(rows), BITMAP), dtype=bool)
                for row, s in zip(bits, sets):
                    row[s & np.uint64(BITMAP - 1)] = True
                yield pd.DataFrame({
                    "id": [i for i, *_ in rows],
                    "side": [s for _, s, *_ in rows],
                    "hi": signed(np.array([d >> 64 for d in digests], dtype=np.uint64)),
                    "lo": signed(np.array([d & (2**64 - 1) for d in digests], dtype=np.uint64)),
                    "text": [t for _, _, t, _ in rows],
                    "n": np.array(list(map(len, sets)), dtype=np.int32),
                    "bits": list(np.packbits(bits, axis=1).view(np.int64)),
                    "shingles": list(map(signed, sets)),
                })

    return texts.mapInPandas(run, "id string, side boolean, hi long, lo long, text string, n int, bits array<long>, shingles array<long>")


def overlaps(left: DataFrame, right: DataFrame, k: int = 3, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal word sequences of two tables (id STRING, text STRING), and the classes.

    Returns (a, b, likeness, coverage_a, coverage_b), a and b being the least ids of a class of `left` and of `right`, and
    (id, side, rep) of all rows that take part (side is true for `right`). Null texts and texts of under k words take no
    part. Ids that repeat count once a class; further columns are ignored; empty tables give empty results.
    """
    texts = left.select("id", F.lit(False).alias("side"), "text").union(right.select("id", F.lit(True).alias("side"), "text")).filter("text is not null")
    base = persisted(_shingled(spread(texts), k))
    first = base.groupBy("side", "hi", "lo").agg(F.min("id").alias("id"))
    members = base.select("id", "side", "hi", "lo").distinct().join(first.withColumnRenamed("id", "rep"), ["side", "hi", "lo"]).select("id", "side", "rep")
    # one row a class: a repeated row of the least id would count its shingles twice, so its copies are dropped
    reps = persisted(base.join(first, ["side", "hi", "lo", "id"], "left_semi").dropDuplicates(["side", "hi", "lo"]))
    each = reps.select("side", "hi", "lo", "n", F.explode("shingles").alias("seed"))
    # shingles that only one split holds come first in the order and join nothing; the others go by the pairs they make
    often = each.groupBy("seed").agg(F.count_if("side").alias("r"), F.count("*").alias("all")).filter("r > 0 and r < all").select("seed", (F.col("r") * (F.col("all") - F.col("r"))).alias("makes"))
    of_text = Window.partitionBy("lo", "hi", "side")  # what differs most first: sorting compares it by itself
    ranked = each.join(often, "seed").withColumn("behind", F.count("*").over(of_text) - F.row_number().over(of_text.orderBy("makes", "seed")))
    # a margin of 1e-9 keeps rounding from cutting a shingle off
    kept = ranked.filter(F.col("behind") >= F.ceil(threshold * F.col("n") - 1e-9) - 1).select("side", "hi", "lo", F.col("behind").cast("int").alias("behind"), "seed")
    seeds = persisted(kept.join(reps.select("side", "hi", "lo", "n", *(F.col("bits")[i].alias(f"bits{i}") for i in range(BITMAP // 64))), ["side", "hi", "lo"]))
    of = lambda side, name: seeds.filter(F.col("side") == side).select("seed", *(F.col(c).alias(f"{c}_{name}") for c in seeds.columns if c not in ("side", "seed")))
    n = F.col("n_a") + F.col("n_b")
    enough = F.least("behind_a", "behind_b") + 1 >= F.ceil(threshold / (1 + threshold) * n - 1e-9)
    apart = sum((F.bit_count(F.col(f"bits{i}_a").bitwiseXOR(F.col(f"bits{i}_b"))) for i in range(BITMAP // 64)), F.lit(0))
    met = of(False, "a").join(of(True, "b"), "seed").filter(enough & (apart <= (1 - threshold) / (1 + threshold) * n + 1e-9))
    pairs = met.select("hi_a", "lo_a", "hi_b", "lo_b").distinct()
    side = lambda side, name: reps.filter(F.col("side") == side).select(F.col("hi").alias(f"hi_{name}"), F.col("lo").alias(f"lo_{name}"), F.col("id").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side(False, "a"), ["hi_a", "lo_a"]).join(side(True, "b"), ["hi_b", "lo_b"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            of = {t: words(t) for t in {*p["text_a"], *p["text_b"]}}
            sets = {t: np.unique(shingle_hashes(ts, k)) for t, ts in of.items()}
            out = []
            for a, b, x, y in zip(p["a"], p["b"], p["text_a"], p["text_b"]):
                if (j := jaccard(sets[x], sets[y])) >= threshold - 1e-12:
                    out.append((a, b, j, *chain(word_hashes(of[x]), word_hashes(of[y]), k)))
            yield pd.DataFrame(out, columns=["a", "b", "likeness", "coverage_a", "coverage_b"])

    return both.select("a", "b", "text_a", "text_b").mapInPandas(verify, "a string, b string, likeness double, coverage_a double, coverage_b double"), members


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    holdout = load(spark, sf_dir, "holdout_cases").select(F.col("case_id").alias("id"), F.col("evidence_text").alias("text"))
    return holdout, load(spark, sf_dir, "dev_cases").select(F.col("name").alias("id"), "text")


def _printed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(case_id, print) of holdout cases with a fingerprint, (dev_name, print) of dev cases with a text."""
    cases = load(spark, sf_dir, "holdout_cases", "case_id", "content_fingerprint").select("case_id", F.lower("content_fingerprint").alias("print")).filter("print is not null")
    return cases, load(spark, sf_dir, "dev_cases", "name", "text").filter("text <> ''").select(F.col("name").alias("dev_name"), F.sha2("text", 256).alias("print"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, dev_name): holdout cases whose text or fingerprint occurs in a dev case, exactly or almost.

    Rows are fixed as pairs of cases, so the links of classes are expanded to their members; p5_report counts without it.
    """
    links, members = overlaps(*_tables(spark, sf_dir))
    of = lambda side, name, rep: members.filter(F.col("side") == side).select(F.col("id").alias(name), F.col("rep").alias(rep))
    alike = links.join(of(False, "case_id", "a"), "a").join(of(True, "dev_name", "b"), "b").select("case_id", "dev_name")
    cases, dev = _printed(spark, sf_dir)
    return alike.union(cases.join(dev, "print").select("case_id", "dev_name")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split (spelling normalised) and source of the cases: cases, overlapping cases, pairs, mean coverage of the best match.

    Pairs are counted by the sizes of classes, never expanded. Coverage is null where only fingerprints match.
    """
    links, members = overlaps(*_tables(spark, sf_dir))
    links, members = persisted(links), members.distinct()
    case_class = members.filter("not side").select(F.col("id").alias("case_id"), F.col("rep").alias("a"))
    dev_class = members.filter("side").select(F.col("id").alias("dev_name"), F.col("rep").alias("b"))
    sizes = dev_class.groupBy("b").agg(F.count("*").alias("pairs"))
    alike = case_class.join(links.join(sizes, "b").groupBy("a").agg(F.sum("pairs").alias("pairs"), F.max("coverage_a").alias("coverage")), "a").select("case_id", "pairs", "coverage")
    cases, dev = _printed(spark, sf_dir)
    # dev cases with one fingerprint have one text, so they are of one class, or of none if the text is too short
    printed = cases.distinct().join(dev.join(dev_class, "dev_name", "left").groupBy("print").agg(F.countDistinct("dev_name").alias("pairs"), F.min("b").alias("b")), "print")
    only = printed.join(case_class, "case_id", "left").join(links.select("a", "b", F.lit(True).alias("linked")), ["a", "b"], "left").filter("linked is null")
    best = alike.union(only.select("case_id", "pairs", F.lit(None).cast("double"))).groupBy("case_id").agg(F.sum("pairs").alias("pairs"), F.max("coverage").alias("coverage"))
    of = load(spark, sf_dir, "holdout_cases").select("case_id", F.lower(F.regexp_replace(F.coalesce("split", F.lit("")), r"[^\p{L}\p{N}]+", "")).alias("split"), "source")
    return of.join(best, "case_id", "left").groupBy("split", "source").agg(
        F.count("*").alias("cases"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("coverage"), 4).alias("mean_coverage")
    )


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal word sequences of both splits (their least case and dev name): likeness, coverage of
    both texts, and the pairs of cases that a link stands for."""
    links, members = overlaps(*_tables(spark, sf_dir))
    sizes = members.distinct().groupBy("side", "rep").agg(F.count("*").alias("size"))
    side = lambda side, rep: sizes.filter(F.col("side") == side).select(F.col("rep").alias(rep), F.col("size").alias(f"size_{rep}"))
    both = links.join(side(False, "a"), "a").join(side(True, "b"), "b")
    rounded = (F.round(c, 4).alias(name) for c, name in (("likeness", "likeness"), ("coverage_a", "coverage_case"), ("coverage_b", "coverage_dev")))
    return both.select(F.col("a").alias("case_class"), F.col("b").alias("dev_class"), *rounded, (F.col("size_a") * F.col("size_b")).alias("pairs"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a case of either split that takes part: its class, and the number of classes of the other split that it is linked to."""
    links, members = overlaps(*_tables(spark, sf_dir))
    links = persisted(links)
    degree = links.groupBy(F.lit(False).alias("side"), F.col("a").alias("rep")).agg(F.count("*").alias("links")).union(links.groupBy(F.lit(True), "b").agg(F.count("*")))
    rows = members.distinct().join(degree, ["side", "rep"], "left")
    return rows.select(F.when(F.col("side"), "dev").otherwise("holdout").alias("split"), F.col("id").alias("name"), F.col("rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_links": p5_links, "p5_classes": p5_classes}
SQL: dict[str, str] = {}
