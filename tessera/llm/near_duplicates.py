"""Near-duplicate records by SetSketch registers.

A record's sketch holds, for each of REGISTERS hash functions, the exponentially spaced and truncated minimum of an
exponential variate over its distinct shingles: floor(1 - log_b(min)), clipped to 0..255. The register-wise maximum of
two sketches is the sketch of the union, so sketches can be built in parts and merged. Equal registers are as likely as
the likeness (slightly more, by the width of a step), so bands of registers serve as an index: records that agree in a
band become a candidate. The likeness of a candidate is then estimated jointly with the two cardinalities by maximum
likelihood over the counts of larger, smaller and equal registers; candidates whose estimate lies within MARGIN of the
threshold or above are verified on their texts, exactly.

Records whose word sequences are equal form a class first; only one record a class is sketched further, compared and
verified, so a group of copies costs no more than one record.

With 5 registers a band and 60 bands a pair at the threshold of 0.6 is missed with probability 0.008, at 0.65 with
0.0006; random pairs of the test corpora have a likeness under 0.2 and meet in a band with probability under 0.02.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shingles import batch_shingles, distinct_shingles, jaccard, mix, signed, words
from tessera.sources.tables import load, persisted, spread

REGISTERS = 192
BASE = 1.08
RATE = 20.0
BANDS, ROWS = 60, 5
KEY_BITS = 44
MARGIN = 0.15

_RNG = np.random.default_rng(20240607)
_SEEDS = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Registers of each band: whole passes over shuffled registers, so that each is used about equally often.
_BANDS = np.concatenate([_RNG.permutation(REGISTERS)[: REGISTERS // ROWS * ROWS] for _ in range(-(-BANDS * ROWS // REGISTERS) + 1)])[: BANDS * ROWS].reshape(BANDS, ROWS)
_BAND_MULTIPLIERS = _RNG.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint8, one row a text) of texts that each have at least one shingle."""
    out = np.empty((len(offsets) - 1, REGISTERS), dtype=np.uint8)
    starts = offsets[:-1]
    for j in range(REGISTERS):
        h = ((values ^ _SEEDS[j]) * _MULTIPLIERS[j]) >> np.uint64(32)
        least = np.minimum.reduceat(h.astype(np.uint32), starts)
        # -log(1-u)/RATE is exponential for uniform u and grows with it, so the least hash has the least variate
        x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
        out[:, j] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets of two sketches."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS keys of each sketch, the band's number being part of the key.

    Keys have KEY_BITS bits: fewer bytes to shuffle, and chance collisions stay rare beside real candidates.
    """
    picked = sketch[:, _BANDS].astype(np.uint64) + np.uint64(1)
    keys = (picked * _BAND_MULTIPLIERS[None]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    return signed(mix(keys) >> np.uint64(64 - KEY_BITS))


_GRID = np.linspace(0.0, 1.0, 101)


def joint_likeness(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood estimates of the likeness of pairs of sketches (rows) with known set sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = _GRID[None] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p_more, p_less = p(u - v * j), p(v - u * j)
    p_same = np.clip(1 - p_more - p_less, 1e-12, 1)
    fit = more * np.log(np.clip(p_more, 1e-12, 1)) + less * np.log(np.clip(p_less, 1e-12, 1)) + same * np.log(p_same)
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketches(records: DataFrame, k: int = 3, min_words: int = 60) -> DataFrame:
    """(id, hi, lo, n, sketch) of `records` (id BIGINT, text STRING); null, shorter and shingleless texts have no row.

    hi and lo are the 128 bits of the class of texts with equal word sequences, n the number of distinct shingles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                part = whole.iloc[at : at + 1000]
                rows = [(i, ts) for i, t in zip(part["id"], part["text"]) if t and len(ts := words(t)) >= max(k, min_words)]
                if not rows:
                    continue
                values, offsets = batch_shingles([ts for _, ts in rows], k)
                digests = [xxhash.xxh3_128_intdigest(" ".join(ts)) for _, ts in rows]
                yield pd.DataFrame({
                    "id": [i for i, _ in rows],
                    "hi": signed(np.array([d >> 64 for d in digests], dtype=np.uint64)),
                    "lo": signed(np.array([d & (2**64 - 1) for d in digests], dtype=np.uint64)),
                    "n": [len(np.unique(values[s:e])) for s, e in zip(offsets[:-1], offsets[1:])],
                    "sketch": [r.tobytes() for r in registers(values, offsets)],
                })

    return records.mapInPandas(run, "id long, hi long, lo long, n int, sketch binary")


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        if len(part):
            keys = band_keys(np.frombuffer(b"".join(part["sketch"]), dtype=np.uint8).reshape(len(part), REGISTERS))
            yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), BANDS), "key": keys.ravel()})


def candidates(representatives: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, that share a band and whose estimated likeness is at least threshold - MARGIN."""
    keys = representatives.select("id", "sketch").mapInPandas(_keys, "id long, key long")
    pairs = keys.alias("x").join(keys.alias("y"), F.expr("x.key = y.key and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    side = lambda s: representatives.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                as_rows = lambda c: np.frombuffer(b"".join(p[c]), dtype=np.uint8).reshape(len(p), REGISTERS)  # noqa: B023, E731
                j = joint_likeness(as_rows("sketch_a"), as_rows("sketch_b"), p["n_a"].to_numpy(float), p["n_b"].to_numpy(float))
                yield p.loc[j >= threshold - MARGIN, ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(estimate, "a long, b long")


def verified(pairs: DataFrame, records: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose exact likeness reaches the threshold."""
    texts = records.filter("text is not null")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            of = {t: distinct_shingles(t, k) for t in {*p["text_a"], *p["text_b"]}}
            j = np.array([jaccard(of[x], of[y]) for x, y in zip(p["text_a"], p["text_b"])], dtype=float)
            keep = j >= threshold - 1e-12
            yield pd.DataFrame({"a": p["a"][keep], "b": p["b"][keep], "likeness": j[keep]})

    return both.mapInPandas(check, "a long, b long, likeness double")


def near_duplicates(records: DataFrame, k: int = 3, threshold: float = 0.6, min_words: int = 60) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives, and the class of each record.

    `records` has id BIGINT (unique) and text STRING; further columns are ignored. Returns (a, b, likeness) with a < b
    for every found pair of different texts, and (id, rep) for every record that takes part. Null texts and texts of
    under min_words words take no part; an empty table gives empty results; of repeated rows with one id only the
    id's classes count.
    """
    records = records.select("id", "text")
    base = persisted(sketches(spread(records), k, min_words))
    reps = base.groupBy("hi", "lo").agg(F.min(F.struct("id", "n", "sketch")).alias("r")).select("hi", "lo", "r.*")
    members = base.select("id", "hi", "lo").distinct().join(reps.select("hi", "lo", F.col("id").alias("rep")), ["hi", "lo"]).select("id", "rep")
    links = verified(candidates(reps, threshold), records, k, threshold)
    return links, members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b): links expanded to the members of both classes, and the pairs within each class; nothing is left out.

    That is as many rows as there are pairs: a class of n copies makes n(n - 1)/2. The links with the classes (p3_links,
    p3_classes) say the same in rows that grow with the records and the links between different texts.
    """
    sized = members.groupBy("rep").agg(F.count("*").alias("size")).filter("size > 1")
    copies = members.join(sized, "rep").select("id", "rep")
    within = copies.alias("x").join(copies.alias("y"), F.expr("x.rep = y.rep and x.id < y.id")).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    side = lambda s: copies.select(F.col("rep").alias(s), F.col("id").alias(f"id_{s}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"))
    return between.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).union(within)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "evidence").select("id", F.col("excerpt").alias("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of evidence ids whose excerpts (of at least 60 words) have a likeness of at least 0.6 on three words."""
    return all_pairs(*near_duplicates(_evidence(spark, sf_dir)))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal word sequences: the least ids of both, their likeness, and the pairs of rows that a link stands for."""
    links, members = near_duplicates(_evidence(spark, sf_dir))
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    side = lambda s: sizes.select(F.col("rep").alias(s), F.col("size").alias(f"size_{s}"))
    return links.join(side("a"), "a").join(side("b"), "b").select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("likeness", 6).alias("likeness"), (F.col("size_a") * F.col("size_b")).alias("pairs"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an evidence row that takes part: its class of equal word sequences and its number of links to others."""
    links, members = near_duplicates(_evidence(spark, sf_dir))
    links = persisted(links)
    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(degree, "rep", "left").select(F.col("id").alias("evidence_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p3_classes": p3_classes}
SQL: dict[str, str] = {}
