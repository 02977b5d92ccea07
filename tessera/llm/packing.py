"""Filling containers of fixed capacity: dominance reduction after Martello and Toth, then best fit.

Items count by their size alone, and sizes are whole numbers up to the capacity, so the plan is made on the histogram of
sizes: at most `capacity` rows reach the driver, however many items there are. A plan is a list of (sizes in a container,
how many such containers). The reduction fixes containers that some optimal packing holds: an item alone if not even the
smallest fits beside it; with the largest that fits if that fills the container, if at most one more fits, or if at most
two fit and the one is no smaller than any fitting pair. The rest is packed by best fit in order of falling size, whole
classes of equal containers at a time. Items then take the places of their size by their rank.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import RANKS, token_counts
from tessera.sources.tables import load, persisted

CAPACITY = 2048
#: Rows of a size that one task ranks, about; sizes with more are split.
RANKED_ROWS = 200_000

Pattern = tuple[tuple[int, int], ...]


def reduction(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fixes dominating containers and removes their items from `counts` (size: how many)."""
    fixed: list[tuple[Pattern, int]] = []

    def fix(sizes: list[int], times: int) -> None:
        pattern = tuple(sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True))
        fixed.append((pattern, times))
        for s, q in pattern:
            counts[s] -= q * times
            if not counts[s]:
                del counts[s]
                present.remove(s)

    present = sorted(counts)
    for j in sorted(counts, reverse=True):
        while j in counts:
            room = capacity - j
            smallest: list[int] = []  # the three smallest others
            for s in present:
                smallest += [s] * min(3, counts[s] - (s == j))
                if len(smallest) >= 3:
                    break
            if not smallest or smallest[0] > room:
                fix([j], counts[j] if not smallest or smallest[0] != j else 1)
                continue
            at = bisect_right(present, room) - 1
            if present[at] == j and counts[j] == 1:
                at -= 1
            best = present[at]
            fits_two = len(smallest) > 1 and sum(smallest[:2]) <= room
            fits_three = len(smallest) > 2 and sum(smallest[:3]) <= room
            if best == room or not fits_two or (not fits_three and best >= _best_pair(present, counts, j, room)):
                times = counts[j] // 2 if best == j else min(counts[j], counts[best])
                fix([j, best], times)  # what remains is fewer, so the condition holds as long as both last
                continue
            break
    return fixed


def _best_pair(present: list[int], counts: dict[int, int], j: int, room: int) -> int:
    """The largest sum of two items other than one of size j that is at most `room`; 0 if none."""
    others = [s for s in present[: bisect_right(present, room)] if counts[s] > (s == j)]
    best, low, high = 0, 0, len(others) - 1
    while low <= high:
        a, b = others[low], others[high]
        if a + b > room:
            high -= 1
        else:
            if low < high or counts[a] - (a == j) > 1:
                best = max(best, a + b)
            low += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in order of falling size, over classes of equal containers."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}  # by free space
    spaces: list[int] = []
    closed: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, times: int) -> None:
        free = capacity - sum(s * q for s, q in pattern)
        if not free:
            closed.append((pattern, times))
            return
        if free not in open_:
            open_[free] = []
            insort(spaces, free)
        open_[free].append((pattern, times))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect_right(spaces, s - 1)
            if at == len(spaces):
                q = capacity // s
                if left >= q:
                    put(((s, q),), left // q)
                if left % q:
                    put(((s, left % q),), 1)
                break
            free = spaces[at]
            pattern, times = open_[free].pop()
            if not open_[free]:
                del open_[free]
                spaces.pop(at)
            q = free // s
            whole = min(times, left // q)
            if whole:
                put((*pattern, (s, q)), whole)
                left -= whole * q
            if times > whole:
                if 0 < left < q:
                    put((*pattern, (s, left)), 1)
                    left, whole = 0, whole + 1
                if times > whole:
                    put(pattern, times - whole)
    return closed + [x for xs in open_.values() for x in xs]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Containers for `histogram` (size from 1 to capacity: how many); every item has exactly one place."""
    counts = {int(s): int(n) for s, n in histogram.items() if n}
    return reduction(counts, capacity) + best_fit(counts, capacity)


def places(containers: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size, in order of rank: the first rank of each stretch of places, its first container, and places a container."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in containers:
        for s, q in pattern:
            by.setdefault(s, []).append((used.get(s, 0), base, q))
            used[s] = used.get(s, 0) + q * times
        base += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*x)) for s, x in by.items()}


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, size, container) of `items` (id BIGINT, size INT).

    An item larger than the capacity is divided: pieces of the capacity, numbered from 0, and a last one with the rest.
    Items of size 0 or null take no space: they come out once, with piece 0, size 0 and a null container. Repeated rows
    are items of their own. An empty table gives an empty result.
    """
    spark = items.sparkSession
    cut = items.select("id", F.coalesce(F.col("size").cast("int"), F.lit(0)).alias("total"))
    pieces = cut.select("id", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity).cast("int") - 1, F.lit(0)))).alias("piece"))
    pieces = persisted(pieces.select("id", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("size")))
    histogram = {r["size"]: r["n"] for r in pieces.filter("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    parts = max(1, -(-max(histogram.values(), default=1) // RANKED_ROWS))
    salted = pieces.filter("size > 0").withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).cast("int"))
    before = salted.groupBy("size", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("size", "part").orderBy("id", "piece")))
    ranked = ranked.join(before, ["size", "part"]).select("id", "piece", "size", (F.col("rank") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = np.empty(len(p), dtype=np.int64)
            sizes, ranks = p["size"].to_numpy(), p["rank"].to_numpy()
            order = np.argsort(sizes, kind="stable")
            edges = np.flatnonzero(np.diff(sizes[order])) + 1
            for rows in np.split(order, edges) if len(p) else []:
                start, base, each = where.value[int(sizes[rows[0]])]
                at = np.searchsorted(start, ranks[rows], side="right") - 1
                out[rows] = base[at] + (ranks[rows] - start[at]) // each[at]
            yield pd.DataFrame({"id": p["id"], "piece": p["piece"], "size": p["size"], "container": out})

    placed = ranked.mapInPandas(place, "id long, piece int, size int, container long")
    return placed.unionByName(pieces.filter("size <= 0").withColumn("container", F.lit(None).cast("long")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, tokens, container): documents, or pieces of 2,048 tokens of longer ones, with their containers."""
    counts = token_counts(load(spark, sf_dir, "documents"), ranks=RANKS).select(F.col("doc_id").alias("id"), F.col("tokens").alias("size"))
    return packed(counts).select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("tokens"), "container")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well containers are filled: containers, tokens, the least number that could hold the tokens, unused space."""
    per = p7_containers(spark, sf_dir).filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"))
    return total.withColumn("least_containers", F.ceil(F.col("tokens") / CAPACITY)).withColumn("unused", F.col("containers") * CAPACITY - F.col("tokens"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
