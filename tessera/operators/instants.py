"""Mixed date notations and zones as UTC instants, by a dictionary of distinct values.

The distinct (raw text, zone, day order) combinations of a table form a dictionary; each is parsed once, the parsed part
of the dictionary is written to a table, and the instants are joined back to the rows. Given the table of an earlier
run, only values that it lacks are parsed, and are appended to it. What a zone's abbreviation denotes depends on the zones
in use, so rows are kept with a digest of those, and other zones find no rows of theirs. Runs at the same time may append a
value twice; it is read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zoneinfo import available_timezones

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import instant
from tessera.sources.tables import load, persisted

KEY = ["raw", "zone", "day_order", "trusted"]
#: The setting that names the dictionary which p2_found keeps between runs; unset, it lives for one run.
KEPT = "spark.tessera.dates.dictionary"
DICTIONARY = "raw string, zone string, day_order string, trusted boolean, utc_us long"


def parsed(distinct: DataFrame, zones: tuple[str, ...]) -> DataFrame:
    """DICTIONARY rows of distinct KEY rows; empty strings stand for a missing zone or order, utc_us is null where no instant is denoted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            us = [instant(r, z or None, o or None, zones, t) for r, z, o, t in zip(p["raw"], p["zone"], p["day_order"], p["trusted"])]
            yield p.assign(utc_us=pd.array(us, dtype="Int64"))

    return distinct.mapInPandas(run, DICTIONARY)


def normalise(values: DataFrame, zones: tuple[str, ...], dictionary: str | None = None) -> DataFrame:
    """`values` with utc_us for each row that denotes an instant; the others are left out.

    Needs raw, zone, day_order (STRING) and trusted (BOOLEAN, may the publisher's zone be used); other columns are kept.
    Nulls, blanks and repeated rows are allowed: null raws denote nothing, repeated rows stay. `dictionary` is the path of
    the Parquet table kept between runs; without it the dictionary lives in the shared folder for this run.
    """
    spark = values.sparkSession
    keyed = values.filter("raw is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("zone", "day_order")})
    distinct = keyed.select(*KEY).distinct()
    if dictionary is None:
        known = persisted(parsed(distinct, zones))
    else:
        digest = hashlib.sha256("\n".join(zones).encode()).hexdigest()
        stored = lambda: spark.read.schema(f"{DICTIONARY}, zones string").parquet(dictionary).filter(F.col("zones") == digest).drop("zones")
        old = None
        try:
            old = stored()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new = persisted(parsed(distinct.join(old, KEY, "left_anti") if old else distinct, zones))
        new.withColumn("zones", F.lit(digest)).write.mode("append").parquet(dictionary)
        known = stored().groupBy(*KEY).agg(F.max("utc_us").alias("utc_us"))
    return keyed.join(known.filter("utc_us is not null"), KEY)


def publisher_zones(publishers: DataFrame) -> tuple[str, ...]:
    """The distinct zone names that the zone database has, sorted; it bounds them (about 600)."""
    return tuple(sorted(r[0] for r in publishers.select("zone_name").filter(F.col("zone_name").isin(*sorted(available_timezones()))).distinct().collect()))


def evidence_dates(evidence: DataFrame, publishers: DataFrame) -> DataFrame:
    """(evidence_id, field_name, raw, zone, day_order, trusted) of published_at and modified_at, where not null.

    A publisher that is listed repeatedly counts by its least zone and order. Only `trusted` values may take the
    publisher's zone: not a published_at whose basis is unknown or null.
    """
    of = publishers.groupBy("canonical_name").agg(F.min(F.struct("zone_name", "date_order")).alias("p"))
    unknown = F.lower(F.regexp_replace(F.coalesce("published_at_basis", F.lit("unknown")), r"[^\p{L}]", "")) == "unknown"
    dates = F.array(
        F.struct(F.lit("published_at").alias("field_name"), F.col("published_at").alias("raw"), (~unknown).alias("trusted")),
        F.struct(F.lit("modified_at").alias("field_name"), F.col("modified_at").alias("raw"), F.lit(True).alias("trusted")),
    )
    rows = evidence.select(F.col("id").alias("evidence_id"), "attribution", F.explode(dates).alias("d")).filter("d.raw is not null")
    rows = rows.join(of, F.col("attribution") == F.col("canonical_name"), "left")
    return rows.select("evidence_id", "d.field_name", "d.raw", F.col("p.zone_name").alias("zone"), F.col("p.date_order").alias("day_order"), "d.trusted")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(evidence_id, field_name, utc_us): the instants that published_at and modified_at denote."""
    publishers = load(spark, sf_dir, "publishers", "canonical_name", "zone_name", "date_order")
    evidence = load(spark, sf_dir, "evidence", "id", "attribution", "published_at", "published_at_basis", "modified_at")
    kept = spark.conf.get(KEPT, None)
    return normalise(evidence_dates(evidence, publishers), publisher_zones(publishers), kept).select("evidence_id", "field_name", "utc_us")


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
