from pyspark.sql import functions as F

from tessera.operators.instants import evidence_dates, normalise, publisher_zones


def tables(spark):
    evidence = spark.createDataFrame(
        [(1, "A", "2024-01-01 10:00", "meta:date", None, "x"), (2, "A", "2024-01-01 10:00", " Unknown ", "2024-01-02T00:00Z", "x"), (3, None, "2024-01-01 10:00", "meta:date", "nonsense", "x"), (4, "B", None, None, "", "x")],
        "id long, attribution string, published_at string, published_at_basis string, modified_at string, raw string",
    )
    publishers = spark.createDataFrame([("A", "Europe/Berlin", "DMY"), ("A", "Europe/Berlin", "DMY"), ("B", None, "DMY")], "canonical_name string, zone_name string, date_order string")
    return evidence, publishers


def test_rows_keep_their_dates(spark):
    evidence, publishers = tables(spark)
    out = normalise(evidence_dates(evidence, publishers), publisher_zones(publishers)).select("evidence_id", "field_name", "utc_us").collect()
    assert sorted(map(tuple, out)) == [(1, "published_at", 1704099600000000), (2, "modified_at", 1704153600000000)]


def test_empty_tables(spark):
    evidence, publishers = (t.limit(0) for t in tables(spark))
    assert normalise(evidence_dates(evidence, publishers), publisher_zones(publishers)).count() == 0


def test_dictionary_parses_new_values_once(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    evidence, publishers = tables(spark)
    values, zones = evidence_dates(evidence, publishers), publisher_zones(publishers)
    assert normalise(values, zones, path).count() == 2
    before = spark.read.parquet(path).count()
    assert normalise(values, zones, path).count() == 2
    assert spark.read.parquet(path).count() == before
    more = values.union(values.limit(1).withColumn("raw", F.lit("2025-01-01T00:00Z")))
    assert normalise(more, zones, path).count() == 3
    assert spark.read.parquet(path).count() == before + 1
    # other zones parse anew, and what two runs appended at once is read once
    assert normalise(more, (*zones, "America/Chicago"), path).count() == 3
    assert spark.read.parquet(path).count() == 2 * (before + 1)
    spark.read.parquet(path).write.mode("append").parquet(str(tmp_path / "twice"))
    spark.read.parquet(path).write.mode("append").parquet(str(tmp_path / "twice"))
    assert normalise(more, zones, str(tmp_path / "twice")).count() == 3
    assert publisher_zones(publishers.union(spark.createDataFrame([("C", "No/Where", "DMY")], publishers.schema))) == zones


def test_the_kept_dictionary_is_a_setting(spark, tmp_path):
    from tessera.operators.instants import KEPT, p2_found

    first = p2_found(spark, "/root/testdata/sf0.001").count()
    spark.conf.set(KEPT, str(tmp_path / "kept"))
    try:
        assert p2_found(spark, "/root/testdata/sf0.001").count() == first == p2_found(spark, "/root/testdata/sf0.001").count()
        assert spark.read.parquet(str(tmp_path / "kept")).groupBy("raw", "zone", "day_order", "trusted").count().filter("count > 1").count() == 0
    finally:
        spark.conf.unset(KEPT)
