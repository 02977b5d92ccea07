import json

from tessera.functions.recipes import bind_record, locate_records, places
from pyspark.sql import functions as F

TEXT = "Plum jam\nServes 4\nIngredients\n2 cups plums\nsugar\nMethod\nCook the plums.\nAdd sugar and stir.\nNotes\nKeeps long."


def page(**recipe):
    return f'<script type="application/ld+json">{json.dumps({"@graph": [{"@type": ["Recipe"], **recipe}]})}</script>'


def kinds(record):
    return [(u[0], TEXT[u[1] : u[2]] if u[1] >= 0 else None, u[4]) for u in record["units"]]


def test_places_overlap_and_keep_code_points():
    assert places("aAa", "aa") == [(0, 2), (1, 3)] and places("🍽 ab", "AB") == [(2, 4)] and places("x", "") == []


def test_structured_record_is_used_if_all_units_are_in_the_text():
    whole = page(name="Plum jam", recipeIngredient=["2 cups <b>plums</b>", "sugar"], recipeInstructions=[{"itemListElement": [{"text": "Cook the plums."}, "Add sugar and stir."]}], recipeYield="4 servings")
    (r,) = locate_records(whole, TEXT, None)
    assert r["tier"] == "jsonld" and r["slot"].startswith("name:") and (r["start"], r["end"]) == (0, TEXT.index("\nNotes"))
    assert kinds(r) == [("name", "Plum jam", "exact"), ("ingredient", "2 cups plums", "exact"), ("ingredient", "sugar", "ambiguous"), ("step", "Cook the plums.", "exact"), ("step", "Add sugar and stir.", "exact"), ("servings", "4", "exact")]
    assert bind_record(TEXT, r) == ("partial", ["ambiguous:ingredient"])


def test_headings_where_the_structured_record_is_not_in_the_text():
    half = page(name="Plum jam", recipeIngredient=["2 cups plums", "honey"], recipeInstructions="Cook the plums.")
    (r,) = locate_records(half, TEXT, "Plum jam")
    assert r["tier"] == "heading"
    assert kinds(r) == [("name", "Plum jam", "exact"), ("ingredient", "2 cups plums", "exact"), ("ingredient", "sugar", "unmatched"), ("step", "Cook the plums.", "exact"), ("step", "Add sugar and stir.", "exact"), ("servings", "4", "exact")]
    (bare,) = locate_records("", TEXT, None)
    assert bare["slot"] is None and bind_record(TEXT, bare) == ("partial", ["no_name"])
    assert bind_record(TEXT, locate_records(None, TEXT, "Plum jam")[0]) == ("complete", [])


def test_microdata_slots_and_conflicts():
    html = '<b itemprop="name">Plum jam</b><li itemprop="recipeIngredient">2 cups plums</li><li itemprop="recipeInstructions">Cook the plums.</li><meta itemprop="recipeYield" content="serves 6">'
    (r,) = locate_records(html, TEXT, None)
    assert r["tier"] == "microdata" and bind_record(TEXT, r) == ("usable", ["conflict:servings"])
    two = page(name="Plum jam", recipeIngredient=["2 cups plums"], recipeInstructions="Cook the plums.") * 2
    assert [x["slot"][-2:] == "#2" for x in locate_records(two, TEXT, None)] == [False, True]
    assert locate_records(None, None, None) == [] and locate_records("<script type='application/ld+json'>{x</script>", "", "t") == []


def test_core_queries_run_over_empty_and_odd_tables(spark, tmp_path):
    from tessera.operators.access import permission_chain, settled
    from tessera.operators.grammar import joined_lines, visible
    from tessera.operators.pages import record_units

    row = spark.createDataFrame([("One line\ngoes on​ here.\nNext: \n- item\n\nEnd", None)], "a string, b string").select(joined_lines("a"), visible(F.lit("a b﻿")), joined_lines("b")).first()
    assert tuple(row) == (["One line goes on here.", "Next:", "- item", "End"], "a b", None)
    for name in ("evidence", "evidence_text", "fetch_attempts"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert record_units(spark, str(tmp_path)).count() == 0 and settled(spark, str(tmp_path)).count() == 0
    assert sum(r["destinations"] for r in permission_chain(spark, str(tmp_path)).collect()) == 5
