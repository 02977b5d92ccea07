from tessera.operators.records import bind_units, bound, forest_faults, identity, manifest_drift, retry_after


def test_identity():
    assert identity("Ｓtraße_1  –  Café") == "strasse 1 café" and identity(None) is None and identity("—") == ""


def test_units_take_places_in_order():
    text = "salt\n2 cups  rye\nsalt and salt"
    assert bind_units(text, ["salt", "2 cups rye", "salt", "salt", "salt"]) == [(0, 4, "exact"), (5, 16, "folded"), (17, 21, "exact"), (26, 30, "exact"), (-1, -1, "missing")]
    assert bind_units("a  b\na   b", ["a b"]) == [(-1, -1, "ambiguous")]
    assert bind_units(None, ["x"]) == [(-1, -1, "missing")] and bind_units("x", None) == [] and bind_units("x", [""]) == [(-1, -1, "missing")]
    assert bind_units("ü€😀salt", ["salt"]) == [(3, 7, "exact")]


def test_bound_rows(spark):
    rows = spark.createDataFrame([(1, "a b c", ["c", "a"], 0), (2, None, ["a"], 0), (3, "a", None, 0)], "id long, text string, units array<string>, n int")
    assert sorted(map(tuple, bound(rows).collect())) == [(1, 0, 4, 5, "exact"), (1, 1, -1, -1, "missing"), (2, 0, -1, -1, "missing")]
    assert bound(rows.limit(0)).count() == 0


def test_retry_after(spark):
    values = ["120", " 5 ", "Wed, 21 Oct 2026 07:28:10 GMT", "Tue, 20 Oct 2026 07:28:00 GMT", "-3", "soon", "", None, "99999999999999999999"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string").selectExpr("id", "value", "timestamp '2026-10-21 07:28:00 UTC' as now")
    assert [r[0] for r in rows.orderBy("id").select(retry_after("value", "now")).collect()] == [120, 5, 10, None, None, None, None, None, None]


def test_manifest_drift(spark):
    old, new = (spark.createDataFrame(x, "name string, sha256 string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert sorted(map(tuple, manifest_drift(old, new).collect())) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_forest_faults(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(7)]
    edges = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("u", "zz")], "id string, parent string")
    assert dict(map(tuple, forest_faults(edges, "id", "parent").collect())) == {"u": "unknown_parent", "x": "cycle", "y": "cycle", "5": "too_deep", "6": "too_deep"}
