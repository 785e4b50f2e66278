"""Exact faults against going through all cells one by one, and what the checks after them find."""

import dataclasses
import hashlib
from collections import Counter
from datetime import date
from math import floor

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import faults, quality
from ledgerline.operators.selection import n_smallest


@pytest.mark.parametrize("n", [0, 1, 7, 500, 999, 1000, 5000])
def test_the_smallest_are_exact(spark, n):
    rows = spark.range(1000).select("id", quality.token("s", F.col("id")).alias("k"))
    want = sorted((r["k"], r["id"]) for r in rows.collect())[:n]
    assert sorted((r["k"], r["id"]) for r in n_smallest(rows, "k", n, "id").collect()) == want


def test_equal_hashes_go_by_the_ties(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, F.lit(5)).otherwise(F.lit(2**52 - 1)).cast("long").alias("k"))
    assert {r["id"] for r in n_smallest(rows, "k", 13, "id").collect()} == set(range(13))
    assert {r["id"] for r in n_smallest(rows, "k", 92, "id").collect()} == set(range(92))


RULES = {"missing": ("kind", "note"), "soft_join": ("note",), "rounding": ("value",)}


def table(spark, n=400):
    return spark.createDataFrame([(i, i % 7, date(2020, 1, 1), None if i % 10 == 0 else "AB", "here and there", float(i) if i % 3 else i + 0.26) for i in range(n)], "id long, player_id long, day date, kind string, note string, value double")


def one_by_one(rows, level):
    """The rule as the cells are gone through in the order of their hashes."""
    h = lambda *parts: int(hashlib.sha256("|".join(map(str, ("s", *parts))).encode()).hexdigest()[:13], 16)
    used, hit, out = Counter(), set(), []
    for kind, columns in RULES.items():
        left = floor(len(rows) * quality.rate_of(level, quality.FAMILY[kind]))
        cells = sorted((h(kind, c, r["id"]), r["id"], c, r[c]) for r in rows for c in columns if r[c] is not None and (kind != "rounding" or (round(r[c], 1 if h(kind, c, r["id"]) % 2 == 0 else 0) != r[c])))
        for _, key, c, _ in cells:
            if left and used[key] < 2 and (key, c) not in hit:
                used[key] += 1
                hit.add((key, c))
                out.append((key, c, kind))
                left -= 1
    return Counter(out)


@pytest.mark.parametrize("level", quality.LEVELS)
def test_cells_are_those_of_the_walk(spark, level):
    rows = table(spark)
    what = faults.Injection("t", "id", RULES, level, "s")
    got = Counter((r["id"], r["column_name"], r["issue_type"]) for r in faults.exact_cells(rows, what).collect())
    assert got == one_by_one(rows.collect(), level)


def test_a_rows_fields_are_limited(spark, monkeypatch):
    monkeypatch.setitem(quality.LEVELS, "very_high", ((100, 100), (0, 0), (100, 100), (0, 0)))
    what = faults.Injection("t", "id", RULES, "very_high", "s")
    got = Counter((r["id"], r["column_name"], r["issue_type"]) for r in faults.exact_cells(table(spark), what).collect())
    assert got == one_by_one(table(spark).collect(), "very_high")
    assert max(Counter(k for k, _, _ in got).values()) == 2


def test_protected_columns_are_refused(spark):
    for column in ("id", "player_id", "day", "note"):
        what = faults.Injection("t", "id", {"missing": (column,)}, "high", "s", protected=("note",))
        with pytest.raises(ValueError, match=column):
            faults.exact_cells(table(spark), what)


def test_the_manifest_has_twelve_columns_and_its_cells_are_applied(spark):
    rows, what = table(spark), faults.Injection("t", "id", RULES, "very_high", "s", "7", "r")
    cells = faults.exact_cells(rows, what)
    kept = faults.manifest(cells, what, F.lit("2020-01-01")).collect()
    assert len(kept[0]) == 12 and kept[0]["rule_id"] == f"t.{kept[0]['issue_type']}"
    new = {r["id"]: r for r in faults.applied(rows, "id", cells).collect()}
    old = {r["id"]: r for r in rows.collect()}
    said = {(int(r["record_primary_key"]), r["column_name"]): r["injected_value"] for r in kept}
    changed = {(i, c) for i in old for c in rows.columns if old[i][c] != new[i][c]}
    assert changed == set(said)
    assert all(new[i][c] == (None if v is None else type(old[i][c])(v)) for (i, c), v in said.items())


def test_checks_find_what_is_wrong(spark):
    rows, what = table(spark), faults.Injection("t", "id", RULES, "medium", "s")
    cells = faults.exact_cells(rows, what)
    good = faults.applied(rows, "id", cells)
    failed = lambda tainted, cells=cells, **more: {(r["category"], r["name"]) for r in faults.injection_checks(rows, tainted, cells, what, **more).where("status = 'failed'").collect()}
    assert failed(good) == set()
    assert ("protected", "t.player_id") in failed(good.withColumn("player_id", F.when(F.col("id") == 5, 99).otherwise(F.col("player_id"))))
    swapped = good.withColumn("player_id", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("player_id")))
    assert failed(swapped) == {("protected", "t.player_id")}
    assert failed(good.where("id > 0")) >= {("row_count", "t"), ("protected", "t.id")}
    more = good.unionByName(good.where("id = 3"))
    assert failed(more) >= {("row_count", "t"), ("primary_key", "t.id")}
    assert failed(good.unionByName(good.where("id = 3").withColumn("id", F.lit(10_000).cast("long"))), added=1) == set()
    assert failed(good.select(*reversed(good.columns))) == {("shape", "t")}
    assert failed(good, required=["kind", "note"]) == {("required", "t")}
    every = rows.select("id", F.lit("note").alias("column_name"), F.lit("missing").alias("issue_type"), F.col("note").alias("clean_value"), F.lit(None).cast("string").alias("tainted_value"))
    assert failed(good, every) >= {("limits", "rows in all"), ("limits", "missing")}
    keys = rows.select("id", F.lit("player_id").alias("column_name"), F.lit("missing").alias("issue_type"), F.lit("1").alias("clean_value"), F.lit("2").alias("tainted_value")).limit(1)
    assert failed(good, keys) == {("protected", "t: manifest")}


def test_small_moves_in_time(spark):
    df = spark.sql("SELECT * FROM VALUES (DATE '2020-01-02', DATE '2020-01-03', 1), (DATE '2020-01-02', DATE '2020-01-01', 1), (DATE '2020-01-02', DATE '2020-01-04', 0), (DATE '2020-01-02', DATE '2020-01-02', 0) AS t(a, b, want)")
    assert all(r["got"] == bool(r["want"]) for r in df.withColumn("got", faults.looks_jittered(F.col("a"), F.col("b"))).collect())


def test_levels_together_are_the_levels_alone(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 20 == 0, "some words and more").alias("a"), F.lit("x and y").alias("b"), (F.col("id") * 1.5 + 1).alias("v"))
    what = faults.Injection("t", "id", {"missing": ("a", "b", "v"), "soft_join": ("a", "b"), "outlier": ("v",)}, "low", "s")
    levels = ["very_high", "none", "medium"]
    got = faults.exact_cells_by_level(rows, what, levels)
    for level in levels:
        alone = faults.exact_cells(rows, dataclasses.replace(what, level=level))
        assert got[level].exceptAll(alone).count() == alone.exceptAll(got[level]).count() == 0
        kinds = {r["issue_type"]: r["count"] for r in got[level].groupBy("issue_type").count().collect()}
        assert kinds == {k: n for k in what.rules if (n := int(3000 * quality.rate_of(level, quality.FAMILY[k])))}
