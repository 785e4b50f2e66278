"""Seed folders, levels of faults, copied families, submissions and certification on small tables with known answers."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import checks, quality, ratings, reconcile, sampling
from ledgerline.plans import certify, intake_bindings
from ledgerline.sources import delimited, ingest
from ledgerline.streaming import events as streams

CLUBS = delimited.DATASETS["clubs"]


def test_files_by_token_and_their_checksums(spark, tmp_path):
    for name in ("b_Clubs.csv", "a_clubs.CSV", "clubs.txt", "names.csv"):
        (tmp_path / name).write_bytes(name.encode() + b"\xff\x00x")
    found = ingest.discover(spark, str(tmp_path), ["clubs"]).collect()
    assert [r["name"] for r in found] == ["a_clubs.CSV", "b_Clubs.csv"]
    sums = {r["name"]: r["sha256"] for r in ingest.checksums(spark, [r["path"] for r in found]).collect()}
    assert sums == {n: hashlib.sha256(n.encode() + b"\0" + n.encode() + b"\xff\x00x" + b"\0").hexdigest() for n in ("a_clubs.CSV", "b_Clubs.csv")}


def test_encodings_and_row_numbers(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿club_name,region\nCafé,Québec\n\n,x\nZüri,\n".encode())
    (tmp_path / "w.csv").write_bytes("club_name,region\nCafé €,“A”\n".encode("cp1252"))
    rows = ingest.read_numbered(spark, [str(tmp_path / "u.csv"), str(tmp_path / "w.csv")], CLUBS)
    good, bad = delimited.split(rows, CLUBS)
    assert {(r["source_file"], r["source_row_number"], r["club_name"], r["region_name"]) for r in good.collect()} == {("u.csv", 2, "Café", "Québec"), ("u.csv", 4, "Züri", None), ("w.csv", 2, "Café €", "“A”")}
    assert [(r["source_row_number"], r["error_message"]) for r in bad.collect()] == [(3, "club_name is missing")]


def test_row_numbers_across_blocks(spark, tmp_path):
    (tmp_path / "long.csv").write_text("".join(f"name{i}|{i}\n" for i in range(1, 5001)))
    data = delimited.Dataset("long", {}, delimiter="|", header=False, columns=("name", "n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = ingest.read_numbered(spark, str(tmp_path / "long.csv"), data)
        assert rows.where(F.col("n").cast("int") == F.col("source_row_number")).count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_source_is_replaced_whole(spark):
    kept = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "v int, source_file string")
    out = ingest.replace_by_source(kept, spark.createDataFrame([(9, "a")], "v int, source_file string"))
    assert sorted((r["v"], r["source_file"]) for r in out.collect()) == [(3, "b"), (9, "a")]


def test_levels_protect_and_hit_two_fields_at_most(spark):
    assert quality.shifted("none") == "none" and quality.shifted("high") == "medium" and quality.rate_of("low", "fields") == pytest.approx(0.003)
    rows = spark.range(4000).select("id", *[F.lit("Ann and Bo").alias(c) for c in "abcd"], F.lit(dt.date(2025, 1, 1)).alias("day"))
    kinds = {"a": "name_case", "b": "soft_join", "c": "missing", "d": "missing", "day": "jitter"}
    bad, cells = quality.inject_level(rows, "id", kinds, "very_high", "s")
    assert cells.groupBy("id").count().agg(F.max("count")).first()[0] <= 2
    changed = sum((~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).cast("int") for c in kinds)
    assert rows.alias("x").join(bad.alias("y"), "id").agg(F.max(changed)).first()[0] == 2
    assert bad.where(F.abs(F.datediff("day", F.lit(dt.date(2025, 1, 1)))) > 1).count() == 0
    assert {r["issue_type"] for r in cells.select("issue_type").distinct().collect()} == {"name_case", "soft_join", "missing", "jitter"}
    assert quality.inject_level(rows, "id", kinds, "none", "s")[1].count() == 0
    for name, protected in (("club_id", ()), ("a", ("a",))):
        with pytest.raises(ValueError, match="protected"):
            quality.inject_level(rows, "id", {name: "missing"}, "low", "s", protected)


def test_copies_keep_their_children(spark):
    a = spark.range(1, 101).select("id", F.lit("x").alias("v"))
    b = spark.range(1, 301).select("id", (F.col("id") % 100 + 1).alias("a_id"))
    out = quality.with_duplicates({"a": a, "b": b}, "a", {"a": "id", "b": "id"}, {"b": ("a_id", "a")}, 0.2, "s")
    more = out["a"].count() - 100
    assert 5 < more < 40 and out["b"].count() == 300 + 3 * more
    assert out["b"].select("id").distinct().count() == out["b"].count()
    assert out["b"].join(out["a"].select(F.col("id").alias("a_id")), "a_id", "left_anti").count() == 0


def test_copies_alone_without_a_look_at_the_whole_tables(spark):
    rows = spark.range(-299, 1)
    t = {"matches": rows, "match_teams": rows.withColumn("match_id", F.col("id")), "match_games": rows.withColumn("match_id", F.col("id")), "match_team_players": rows.withColumn("match_team_id", F.col("id"))}
    found = intake_bindings.copied_match_families(t)
    hit = {r["id"] for r in rows.where(quality.token("family", F.lit("matches"), F.col("id")) < int(0.05 * 2**52)).collect()}
    # The largest key is 0, so each copy's key is one that is there already; it is a copy still.
    assert len(hit) > 5 and {n: {r["id"] for r in found.where(F.col("table_name") == n).collect()} for n in t} == dict.fromkeys(t, hit)
    assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_fall_back_from_state_to_country(spark):
    names = spark.createDataFrame([("US", "TX", 1950, "F", "Ada", 3), ("US", "NY", 1990, "F", "Eve", 1), ("US", "NY", 1990, "M", "Bob", 1)], "country_code string, state_province_code string, birth_year int, gender string, first_name string, frequency_count int")
    who = spark.createDataFrame([(1, "US", "TX", 1999, "F"), (2, "US", "CA", 1985, "F"), (3, "US", "TX", 1950, "M"), (4, "CA", "ON", 1950, "F"), (5, "US", "CA", 1970, "F")], "id int, country_code string, state_province_code string, birth_year int, gender string")
    assert {r["id"]: r["first_name"] for r in sampling.first_names(who, names, F.lit(0.4)).collect()} == {1: "Ada", 2: "Eve", 3: "Bob", 4: None, 5: "Ada"}


def test_reports_in_order_and_mismatches_written(spark, tmp_path):
    made = spark.createDataFrame([("a", "x", "passed", 0), ("b", "y", "failed", 1), ("a", "z", "failed", 5)], "category string, name string, status string, failures int")
    assert [r["name"] for r in checks.failed_first(made).collect()] == ["z", "y", "x"]
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string"), spark.createDataFrame([(1, "c")], "id long, s string")
    reconcile.write(reconcile.differences(left, right, "id", {"s": "s"}), str(tmp_path / "out"), "id")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/mismatches_csv")).count() == 2
    assert {(r["issue"], r["open"]) for r in spark.read.json(str(tmp_path / "out/summary")).collect()} == {("value", 1), ("missing", 1)}


def test_biases_gaps_and_comparison_of_assessments():
    rows = {"fatigue_effectiveness": [{"workload_band": "0", "avg_score_share_delta": 0.0}, {"workload_band": "2_plus", "avg_score_share_delta": 0.04}]}
    plain, strict = certify.assess(rows, required=()), certify.assess(rows, certify.with_biases(["fatigue"]), required=())
    assert plain["findings"] == [] and strict["findings"][0]["severity"] == "warning"
    assert certify.compared(strict, plain) == {"overall": -10.0, "pillars": {"simulation_fidelity": -10.0}, "worse": ["fatigue_effectiveness"], "better": []}
    assert json.loads(certify.snapshot(strict, "2025-01"))["overall"] == 90.0
    assert certify.assess({"volatility_decay": [{"experience_band": "0_4", "avg_volatility_score": None}]}, required=())["findings"] == []


def test_streamed_ratings_match_the_fold(spark, tmp_path):
    made = [(p, dt.date(2026, 1, d), d * 10 + p, (p * 7 + d * 3) % 10 / 10, (p * 5 + d) % 11 / 10) for p in range(1, 6) for d in range(1, 21)]
    shape = "player_id long, match_date date, match_id long, expected_score_share double, actual_score_share double"
    for part in (made[:0] + [m for m in made if m[1].day <= 9], [m for m in made if m[1].day > 9]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    states = spark.createDataFrame([(p, 1400.0 + p * 120, None if p == 2 else 0.3, p) for p in range(1, 6)], "player_id long, rating double, confidence double, match_count long")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.rating_updates(stream, states).writeStream.outputMode("append").format("memory").queryName("rated").trigger(availableNow=True).start()
    q.awaitTermination()
    order = ["player_id", "match_id"]
    want = ratings.fold(spark.createDataFrame(made, shape), states)
    assert spark.table("rated").orderBy(order).collect() == want.select(spark.table("rated").columns).orderBy(order).collect()
