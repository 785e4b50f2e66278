"""Operators on small tables with known answers."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import checks, history, pairs, quality, ratings, reconcile, releases, sampling, seeds, tournament
from ledgerline.operators.shares import bucket, distribution, with_targets
from ledgerline.plans import certify, panel, reports
from ledgerline.sources import delimited, release

D = dt.date


def test_clamped_sum_of_a_hot_key_by_brute_force(spark, monkeypatch):
    """Runs of four rows, so that one key has many; no array holds more than its share."""
    monkeypatch.setattr(ratings, "RUN_BITS", 2)
    rng = random.Random(4)
    made = [(rng.choice((1, 1, 1, 2, 3, None)), i // 2, rng.choice((None, *range(-30, 31)))) for i in range(3000)] + [(4, 0, 7)]
    rng.shuffle(made)
    rows = spark.createDataFrame([(k, t, None if v is None else float(v)) for k, t, v in made], "k long, t long, v double")
    want = {}
    for k, _, v in sorted(made, key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
        x, n = want.get(k, (10.0, 0))
        want[k] = (0.0 if v is None else min(25.0, max(0.0, x + v)), n + 1)
    found = ratings.clamped_sum(rows, "k", ["t"], "v", 0, 25, 10)
    assert {r["k"]: (r["state"], r["steps"]) for r in found.collect()} == want
    runs = rows.withColumn("at", F.monotonically_increasing_id()).select("k", "at", *[F.lit(0.0).alias(c) for c in "lhsf"], F.lit(1).alias("n"))
    assert ratings._composed(runs, "k", 2).agg(F.max("n")).first()[0] <= 4


def test_rating_fold_of_one_match(spark):
    updates = spark.createDataFrame([(p, D(2026, 1, 5), 1, 0.5, a) for p, a in ((1, 0.6875), (2, 0.6875), (3, 0.3125), (4, 0.3125))], "player_id long, match_date date, match_id long, expected_score_share double, actual_score_share double")
    states = spark.createDataFrame([(p, 1500.0, 0.2, 0) for p in (1, 2, 3, 4)], "player_id long, rating double, confidence double, match_count long")
    rows = {r["player_id"]: r for r in ratings.fold(updates, states).collect()}
    assert [rows[p]["rating_after"] for p in (1, 2, 3, 4)] == [Decimal("1509.000")] * 2 + [Decimal("1491.000")] * 2
    assert rows[1]["rating_delta"] == Decimal("9.000") and rows[3]["rating_delta"] == Decimal("-9.000")
    assert {r["confidence_after"] for r in rows.values()} == {Decimal("0.220")}


def test_rating_fold_keeps_order_bounds_and_null_confidence(spark):
    updates = spark.createDataFrame([(1, D(2026, 1, 2), 7, 0.0, 1.0), (1, D(2026, 1, 1), 9, 0.0, 1.0)], "player_id long, match_date date, match_id long, expected_score_share double, actual_score_share double")
    states = spark.createDataFrame([(1, 4990.0, None, 9)], "player_id long, rating double, confidence double, match_count long")
    rows = ratings.fold(updates, states).orderBy("match_count").collect()
    assert [(r["match_id"], r["rating_after"]) for r in rows] == [(9, Decimal("5000.000")), (7, Decimal("5000.000"))]
    assert [r["k_factor"] for r in rows] == [Decimal("16.000")] * 2 and rows[0]["confidence_after"] is None


def test_win_probability_is_symmetric(spark):
    r = spark.createDataFrame([(1500.0, 1700.0)], "a double, b double").select(ratings.win_probability(F.col("a"), F.col("b")).alias("p"), ratings.win_probability(F.col("b"), F.col("a")).alias("q")).first()
    assert r["p"] + r["q"] == pytest.approx(1) and r["p"] < 0.5


def test_hidden_adjustment_caps_each_factor(spark):
    row = {"x_age": 20.0, "y_age": 80.0, "x_recent_games": 40, "x_days_rest": 1, "x_region_strength": 18.0, "y_region_strength": -8.0, "x_shared_club": True, "x_prior_matches": 30, "x_recent_matches": 2, "competitiveness": 0.9}
    parts = ratings.hidden_adjustment("x", "y")
    r = spark.createDataFrame([row]).select(*[c.alias(k) for k, c in parts.items()]).first()
    assert (r["age"], r["fatigue"], r["region"], r["affinity"]) == (35.0, -25.0, 20.0, 22.0)
    assert r["experience"] == pytest.approx(2 * 3.4339872 * 1.25) and r["total"] == 50.0


def test_look_back_leaves_out_the_day_itself(spark):
    rows = spark.createDataFrame([(1, D(2026, 1, 1), 2), (1, D(2026, 1, 1 + 14), 1), (1, D(2026, 1, 16), 5)], "k long, d date, n long")
    got = {r["d"]: r["s"] for r in history.look_back(rows, "k", "d", "n", 14, "s").collect()}
    assert got == {D(2026, 1, 1): 0, D(2026, 1, 15): 2, D(2026, 1, 16): 1}


def test_age_counts_birthdays(spark):
    r = spark.createDataFrame([(D(2000, 2, 29), D(2018, 2, 28))], "b date, a date").select(history.age_years(F.col("b"), F.col("a")).alias("y")).first()
    assert r["y"] == 17


def test_latest_rows_with_nulls_and_ties(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, 1.0, 1, "a"), (1, 2.0, 1, "b"), (1, 2.0, 2, "c"), (1, 2.0, 2, "d"), (None, 5.0, 1, "e"), (None, None, 9, "f"), (2, None, 1, "g"), (2, None, None, "h"), (3, nan, 1, "i"), (3, 9.0, 2, "j"), (4, -0.0, 1, "k"), (4, 0.0, 2, "l")], "k int, at double, id int, v string")
    assert {r["k"]: r["v"] for r in history.latest(rows, ["k"], ["at", "id"]).collect()} == {1: "d", None: "e", 2: "g", 3: "i", 4: "l"}
    assert {r["k"]: r["v"] for r in history.latest(rows, ["k"], ["at", "id"], F.col("id") < 2).collect()} == {1: "b", None: "e", 2: "g", 3: "i", 4: "k"}
    assert {(r["k"], r["id"]): r["v"] for r in history.latest(rows.where("k = 1"), ["k", "id"], ["at"]).collect()} == {(1, 1): "b", (1, 2): "d"}
    assert history.latest(rows.limit(0), ["k"], ["at"]).count() == 0


def test_latest_orders_only_rows_that_can_be_last(spark):
    rows = spark.range(20000).select((F.col("id") % 10).alias("k"), F.col("id").alias("at"), F.lit("x").alias("v"))
    got = history.latest(rows, ["k"], ["at"])
    assert sorted(r["at"] for r in got.collect()) == list(range(19990, 20000))
    plan = got._jdf.queryExecution().executedPlan()
    ordered = re.search(r"\+- Sort .*", plan.toString(), re.S)  # all rows were sorted below here
    assert ordered and "ShuffledHashJoin" in ordered[0]


def test_targets_come_with_what_was_not_seen(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    got = {r["k"]: (r["n"], r["pct_point_drift"]) for r in with_targets(distribution(rows, "k"), "k", {"c": 10, "a": 60}).collect()}
    assert got == {"c": (0, -10.0), "a": (2, 6.67), "b": (1, None)}


def test_bucket_of_null(spark):
    rows = spark.createDataFrame([(None,), (1.0,), (9.0,)], "v double").select(bucket(F.col("v"), [(5, "low")], "high", "unknown").alias("b"))
    assert [r["b"] for r in rows.collect()] == ["unknown", "low", "high"]


def test_changed_rows_only(spark):
    schema = "id long, a string, b string"
    prior = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (4, "gone", "")], schema)
    now = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "new", "")], schema)
    assert {r["id"] for r in releases.changed(now, prior, ["id"]).collect()} == {2, 3}
    assert {r["id"] for r in releases.changed(now, prior, ["id"], ["b"]).collect()} == {3}


def test_future_ends_are_suppressed(spark):
    rows = spark.createDataFrame([(1, D(2025, 1, 1), D(2025, 4, 15), "retired"), (2, D(2025, 1, 1), D(2025, 1, 15), "dormant"), (3, D(2025, 6, 1), None, "active")], "id long, s date, e date, state string")
    got = {r["id"]: (r["e"], r["state"]) for r in releases.known_as_of(rows, "s", "e", F.lit(D(2025, 3, 1)), "state").collect()}
    assert got == {1: (None, "active"), 2: (D(2025, 1, 15), "dormant")}


def test_release_windows():
    months = [D(2025, m, 1) for m in (1, 2, 3)]
    found = releases.windows(months, 2)
    assert [w["kind"] for w in found] == ["historical_baseline", "monthly_update"] and found[1]["facts"] == [months[2]] and found[1]["prior"] == months[:2]
    with pytest.raises(ValueError):
        releases.windows([months[0], months[2]], 1)


def test_checks_do_not_count_unknown(spark):
    rows = spark.createDataFrame([(1, 5, 3), (1, None, 3), (2, 1, 3)], "id long, a int, b int")
    parent = spark.createDataFrame([(1,)], "pk long")
    got = {(r["category"], r["name"]): r["failures"] for r in checks.report(checks.unique("t", rows, "id"), checks.holds("temporal", "t", rows, "a < b"), checks.required("t", rows, "a"), checks.references("t", rows, "id", parent, "pk"), checks.count_is("t", rows, 4)).collect()}
    assert got == {("primary_key", "t"): 1, ("temporal", "t"): 1, ("required", "t"): 1, ("foreign_key", "t"): 1, ("row_count", "t"): 1}


def test_faults_are_found_again(spark):
    rows = spark.range(2000).select("id", F.concat(F.lit("name_"), F.col("id")).alias("name"), (F.col("id") * 1.2345 + 10).alias("v"))
    bad, manifest = quality.inject(rows, "id", {"name": "categorical", "v": "outlier"}, 0.05, "s")
    again, _ = quality.inject(rows, "id", {"name": "categorical", "v": "outlier"}, 0.05, "s")
    assert bad.collect() == again.collect()
    found = {r["column_name"]: r for r in quality.compare(rows, bad, "id", ["v"], ["name"]).collect()}
    counts = {r["column_name"]: r["n"] for r in manifest.groupBy("column_name").agg(F.count("*").alias("n")).collect()}
    assert found["name"]["text_variants"] == counts["name"] and 50 < counts["name"] < 150
    assert found["v"]["outliers"] + found["v"]["rounded"] + found["v"]["other"] == counts["v"]
    with pytest.raises(ValueError):
        quality.inject(rows, "id", {"id": "missing"}, 0.1, "s")


def test_duplicate_like_rows(spark):
    clean = spark.createDataFrame([(1, "Ann-B", 2), (2, "Bob", 3)], "id long, name string, n int")
    bad = spark.createDataFrame([(1, "Ann-B", 2), (9, "ann b", 2)], "id long, name string, n int")
    assert quality.lost_and_added(clean, bad, "id", ["name"], ["n"]).first().asDict() == {"lost": 1, "added": 1, "duplicate_like": 1}


def test_reconciliation_with_waivers(spark):
    left = spark.createDataFrame([(1, " a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id long, s string, v double")
    right = spark.createDataFrame([(1, "a ", 1.0000001), (2, "x", 2.5), (4, "d", 4.0)], "id long, t string, w double")
    waivers = spark.createDataFrame([("s", "2")], "column_name string, waived_key string")
    got = {(r["id"], r["column_name"], r["issue"]): r["waived"] for r in reconcile.differences(left, right, "id", {"s": "t", "v": "w"}, waivers).collect()}
    assert got == {(2, "s", "value"): True, (2, "v", "value"): False, (3, "*", "missing"): False, (4, "*", "extra"): False}


def test_simulation_is_reproducible(spark):
    teams = spark.createDataFrame([(i, 0, 1500.0 + 50 * i) for i in range(4)], "team_id long, division int, rating double")
    places = tournament.standings(tournament.simulate(teams, 50, "s"), "s")
    again = tournament.standings(tournament.simulate(teams, 50, "s"), "s")
    assert sorted(places.collect()) == sorted(again.collect())
    chances = {r["team_id"]: r["title_share"] for r in tournament.chances(places, 50).collect()}
    assert sum(chances.values()) == pytest.approx(1) and chances[3] == max(chances.values())
    with pytest.raises(ValueError):
        tournament.simulate(teams, 0, "s")


def test_name_probabilities(spark):
    names = spark.createDataFrame([("US", "CA", 2000, "M", "Al", 30, "x"), ("US", "CA", 2000, "M", "Bo", 10, "x"), ("US", "NY", 2000, "M", "Bo", 10, "x")], "country_code string, state_province_code string, birth_year int, gender string, first_name string, frequency_count int, source_dataset string")
    got = {(r["state_province_code"], r["first_name"]): r["normalized_probability"] for r in seeds.first_name_probabilities(names).collect()}
    assert got == {("CA", "Al"): 0.75, ("CA", "Bo"): 0.25, ("NY", "Bo"): 1.0}
    last = spark.createDataFrame([("US", "Lee", 10), ("US", "Orr", 10)], "country_code string, last_name string, frequency_count int")
    states = spark.createDataFrame([("US", "CA")], "country_code string, state_province_code string")
    biases = spark.createDataFrame([("US", "CA", "Lee", 3.0), ("US", "CA", "Zed", 2.0)], "country_code string, state_province_code string, last_name string, bias_multiplier double")
    assert {r["last_name"]: r["normalized_probability"] for r in seeds.last_name_probabilities(last, states, biases).collect()} == {"Lee": 0.75, "Orr": 0.25}
    assert [(r["problem"], r["last_name"]) for r in seeds.bias_problems(biases, last).collect()] == [("unknown_name", "Zed")]


def test_metro_regions(spark):
    rows = spark.createDataFrame([(2, "US", "CA", "LA", 300_000, 2.0, 2.0), (1, "US", "CA", "LA", 700_000, 1.0, 1.0)], "id long, country_code string, state_province_code string, region_name string, population long, latitude double, longitude double")
    r = seeds.metro_regions(rows).first()
    assert (r["population"], r["latitude"], r["region_type"], r["selection_probability"]) == (1_000_000, 1.0, "MSA", 1.0)


METRO = "id long, country_code string, state_province_code string, region_name string, population long, latitude double, longitude double"


def test_kinds_and_chances_of_regions(spark):
    rows = [(1, "US", "CA", "LA (CMA)", 60, 1.0, 1.0), (2, "CA", "ON", "Toronto (CMA)", 40, 1.0, 1.0), (3, "CA", "ON", "Orillia (CA)", None, 1.0, 1.0), (4, "CA", "ON", "Elsewhere", -5, 1.0, 1.0), (5, "MX", "SO", "Sonora", 0, 1.0, 1.0)]
    got = {r["region_name"]: (r["region_type"], r["selection_probability"]) for r in seeds.metro_regions(spark.createDataFrame(rows, METRO)).collect()}
    assert got == {"LA (CMA)": ("MSA", 0.6), "Toronto (CMA)": ("CMA", 0.4), "Orillia (CA)": ("CA", 0.0), "Elsewhere": ("metro", 0.0), "Sonora": ("metro", 0.0)}
    nobody = seeds.metro_regions(spark.createDataFrame(rows[2:], METRO)).select("selection_probability").distinct().collect()
    assert [tuple(r) for r in nobody] == [(None,)]


def test_states_with_clubs_but_no_region_become_territories(spark):
    regions = seeds.metro_regions(spark.createDataFrame([(1, "US", "CA", "LA", 60, 1.0, 1.0)], METRO))
    targets = [("US", "CA", "California", 3), ("CA", "YT", "Yukon", 2), ("CA", "YT", "Yukon", 1), ("CA", "NU", "Nunavut", 0), ("CA", "NT", "Northwest", None)]
    shape = "country_code string, state_province_code string, state_province_name string, target_club_count int"
    got = seeds.with_territories(regions, spark.createDataFrame(targets, shape)).select("region_name", "region_type", "population", "selection_probability").collect()
    assert sorted(tuple(r) for r in got) == [("LA", "MSA", 60, 1.0), ("Yukon", "territory", None, 0.0)]
    assert seeds.with_territories(regions, spark.createDataFrame([], shape)).count() == 1


def test_planned_windows_are_those_of_the_list(spark):
    months = [D(2024, 11, 1), D(2024, 12, 1), D(2025, 1, 1), D(2025, 2, 1)]
    rows = spark.createDataFrame([(m.replace(day=d),) for m in months for d in (3, 28)] + [(None,)], "day date")
    got = releases.planned(rows, "day", 2).orderBy("release").collect()
    want = releases.windows(months, 2)
    assert [(r["kind"], r["facts_from"], r["facts_to"], r["snapshot_from"], r["snapshot_to"], r["prior_to"], r["months"]) for r in got] == [
        (w["kind"], w["facts"][0], w["facts"][-1], w["snapshot"][0], w["snapshot"][-1], w["prior"][-1] if w["prior"] else None, len(w["snapshot"])) for w in want
    ]
    assert all(r["contiguous"] for r in got)
    gap = spark.createDataFrame([(months[0],), (months[2],), (months[3],)], "day date")
    assert [r["contiguous"] for r in releases.planned(gap, "day", 1).orderBy("release").collect()] == [True, False, False]
    assert releases.planned(rows.limit(0), "day", 1).count() == 0


def test_lists_in_order(spark):
    rows = spark.createDataFrame([(1, 2, 7), (1, 1, 9), (2, 1, None)], "team int, position int, player int")
    assert {r["team"]: r["roster"] for r in pairs.ordered_json(rows, ["team"], ["position"], "player", "roster").collect()} == {1: "[9,7]", 2: "[null]"}


def test_shapes_that_drifted(spark):
    want = T.StructType.fromDDL("id long, name string, born date, team int")
    found = spark.createDataFrame([], "name string, id int, team int, more double")
    assert {tuple(r) for r in checks.shape_drift(found, want).collect()} == {
        ("born", "missing", "date", None), ("more", "extra", None, "double"), ("id", "moved", "1", "2"), ("name", "moved", "2", "1"), ("id", "type", "bigint", "int"),
    }
    assert checks.shape_drift(spark.createDataFrame([], want), want).count() == 0


def test_rejected_rows_have_reasons(spark, tmp_path):
    (tmp_path / "names.txt").write_text("country|last_name|frequency\nUSA|Lee|1,200\nUSA||5\nCAN|Orr|-3\nUS|Poe|many\n")
    data = delimited.DATASETS["last_names"]
    good, bad = delimited.split(delimited.read(spark, str(tmp_path / "names.txt"), data), data)
    assert [(r["country_code"], r["last_name"], r["frequency_count"], r["source_file"]) for r in good.collect()] == [("US", "Lee", 1200, "names.txt")]
    assert {r["error_message"] for r in bad.collect()} == {"last_name is missing", "frequency_count is not positive", "frequency_count is not a number"}


def test_release_round_trip(spark, tmp_path):
    tables = {"a": spark.range(5), "empty": spark.createDataFrame([], "x string, y int")}
    manifest = release.write(tables, str(tmp_path), "r1", {"kind": "monthly_update"})
    back, read = release.read(spark, str(tmp_path), "r1")
    assert read == manifest and manifest["tables"]["empty"]["row_count"] == 0 and back["empty"].columns == ["x", "y"] and back["a"].count() == 5
    with pytest.raises(FileExistsError):
        release.write(tables, str(tmp_path), "r1")


def test_certification():
    good = {"match_winner_integrity": [], "player_status_distribution": [{"pct_point_drift": 1.0}]}
    assert certify.assess(good, required=()) ["decision"] == "PASS"
    bad = good | {"match_winner_integrity": [{"match_id": 1}], "player_status_distribution": [{"pct_point_drift": 6.0}]}
    out = certify.assess(bad, required=())
    assert out["decision"] == "FAIL" and out["blockers"] == ["match_winner_integrity"] and out["pillars"]["operational_realism"]["score"] == 90.0
    assert "FAIL" in certify.report(out)


def test_run_time_reports(spark):
    ts = dt.datetime(2025, 1, 1)
    rows = [(1, 1, 1, "matches", "planning", "completed", ts, 2000, 10, 40), (2, 1, 2, "matches", "planning", "failed", ts, 3000, 10, 30), (3, 1, 1, "matches", "scoring", "completed", ts, 1000, 5, 0)]
    t = {"generation_runtime_metrics": spark.createDataFrame(rows, "id long, generation_run_id long, batch_id long, stage_name string, subphase_name string, event_type string, started_at timestamp_ntz, elapsed_ms long, output_count long, attempt_count long")}
    assert {(r["batch_id"], r["subphase_name"]): r["metric_status"] for r in reports.gaps(t, "matches", ["planning", "scoring"]).collect()} == {(2, "scoring"): "missing", (2, "planning"): "failed"}
    assert {r["batch_id"]: (r["total_seconds"], r["multiple_of_first"]) for r in reports.slow_down(t, "matches").collect()} == {1: (3.0, 1.0), 2: (3.0, 1.0)}
    assert {r["subphase_name"]: r["pct_of_stage"] for r in reports.subphase_totals(t).collect()} == {"planning": 83.33, "scoring": 16.67}
    assert reports.slowest(t, 1).first()["id"] == 2 and reports.throughput(t).count() == 2
    assert reports.batch_summary(t, "matches", {"planning": ["planning"]}).where("batch_id = 1").first()["planning_seconds"] == 2.0


def test_players_come_from_their_cohorts(spark):
    regions = spark.createDataFrame([(1, "US", "CA", 0.75), (2, "CA", "ON", 0.25)], "region_id long, country_code string, state_province_code string, selection_probability double")
    first = spark.createDataFrame([(c, s, y, g, f"{s}{g}{y}", 5) for c, s in (("US", "CA"), ("CA", "ON")) for g in "MF" for y in (1950, 2000)], "country_code string, state_province_code string, birth_year int, gender string, first_name string, frequency_count int")
    last = spark.createDataFrame([("US", "CA", "Lee", 1.0), ("CA", "ON", "Roy", 1.0)], "country_code string, state_province_code string, last_name string, normalized_probability double")
    made = sampling.players(spark, 400, "s", regions, first, last, "2025-01-01")
    rows = made.collect()
    assert len(rows) == 400 and sorted(rows) == sorted(sampling.players(spark, 400, "s", regions, first, last, "2025-01-01").collect())
    assert 250 < sum(r["region_id"] == 1 for r in rows) < 350
    for r in rows:
        year = 1950 if r["birth_date"].year <= 1975 else 2000
        assert r["first_name"] == f"{r['state_province_code']}{r['gender']}{year}" and r["last_name"] == {"CA": "Lee", "ON": "Roy"}[r["state_province_code"]]
        assert 800 <= r["initial_rating"] < 2200 or r["initial_rating"] >= 4000


def test_pairs_keep_their_ids_and_new_ones_leave_no_gap(spark):
    known = spark.createDataFrame([(7, 1, 2)], "team_id long, low_id long, high_id long")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (1, 3), (5, 4)], "a long, b long")
    got = {(r["low_id"], r["high_id"]): (r["team_id"], r["is_new"]) for r in sampling.pair_ids(pairs, known, "a", "b").collect()}
    assert got[1, 2] == (7, False) and {got[1, 3][0], got[4, 5][0]} == {8, 9} and len(got) == 3


def test_team_lifecycle(spark):
    members = spark.createDataFrame([(1, "ACTIVE"), (1, "INJURED"), (2, "RETIRED"), (2, "INJURED"), (3, "ACTIVE")], "team_id long, player_status string")
    before = spark.createDataFrame([(1, "active"), (2, "active"), (3, "dormant")], "team_id long, team_status string")
    got = {r["team_id"]: r["event_type"] for r in sampling.lifecycle_events(sampling.team_status(members), before, "2025-02-01").collect()}
    assert got == {1: "dormant", 2: "retired", 3: "reactivated"}


def test_panel_models(spark):
    steps = spark.createDataFrame([(1, 40.0, 100.0), (1, 60.0, 50.0), (2, 100.0, 100.0)], "job_id long, weight_pct double, done_pct double")
    assert {r["job_id"]: (r["progress_pct"], r["done"]) for r in panel.job_progress(steps).collect()} == {1: (70.0, False), 2: (100.0, True)}
    t0 = dt.datetime(2025, 1, 1)
    beats = spark.createDataFrame([(1, t0), (1, t0 + dt.timedelta(seconds=50)), (2, t0)], "job_id long, heartbeat_at timestamp_ntz")
    now = F.lit(t0 + dt.timedelta(seconds=60)).cast("timestamp_ntz")
    assert {r["job_id"]: (r["silent_seconds"], r["state"]) for r in panel.liveness(beats, now, 30, 60).collect()} == {1: (10, "running"), 2: (60, "dead")}
    sizes = spark.createDataFrame([("players", 100)], "table_name string, rows long")
    assert [r["rows"] for r in panel.forecast(sizes, 2, 0.1).orderBy("month").collect()] == [100, 110, 121]
