"""Certification as a plan against the one over collected rows; clubs against their definition; winners; ratings."""

from datetime import date
from decimal import ROUND_HALF_EVEN, Decimal
from hashlib import sha256

import pytest

from ledgerline.operators import clubs
from ledgerline.plans import audit, certify, certify_bindings, domain, snapshots

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_the_plan_decides_as_the_rows_do(spark):
    t = domain.tables(spark, SF)
    results = {q: audit.CATALOGUE[q].run(t, audit.DEFAULTS) for q in certify_bindings.MEASURES}
    want = certify.assess({q: rows_of(df) for q, df in results.items()}, certify_bindings.RULES)
    got = rows_of(certify_bindings.QUERIES["certification"](spark, SF))
    overall = next(r for r in got if r["kind"] == "overall")
    assert (overall["score"], overall["decision"]) == (want["overall"], want["decision"])
    assert {r["name"]: (r["queries"], r["score"]) for r in got if r["kind"] == "pillar"} == {p: (s["queries"], s["score"]) for p, s in want["pillars"].items()}
    worst = {f["query"]: max((g["severity"] for g in want["findings"] if g["query"] == f["query"]), key=certify.RANK.index) for f in want["findings"]}
    assert {r["name"]: r["severity"] for r in got if r["kind"] == "query"} == {q: worst.get(q, "ok") for q in certify_bindings.MEASURES}


CASES = {
    "repeat_partner_frequency": ("repeat_match_count int, partnership_pct double", [([(1, 85.0)], "warning"), ([(1, 85.0), (2, 15.0)], "ok"), ([(1, 79.0)], "ok"), ([], "ok")]),
    "elite_player_depth": ("elite_player_count int", [([(0,), (4,)], "warning"), ([(1,)], "ok")]),
    "team_assignment_delay_summary": ("player_count int, ever_teamed_player_count int, avg_days_to_first_team double", [([(100, 18, 1.0)], "ok"), ([(100, 8, 1.0)], "warning"), ([(100, 0, 1.0)], "warning"), ([(100, 18, 31.0)], "warning"), ([(0, 0, None)], "warning")]),
    "historical_run_size_regression": ("player_growth_pct double, team_growth_pct double, match_growth_pct double", [([(1.0, -51.0, None)], "error"), ([(1.0, 2.0, 30.0)], "warning"), ([(None, None, None)], "ok")]),
    "historical_baseline_scale_regression": ("baseline_generation_run_id int, player_delta_vs_baseline_pct double, team_delta_vs_baseline_pct double, match_delta_vs_baseline_pct double, player_delta_vs_trend_pct double, team_delta_vs_trend_pct double, match_delta_vs_trend_pct double", [([(None,) * 7], "warning"), ([(1, 1.0, 1.0, 1.0, 1.0, 1.0, 26.0)], "error"), ([(1, 1.0, 1.0, 21.0, 1.0, 1.0, 1.0)], "warning"), ([(1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "ok"), ([], "warning")]),
    "historical_release_file_coverage": ("status string, file_count int, total_row_count int", [([("succeeded", 1, 1)], "ok"), ([("failed", 1, 1)], "error"), ([("succeeded", 0, 1)], "error"), ([("succeeded", 1, 0)], "error")]),
    "regional_strength_balance": ("avg_rating double", [([(1.0,)], "ok"), ([(1.0,), (500.0,)], "warning")]),
    "fatigue_effectiveness": ("workload_band string, avg_score_share_delta double", [([("0", 0.0), ("2_plus", 0.2)], "error"), ([("0", 0.0)], "ok")]),
    "match_winner_integrity": ("match_id int", [([], "ok"), ([(1,)], "blocker")]),
}


@pytest.mark.parametrize("query", CASES)
def test_measures_of_rows_and_of_plans(spark, query):
    shape, cases = CASES[query]
    rules = [r for r in certify.RULES if r.query == query]
    limits = certify.thresholds(spark, rules)
    for rows, want in cases:
        df = spark.createDataFrame(rows, shape)
        found = max((r.severity(rows_of(df))[0] for r in rules), key=certify.RANK.index)
        plan = certify.decided(certify.measured({query: df}, rules), limits, ()).where("kind = 'query'").first()["severity"]
        assert found == plan == want, rows


def test_biases_swap_limits_in_the_plan(spark):
    df = spark.createDataFrame([("50_59", 0.62)], "band string, favorite_win_rate double")
    for rules, want in ((certify.RULES, "warning"), (certify.with_biases(["hidden"]), "ok")):
        mine = [r for r in rules if r.query == "rating_predictiveness"]
        assert certify.decided(certify.measured({"rating_predictiveness": df}, mine), certify.thresholds(spark, mine), ()).where("kind = 'query'").first()["severity"] == want


# --- clubs ------------------------------------------------------------------------------


def h(text):
    return int(sha256(text.encode()).hexdigest()[:16], 16)


def clubs_by_hand(targets, names, regions):
    out = []
    for (country, state), n in targets.items():
        mine = sorted(r for r in names if r[:2] == (country, state))
        there = sorted((r for r in regions if r[1:3] == (country, state)), key=lambda r: (r[3], r[0]))
        mega = {r[0] for r in sorted((x for x in regions if x[1] == country and x[4] > 0), key=lambda r: (-r[4], r[3]))[:10]}
        weights = [Decimal(r[5] or 0) for r in there]
        weights = weights if sum(weights) > 0 else [Decimal(1)] * len(there)
        for i in range(n if there else 0):
            _, _, seed, name, kind, size = mine[i] if i < len(mine) else (country, state, h(f"placeholder|{country}|{state}|{i}"), f"Not Enough Club Names {state}-{i + 1}", "Community Recreation Club", "Tiny")
            at, total, region = Decimal(h(f"{seed}|{country}|{state}|{i}")) / Decimal(2**64) * sum(weights), Decimal(0), there[-1]
            for r, w in zip(there, weights, strict=True):
                total += w
                if at < total:
                    region = r
                    break
            size = "Large" if size == "Mega" and region[0] not in mega else size
            kept = clubs.TYPES.get(kind, "community_center")
            low, high = clubs.CAPACITY.get(size, clubs.CAPACITY["Small"])
            a, b = clubs.COURTS.get(size, clubs.COURTS["Small"])
            courts = a + h(f"courts|{seed}") % (b - a + 1)
            inside = int((courts * Decimal(clubs.INDOOR.get(kept, clubs.INDOOR_OTHERWISE))).quantize(Decimal(1), ROUND_HALF_EVEN))
            inside = min(courts, max(1, inside) if kept == "dedicated_facility" else inside)
            first, last = clubs.FOUNDED.get(kept, clubs.FOUNDED_OTHERWISE)
            first = max(1970, first - 10) if size in ("Large", "Mega") else first
            born = h(f"founding|{seed}|{kept}|{size}")
            out.append((country, state, i, name, region[0], kept, size, low + h(str(seed)) % (high - low + 1), date(first + born % (last - first + 1), 1 + born // 32 % 12, 1 + born // 512 % 28), inside, courts - inside))
    return sorted(out)


def test_clubs_by_hand(spark):
    targets = {("US", "TX"): 40, ("US", "NY"): 3, ("CA", "ON"): 5, ("US", "AK"): 0, ("MX", "JA"): 2}
    kinds, sizes = [*clubs.TYPES, "Other", None], [*clubs.CAPACITY, None]
    names = [("US", "TX", s * 977, f"T{s}", kinds[s % 11], sizes[s % 6]) for s in range(30)] + [("US", "NY", s, f"N{s}", "Social Club", "Mega") for s in range(9)]
    regions = [(i, "US", "TX", f"r{i % 5}", i * 1000 if i < 14 else 0, 0.1 * i) for i in range(1, 15)] + [(20, "US", "NY", "z", 0, 0.0), (21, "US", "NY", "y", 5, None), (30, "CA", "ON", "o", 9, 0.5), (40, "MX", "JA", "j", 9, 0.5)]
    df = [spark.createDataFrame([(*k, n) for k, n in targets.items()], "country_code string, state_province_code string, target_club_count int"), spark.createDataFrame(names, "country_code string, state_province_code string, club_seed long, club_name string, club_type string, size_tier string"), spark.createDataFrame(regions, "id long, country_code string, state_province_code string, region_name string, population long, selection_probability double")]
    got = clubs.assigned(*df).drop("competitiveness_level")
    assert sorted(map(tuple, got.collect())) == clubs_by_hand({k: n for k, n in targets.items() if k[0] != "MX"}, names, [r for r in regions if r[1] != "MX"])
    assert [tuple(r) for r in clubs.without_regions(df[0], df[2].where("country_code <> 'MX'")).collect()] == [("MX", "JA", 2)]
    assert clubs.assigned(df[0].limit(0), *df[1:]).count() == 0


# --- winners and rating states ----------------------------------------------------------


def test_winners_go_down_the_ladder(spark):
    games = {1: [(11, 5), (11, 3)], 2: [(11, 5), (3, 11), (11, 9)], 3: [(11, 5), (9, 11)], 4: [(11, 9), (9, 11)], 5: [(11, 9), (9, 11)], 6: [(11, 9), (9, 11)], 7: [], 8: []}
    chance = {4: (1, 0.7), 5: (2, 0.7), 6: (1, 0.5), 8: (None, None)}
    t = {
        "match_games": spark.createDataFrame([(m, k, a, b) for m, g in games.items() for k, (a, b) in enumerate(g)], "match_id long, game_number int, team_one_score int, team_two_score int"),
        "match_teams": spark.createDataFrame([(m, k, None if m == 8 and k == 1 else 100 * m + (3 - k if m in (6, 7) else k)) for m in games for k in (1, 2)], "match_id long, team_number int, source_team_id long"),
        "matches": spark.createDataFrame([(m, 100 * m + 1, *chance.get(m, (None, None))) for m in games], "id long, winning_team_id long, predicted_winning_team_number int, predicted_win_probability double"),
    }
    got = {r["match_id"]: (r["resolved_team_id"], r["decided_by"], r["agrees"]) for r in snapshots.resolved_winners(t).collect()}
    assert got == {1: (101, "games", True), 2: (201, "games", True), 3: (301, "points", True), 4: (401, "chance", True), 5: (502, "chance", False), 6: (601, "id", True), 7: (701, "id", True), 8: (None, "id", False)}


def test_states_include_the_batch_itself(spark):
    rows = [(1, 1, date(2020, 1, 1), "initial", 1000.0, 0.1, 1), (2, 1, date(2020, 2, 1), "match_update", 1100.0, None, 2), (3, 1, date(2020, 3, 1), "match_update", 1200.0, 0.5, 3), (4, 2, date(2020, 2, 1), "match_update", 900.0, 0.2, 2), (5, 2, date(2020, 2, 1), "match_update", 950.0, 0.3, 2)]
    t = {"player_rating_history": spark.createDataFrame(rows, "id long, player_id long, rating_date date, rating_type string, rating_value double, confidence_score double, batch_id long"), "players": spark.createDataFrame([(1,), (2,), (3,)], "id long")}
    assert {tuple(r) for r in snapshots.initial_states(t, 2).collect()} == {(1, 1100.0, None, 1), (2, 950.0, 0.3, 2), (3, 1500.0, None, 0)}
