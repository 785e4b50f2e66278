"""Audit results to findings, pillar scores and a decision."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Penalties, thresholds of the decision, and of the rules below.
PENALTY = {"ok": 0, "warning": 10, "error": 25, "blocker": 25}
RANK = ("ok", "warning", "error", "blocker")
PASS_FROM, FAIL_BELOW = 95.0, 80.0
PILLARS = ("structural_integrity", "operational_realism", "simulation_fidelity", "assignment_readiness", "export_readiness", "historical_regression")


@dataclass(frozen=True)
class Rule:
    """Above ``warning`` or ``error`` (or below, where ``low``) a measure is a finding.

    A measure may be null: then there is no finding.
    """

    query: str
    pillar: str
    measure: Measure
    warning: float | None = None
    error: float | None = None
    low: bool = False
    blocks: bool = False

    def severity(self, rows: Sequence[Mapping]) -> tuple[str, float | None]:
        value = self.measure(rows)
        if value is None:
            return "ok", None
        beyond = (lambda limit: limit is not None and value < limit) if self.low else (lambda limit: limit is not None and value >= limit)
        found = "error" if beyond(self.error) else "warning" if beyond(self.warning) else "ok"
        return ("blocker" if found == "error" and self.blocks else found), value


@dataclass(frozen=True)
class Measure:
    """A number of a result: from collected rows, or as an aggregate of a DataFrame with these columns."""

    of_rows: Callable[[Sequence[Mapping]], float | None]
    column: Callable[[Sequence[str]], Column]

    def __call__(self, rows: Sequence[Mapping]) -> float | None:
        return self.of_rows(rows)


def _values(rows: Sequence[Mapping], *columns: str) -> list[float]:
    return [float(r[c]) for r in rows for c in columns if r.get(c) is not None]


def _number(column: str) -> Column:
    return F.col(column).cast("double")


def most(*columns: str) -> Measure:
    """The largest absolute value of some columns, null where they have none."""
    each = lambda _: [F.max(F.abs(_number(c))) for c in columns]
    return Measure(lambda rows: max(map(abs, _values(rows, *columns)), default=None), lambda names: F.greatest(*each(names)) if len(columns) > 1 else each(names)[0])


def least(column: str) -> Measure:
    return Measure(lambda rows: min(_values(rows, column), default=None), lambda _: F.min(_number(column)))


def spread(column: str) -> Measure:
    def measure(rows):
        values = _values(rows, column)
        return max(values) - min(values) if len(values) > 1 else None

    return Measure(measure, lambda _: F.when(F.count(column) > 1, F.max(_number(column)) - F.min(_number(column))))


def share_of(column: str, share: str, holds: Callable, condition: str) -> Measure:
    """The sum of ``share`` over the rows for which ``holds``, in SQL the ``condition``; null over no rows."""
    total = lambda _: F.when(F.count("*") > 0, F.sum(F.when(F.expr(condition), F.coalesce(_number(share), F.lit(0.0))).otherwise(0.0)))
    return Measure(lambda rows: sum(float(r[share]) for r in rows if r.get(share) is not None and holds(r[column])) if rows else None, total)


def gap(band: str, low: str, high: str, column: str) -> Measure:
    """A column's value in the high band less that in the low one, null where one is missing."""

    def measure(rows):
        at = {str(r[band]): float(r[column]) for r in rows if r.get(column) is not None}
        return at[high] - at[low] if low in at and high in at else None

    at = lambda name: F.max(F.when(F.col(band).cast("string") == name, _number(column)))
    return Measure(measure, lambda _: at(high) - at(low))


count = Measure(lambda rows: float(len(rows)), lambda _: F.count("*").cast("double"))


def rows_where(holds: Callable[[Mapping], bool], condition: str) -> Measure:
    """How many rows there are for which ``holds``, in SQL the ``condition``."""
    return Measure(lambda rows: float(sum(map(bool, map(holds, rows)))), lambda _: F.count_if(F.expr(condition)).cast("double"))


def lacks(column: str) -> Measure:
    """1 if no row has a value in the column."""
    return Measure(lambda rows: float(not _values(rows, column)), lambda _: (F.count(column) == 0).cast("double"))


def _drift(rows):
    found = [abs(float(v)) for r in rows for k, v in r.items() if k.endswith("pct_point_drift") and v is not None]
    return max(found, default=None)


def _drift_column(names: Sequence[str]) -> Column:
    found = [F.max(F.abs(_number(c))) for c in names if c.endswith("pct_point_drift")]
    return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("double")


#: The largest absolute drift of any column that reports one.
drift = Measure(_drift, _drift_column)


def _single(rows):
    once = [float(r["partnership_pct"]) for r in rows if r["repeat_match_count"] == 1]
    return once[0] if once and not any(r["repeat_match_count"] > 1 for r in rows) else None


#: The share of partnerships that met once, where none met again.
single_partnerships = Measure(_single, lambda _: F.when(F.count_if(F.col("repeat_match_count") > 1) == 0, F.max(F.when(F.col("repeat_match_count") == 1, _number("partnership_pct")))))

#: What share of players is expected on teams, and of those on competitive ones.
ON_TEAMS, COMPETITIVE = 0.90, 0.20


def shortfall(target: float = ON_TEAMS * COMPETITIVE) -> Measure:
    """How many points the share of players who were ever on a competitive team is below the target."""

    def measure(rows):
        players, ever = max(_values(rows, "player_count"), default=0.0), max(_values(rows, "ever_teamed_player_count"), default=0.0)
        return max(0.0, (target - (ever / players if players else 0.0)) * 100)

    top = lambda c: F.coalesce(F.max(_number(c)), F.lit(0.0))
    return Measure(measure, lambda _: F.greatest(F.lit(0.0), (F.lit(target) - F.coalesce(F.try_divide(top("ever_teamed_player_count"), top("player_count")), F.lit(0.0))) * 100))


_S, _O, _F, _A, _E, _H = PILLARS
RULES: tuple[Rule, ...] = (
    *[Rule(q, _O, drift, 5, 10) for q in ("player_status_distribution", "player_gender_distribution", "player_age_distribution", "player_region_distribution", "match_type_distribution", "club_membership_summary")],
    Rule("weekend_match_share", _O, most("outside_config_range"), 1),
    Rule("club_fill_ratio_summary", _O, most("over_capacity_club_count"), 1),
    Rule("player_name_uniqueness_summary", _O, most("max_full_name_player_pct"), 1),
    # The share over all buckets, the missing one among them, is what is measured: always 100.
    *[Rule(q, _O, share_of("alignment_bucket", "player_pct", lambda b: "reference" in b or "exact" in b or "other" in b, "instr(alignment_bucket, 'reference') > 0 or instr(alignment_bucket, 'exact') > 0 or instr(alignment_bucket, 'other') > 0"), 90, low=True) for q in ("player_first_name_alignment", "player_last_name_alignment")],
    Rule("team_assignment_delay_summary", _A, most("avg_days_to_first_team"), 30),
    Rule("team_assignment_delay_summary", _A, shortfall(), 10, 20),
    Rule("chemistry_effectiveness", _F, most("win_rate_minus_expected"), 0.25, 0.40),
    Rule("rating_predictiveness", _F, least("favorite_win_rate"), 0.65, 0.55, low=True),
    Rule("regional_strength_balance", _F, spread("avg_rating"), 400, 700),
    Rule("fatigue_effectiveness", _F, gap("workload_band", "0", "2_plus", "avg_score_share_delta"), 0.05, 0.10),
    Rule("confidence_stability", _F, gap("confidence_band", "0_24", "75_plus", "avg_abs_rating_delta"), 5, 15),
    Rule("volatility_decay", _F, gap("experience_band", "0_4", "10_plus", "avg_volatility_score"), 0.01, 0.05),
    Rule("team_dissolution_rate", _F, most("event_pct_of_formed_teams"), 50, 75),
    Rule("repeat_partner_frequency", _F, single_partnerships, 80),
    Rule("repeat_opponent_rate", _F, share_of("meeting_count", "matchup_pair_pct", lambda n: n >= 3, "meeting_count >= 3"), 20, 40),
    Rule("candidate_depth_by_country_division", _A, least("candidate_team_count"), 2, 1, low=True),
    Rule("alternate_candidate_depth", _A, least("alternate_team_count"), 2, 1, low=True),
    Rule("elite_player_depth", _A, least("elite_player_count"), 1, low=True),
    Rule("elite_team_depth", _A, least("elite_team_count"), 1, low=True),
    Rule("student_candidate_availability", _A, least("fully_rated_team_pct"), 100, low=True),
    Rule("division_balance", _A, most("team_pct_within_country"), 85, 95),
    Rule("missing_gold_inputs", _E, most("missing_flag"), None, 1, blocks=True),
    Rule("historical_run_size_regression", _H, most("player_growth_pct", "team_growth_pct", "match_growth_pct"), 25, 50),
    Rule("historical_baseline_scale_regression", _H, lacks("baseline_generation_run_id"), 1),
    Rule("historical_baseline_scale_regression", _H, most("player_delta_vs_baseline_pct", "team_delta_vs_baseline_pct", "match_delta_vs_baseline_pct"), 20, 35),
    Rule("historical_baseline_scale_regression", _H, most("player_delta_vs_trend_pct", "team_delta_vs_trend_pct", "match_delta_vs_trend_pct"), 15, 25),
    Rule("historical_release_file_coverage", _H, rows_where(lambda r: r["status"] != "succeeded" or r["file_count"] <= 0 or r["total_row_count"] <= 0, "status <> 'succeeded' or file_count <= 0 or total_row_count <= 0"), None, 1),
    Rule("rating_delta_summary", _F, most("large_delta_pct"), 1, 5),
    Rule("rating_outlier_players", _F, most("max_abs_rating_delta"), 250),
    *[Rule(q, _S, count, None, 1, blocks=True) for q in ("team_current_roster_integrity", "team_membership_date_integrity", "match_winner_integrity", "match_game_score_integrity", "daily_team_match_cap_violations")],
)

#: Warning and error of queries where a hidden bias is at work.
BIASED = {
    "partnership_affinity": {"chemistry_effectiveness": (0.35, 0.50)},
    "fatigue": {"fatigue_effectiveness": (0.03, 0.07)},
    "hidden": {"rating_predictiveness": (0.60, 0.50)},
    "regional_strength": {"regional_strength_balance": (550, 850)},
}


def with_biases(biases: Collection[str], rules: Iterable[Rule] = RULES) -> tuple[Rule, ...]:
    """The rules with the thresholds of a run that has these biases."""
    limits = {q: pair for b in biases for q, pair in BIASED[b].items()}
    return tuple(replace(r, warning=limits[r.query][0], error=limits[r.query][1]) if r.query in limits else r for r in rules)


def compared(now: Mapping, before: Mapping) -> dict:
    """What has become worse or better since an earlier assessment: scores, and severities by query."""
    worst = lambda a: {f["query"]: max((g["severity"] for g in a["findings"] if g["query"] == f["query"]), key=RANK.index) for f in a["findings"]}
    new, old = worst(now), worst(before)
    rank = lambda found, q: RANK.index(found.get(q, "ok"))
    every = sorted(new.keys() | old.keys())
    return {
        "overall": round(now["overall"] - before["overall"], 1),
        "pillars": {p: round(s["score"] - before["pillars"][p]["score"], 1) for p, s in now["pillars"].items() if p in before["pillars"]},
        "worse": [q for q in every if rank(new, q) > rank(old, q)],
        "better": [q for q in every if rank(new, q) < rank(old, q)],
    }


def snapshot(assessment: Mapping, month: str) -> str:
    """The assessment as JSON, to be kept and compared with later ones."""
    return json.dumps({"month": month} | dict(assessment), sort_keys=True, default=str)


def assess(results: Mapping[str, Sequence[Mapping]], rules: Iterable[Rule] = RULES, required: Sequence[str] = PILLARS) -> dict:
    """Findings, pillar scores, the overall score and the decision.

    ``results`` holds the collected rows of audit queries, at most some hundred each. A query's
    severity is the worst of its rules; a pillar's score 100 less the mean penalty of its
    queries; the overall score weighs pillars by their queries. It passes from 95 on without
    blockers and with all required pillars, and fails below 80 or with a blocker.
    """
    worst: dict[tuple[str, str], str] = {}
    findings = []
    for rule in rules:
        if rule.query not in results:
            continue
        severity, value = rule.severity(results[rule.query])
        key = (rule.pillar, rule.query)
        worst[key] = max(worst.get(key, "ok"), severity, key=RANK.index)
        if severity != "ok":
            findings.append({"query": rule.query, "pillar": rule.pillar, "severity": severity, "value": value})
    scores = {}
    for pillar in PILLARS:
        penalties = [PENALTY[s] for (p, _), s in worst.items() if p == pillar]
        if penalties:
            scores[pillar] = {"queries": len(penalties), "score": round(100 - sum(penalties) / len(penalties), 1)}
    n = sum(s["queries"] for s in scores.values())
    overall = round(sum(s["score"] * s["queries"] for s in scores.values()) / n, 1) if n else 0.0
    blocked = [f["query"] for f in findings if f["severity"] == "blocker"]
    missing = [p for p in required if p not in scores]
    decision = "FAIL" if blocked or overall < FAIL_BELOW else "PASS" if overall >= PASS_FROM and not missing else "REVIEW"
    return {"findings": findings, "pillars": scores, "overall": overall, "blockers": blocked, "missing_pillars": missing, "decision": decision}


def measured(results: Mapping[str, DataFrame], rules: Sequence[Rule] = RULES) -> DataFrame:
    """rule (its place in ``rules``), query, pillar, value: each rule's measure, one aggregate for each result."""
    out = []
    for query, rows in results.items():
        mine = [(i, r) for i, r in enumerate(rules) if r.query == query]
        if mine:
            values = rows.agg(F.array(*[r.measure.column(rows.columns).cast("double") for _, r in mine]).alias("v"))
            each = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.query).alias("query"), F.lit(r.pillar).alias("pillar"), F.col("v")[k].alias("value")) for k, (i, r) in enumerate(mine)])
            out.append(values.select(F.explode(each).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, out)


def thresholds(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rules' limits as a table: as many rows as there are rules."""
    rows = [(i, None if r.warning is None else float(r.warning), None if r.error is None else float(r.error), r.low, r.blocks) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, warning double, error double, low boolean, blocks boolean")


def decided(measures: DataFrame, limits: DataFrame, required: Sequence[str] = PILLARS) -> DataFrame:
    """kind, name, pillar, severity, queries, score, decision: ``assess`` as a plan.

    A row for each query with its worst severity, for each pillar with its score, and one for all.
    """
    beyond = lambda limit: F.coalesce(F.when(F.col("low"), F.col("value") < F.col(limit)).otherwise(F.col("value") >= F.col(limit)), F.lit(False))
    rank = F.when(beyond("error"), F.when(F.col("blocks"), 3).otherwise(2)).when(beyond("warning"), 1).otherwise(0)
    worst = measures.join(F.broadcast(limits), "rule").groupBy("pillar", "query").agg(F.max(rank).alias("rank"))
    named = F.element_at(F.array(*map(F.lit, RANK)), F.col("rank") + 1)
    penalty = F.element_at(F.array(*[F.lit(PENALTY[x]) for x in RANK]), F.col("rank") + 1)
    pillars = worst.groupBy("pillar").agg(F.count("*").alias("queries"), F.bround(100 - F.sum(penalty) / F.count("*"), 1).alias("score"), F.max("rank").alias("rank"))
    overall = pillars.agg(F.sum("queries").alias("queries"), F.coalesce(F.bround(F.sum(F.col("score") * F.col("queries")) / F.sum("queries"), 1), F.lit(0.0)).alias("score"), F.max("rank").alias("rank"), F.collect_set("pillar").alias("found"))
    lacking = F.size(F.array_except(F.array(*map(F.lit, required)), "found")) if required else F.lit(0)
    decision = F.when((F.col("rank") == 3) | (F.col("score") < FAIL_BELOW), "FAIL").when((F.col("score") >= PASS_FROM) & (lacking == 0), "PASS").otherwise("REVIEW")
    none = F.lit(None)
    one = worst.select(F.lit("query").alias("kind"), F.col("query").alias("name"), "pillar", named.alias("severity"), F.lit(1).cast("long").alias("queries"), none.cast("double").alias("score"), none.cast("string").alias("decision"))
    two = pillars.select(F.lit("pillar").alias("kind"), F.col("pillar").alias("name"), "pillar", named.alias("severity"), "queries", "score", none.cast("string").alias("decision"))
    three = overall.select(F.lit("overall").alias("kind"), F.lit("all").alias("name"), none.cast("string").alias("pillar"), named.alias("severity"), "queries", "score", decision.alias("decision"))
    return one.unionByName(two).unionByName(three)


def report(assessment: Mapping) -> str:
    """The assessment as Markdown."""
    lines = [f"# Certification: {assessment['decision']}", "", f"Overall score {assessment['overall']}.", "", "| pillar | queries | score |", "|---|---|---|"]
    lines += [f"| {p} | {s['queries']} | {s['score']} |" for p, s in assessment["pillars"].items()]
    lines += ["", "| query | severity | value |", "|---|---|---|"] + [f"| {f['query']} | {f['severity']} | {f['value']} |" for f in assessment["findings"]]
    return "\n".join(lines) + "\n"
