"""Rating expressions and the ordered rating fold of each player."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

D3, D4 = "decimal(8,3)", "decimal(8,4)"


@dataclass(frozen=True)
class RatingRules:
    """K-factors by experience and level, the range of ratings, growth of confidence."""

    k_new: float = 48.0
    k_established: float = 24.0
    k_elite: float = 16.0
    elite_from: float = 4000.0
    new_below: int = 10
    low: float = 0.0
    high: float = 5000.0
    confidence_step: float = 0.02
    confidence_max: float = 1.0


def win_probability(one: Column, two: Column) -> Column:
    """Elo expectation of the first side, to four places."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (two - one).cast("double") / 400.0)), 4)


def competitiveness(probability: Column) -> Column:
    """1 for even sides, 0 for a certain win."""
    return F.round(F.lit(1.0) - F.abs(probability - 0.5) * 2, 3)


def clamped_sum(rows: DataFrame, key: str, order: Sequence[str], value: str, low: float, high: float, start: float, name: str = "state") -> DataFrame:
    """key, name, steps: the values added one after the other, held within [low, high] at each step.

    Keys with at most 2**RUN_BITS rows are folded in one array each. A step maps x to min(h, max(l,
    x + d)), and so does a run of steps, so runs of larger keys are folded each
    for itself and then composed in order: rows are dealt by ranges of (key, order, value), runs
    of at most 2**RUN_BITS rows are folded, then the runs of a range, then the ranges of a key. No
    array holds all rows of such a key. The first run of a key starts at ``start`` itself. Which
    keys are large one count by key says; it is made when the plan is.
    """
    low, high = F.lit(float(low)), F.lit(float(high))
    large = rows.groupBy(F.col(key).alias("__large")).agg(F.count("*").alias("__n")).where(F.col("__n") > 1 << RUN_BITS).select("__large")
    if large.isEmpty():
        return _whole(rows, key, order, value, low, high, start, name)
    same = rows[key].eqNullSafe(F.col("__large"))
    small = _whole(rows.join(large, same, "left_anti"), key, order, value, low, high, start, name)
    rows = rows.join(large, same, "left_semi")
    dealt = rows.select(F.col(key), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("s"))
    sorted_by = [key, *[f"__o{i}" for i in range(len(order))], "s"]
    dealt = dealt.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by).withColumn("at", F.monotonically_increasing_id())
    runs = dealt.select(key, "at", low.alias("l"), high.alias("h"), "s", F.least(high, F.greatest(low, F.lit(float(start)) + F.col("s"))).alias("f"), F.lit(1).cast("long").alias("n"))
    for bits in (RUN_BITS, RANGE_BITS - RUN_BITS, None):
        runs = _composed(runs, key, bits)
    return small.unionByName(runs.select(key, F.col("f").alias(name), F.col("n").alias("steps")))


def _whole(rows: DataFrame, key: str, order: Sequence[str], value: str, low: Column, high: Column, start: float, name: str) -> DataFrame:
    """``clamped_sum`` of keys whose rows an array can hold."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__d"))))
    kept = rows.groupBy(key).agg(items.alias("items"), F.count("*").alias("steps"))
    folded = F.aggregate("items", F.lit(float(start)), lambda x, e: F.least(high, F.greatest(low, x + e["__d"])))
    return kept.select(key, folded.alias(name), "steps")


RUN_BITS = 13  # of the rows that one array holds
RANGE_BITS = 33  # of a row's number in its range: monotonically_increasing_id has the range above them


def _composed(runs: DataFrame, key: str, bits: int | None) -> DataFrame:
    """Runs of one ``at >> bits`` (of the whole key for None) as one: key, at, l, h, s, f, n.

    A run maps x to min(h, max(l, x + s)); ``f`` is where it ends as the key's first run.
    """
    group = F.lit(0).cast("long") if bits is None else F.shiftright("at", bits)
    items = F.array_sort(F.collect_list(F.struct("at", "l", "h", "s", "f")))
    rows = runs.groupBy(key, group.alias("at")).agg(items.alias("items"), F.sum("n").alias("n"))
    first = F.element_at("items", 1)

    def step(x: Column, e: Column) -> Column:
        to = lambda v: F.least(e["h"], F.greatest(e["l"], v + e["s"]))
        return F.struct(to(x["l"]).alias("l"), to(x["h"]).alias("h"), (x["s"] + e["s"]).alias("s"), to(x["f"]).alias("f"))

    begin = F.struct(*[first[c].alias(c) for c in ("l", "h", "s", "f")])
    rest = F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0)))
    return rows.select(key, "at", F.aggregate(rest, begin, step).alias("x"), "n").select(key, "at", "x.l", "x.h", "x.s", "x.f", "n")


def fold(updates: DataFrame, states: DataFrame, rules: RatingRules = RatingRules()) -> DataFrame:
    """One row for each update with what it changed.

    ``updates``: player_id, match_date, match_id, expected_score_share, actual_score_share.
    ``states``: player_id, rating, confidence (null stays null), match_count before them. A
    player's updates are taken by (match_date, match_id); players do not depend on each other.
    Ratings are decimals of three places at every step, rounded half up. A player's matches
    are one array, as many as one person plays.
    """
    dec = lambda c, t=D3: F.round(c, int(t[-2])).cast(t)
    lit = lambda x: F.lit(x).cast(D3)
    items = F.array_sort(F.collect_list(F.struct("match_date", "match_id", F.col("expected_score_share").cast(D4).alias("e"), F.col("actual_score_share").cast(D4).alias("a"))))
    rows = updates.groupBy("player_id").agg(items.alias("items")).join(states, "player_id")
    shape = "array<struct<match_date:date,match_id:bigint,k_factor:decimal(8,3),rating_before:decimal(8,3),rating_delta:decimal(8,3),rating_after:decimal(8,3),confidence_before:decimal(8,3),confidence_after:decimal(8,3),match_count:bigint>>"
    start = F.struct(F.col("rating").cast(D3).alias("r"), F.col("confidence").cast(D3).alias("c"), F.col("match_count").cast("long").alias("n"), F.array().cast(shape).alias("out"))

    def step(s: Column, x: Column) -> Column:
        k = F.when(s["r"] >= lit(rules.elite_from), lit(rules.k_elite)).when(s["n"] < rules.new_below, lit(rules.k_new)).otherwise(lit(rules.k_established))
        after = dec(F.greatest(lit(rules.low), F.least(lit(rules.high), s["r"] + dec(k * (x["a"] - x["e"])))))
        sure = F.when(s["c"].isNotNull(), dec(F.least(lit(rules.confidence_max), s["c"] + lit(rules.confidence_step))))
        row = F.struct(x["match_date"].alias("match_date"), x["match_id"].cast("long").alias("match_id"), k.alias("k_factor"), s["r"].alias("rating_before"), dec(after - s["r"]).alias("rating_delta"), after.alias("rating_after"), s["c"].alias("confidence_before"), sure.alias("confidence_after"), (s["n"] + 1).alias("match_count"))
        return F.struct(after.alias("r"), sure.alias("c"), (s["n"] + 1).alias("n"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = rows.select("player_id", F.explode(F.aggregate("items", start, step)["out"]).alias("u"))
    return folded.select("player_id", "u.*")


@dataclass(frozen=True)
class Bias:
    """Hidden influences on a match, in rating points; the caps are symmetric unless named."""

    # The defaults of the configuration that results must agree with.
    points_per_year: float = 1.25
    age_cap: float = 35.0
    age_close_from: float = 0.75
    age_close_times: float = 1.5
    points_per_game: float = 2.0
    fatigue_cap: float = 25.0
    recovery_days: int = 3
    region_cap: float = 20.0
    same_club: float = 5.0
    together: tuple[tuple[int, float], ...] = ((10, 8.0), (25, 12.0))
    never_together: float = -10.0
    recently_together: float = 5.0
    affinity_cap: float = 25.0
    log_points: float = 2.0
    experience_cap: float = 15.0
    experience_close_from: float = 0.75
    experience_close_times: float = 1.25
    total_cap: float = 50.0


def _held(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hidden_adjustment(side: str, other: str, rules: Bias = Bias()) -> dict[str, Column]:
    """The factors and their capped total for one side, from columns ``<side>_...``.

    Columns: age, recent_games, days_rest, region_strength, shared_club, prior_matches,
    recent_matches for both sides, and competitiveness.
    """
    c = lambda name, s=side: F.col(f"{s}_{name}")
    close = lambda least, times: F.when(F.col("competitiveness") >= least, times).otherwise(1.0)
    age = F.coalesce(_held((c("age", other) - c("age")) * rules.points_per_year * close(rules.age_close_from, rules.age_close_times), -rules.age_cap, rules.age_cap), F.lit(0.0))
    tired = _held(F.coalesce(c("recent_games"), F.lit(0)) * rules.points_per_game, 0.0, rules.fatigue_cap)
    fatigue = F.when(c("days_rest") >= rules.recovery_days, 0.0).otherwise(-tired)
    strength = lambda s: F.coalesce(c("region_strength", s), F.lit(0.0))
    region = _held(strength(side) - strength(other), -rules.region_cap, rules.region_cap)
    prior = F.coalesce(c("prior_matches"), F.lit(0))
    together = F.when(prior == 0, rules.never_together)
    for least, points in sorted(rules.together):
        together = F.when(prior >= least, points).otherwise(together)
    affinity = _held(F.when(c("shared_club"), rules.same_club).otherwise(0.0) + F.coalesce(together, F.lit(0.0)) + F.when(c("recent_matches") > 0, rules.recently_together).otherwise(0.0), -rules.affinity_cap, rules.affinity_cap)
    experience = _held(F.log1p(F.greatest(prior, F.lit(0)).cast("double")) * rules.log_points * close(rules.experience_close_from, rules.experience_close_times), 0.0, rules.experience_cap)
    parts = {"age": age, "fatigue": fatigue, "region": region, "affinity": affinity, "experience": experience}
    return parts | {"total": _held(sum(parts.values(), F.lit(0.0)), -rules.total_cap, rules.total_cap)}


def adjusted_chances(rows: DataFrame, rules: Bias = Bias(), apply: bool = True) -> DataFrame:
    """Adds visible_chance, competitiveness, one_effective, two_effective, chance of side one.

    ``rows`` has one_rating, two_rating and what ``hidden_adjustment`` asks for. Without ``apply`` the
    chance is the visible one and the ratings count as they are.
    """
    visible = win_probability(F.col("one_rating"), F.col("two_rating"))
    rows = rows.withColumn("visible_chance", visible).withColumn("competitiveness", competitiveness(F.col("visible_chance")))
    for me, other in (("one", "two"), ("two", "one")):
        more = hidden_adjustment(me, other, rules)["total"] if apply else F.lit(0.0)
        rows = rows.withColumn(f"{me}_effective", F.col(f"{me}_rating") + more)
    return rows.withColumn("chance", win_probability(F.col("one_effective"), F.col("two_effective")))
