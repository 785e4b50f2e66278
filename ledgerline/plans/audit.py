"""The audit catalogue: named queries over the domain tables, built from the operators.

Each takes ``t`` (tables by name) and ``p`` (parameters) and returns a DataFrame. Results
carry no order; ``ordinal`` columns are left to the report.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.history import active, age_years, at_each, growth, latest, look_back, spans
from ledgerline.operators.pairs import roster_keys, unordered
from ledgerline.operators.shares import bucket, distribution, histogram_of_counts, pct, ratio, with_targets

Tables = Mapping[str, DataFrame]
Params = Mapping[str, Any]

#: Defaults of the configured parameters.
DEFAULTS: dict[str, Any] = {
    "generation_run_id": 1,
    "batch_id": 3,
    "initial_rating_elite_min": 4000.0,
    "unaffiliated_player_rate": 0.25,
    "multi_club_membership_rate": 0.1,
    "max_club_fill_ratio": 0.9,
    "secondary_membership_same_region_rate": 0.8,
    "cross_region_assignment_enabled": True,
    "weekend_concentration_min": 0.4,
    "weekend_concentration_max": 0.6,
    "monthly_matches_per_active_player_mean": 4.0,
    "monthly_matches_per_active_player_std_dev": 1.5,
    "match_volume_noise_factor": 0.1,
    "max_daily_matches_per_team": 2,
    "rating_delta_warning_threshold": 250.0,
    "regional_strength_min_rated_players": 5,
    "player_status_target_pcts": {"ACTIVE": 75.0, "INJURED": 5.0, "RETIRED": 20.0},
    "gender_target_pcts": {"M": 50.0, "F": 50.0},
    "age_bucket_target_pcts": {"under_18": 10.0, "18_29": 25.0, "30_44": 25.0, "45_59": 20.0, "60_74": 15.0, "75_plus": 5.0},
    "match_type_target_pcts": {"recreational": 30.0, "league": 30.0, "tournament": 40.0},
}


@dataclass(frozen=True)
class Audit:
    name: str
    scope: str
    needs: tuple[str, ...]
    build: Callable[[Tables, Params], DataFrame]

    def run(self, tables: Tables, params: Params) -> DataFrame:
        missing = [n for n in self.needs if params.get(n) is None]
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")
        return self.build(tables, params)


CATALOGUE: dict[str, Audit] = {}
RUN, BATCH = "generation_run_id", "batch_id"


def audit(scope: str, *needs: str):
    def add(f):
        CATALOGUE[f.__name__] = Audit(f.__name__, scope, (scope, *needs), f) if scope else Audit(f.__name__, "all", needs, f)
        return f

    return add


# --- shared pieces -------------------------------------------------------------------


def ones(condition: Column) -> Column:
    """How many rows the condition holds for; null over no rows, as a SQL sum of CASE is."""
    return F.sum(F.when(condition, 1).otherwise(0))


def of_run(t: Tables, p: Params, name: str) -> DataFrame:
    return t[name].where(F.col(RUN) == p[RUN])


def in_run(t: Tables, p: Params, name: str) -> DataFrame:
    """Rows of a table with batch_id whose batch is of the run."""
    return t[name].join(F.broadcast(of_run(t, p, "monthly_batches").select(F.col("id").alias(BATCH))), BATCH)


def in_batch(t: Tables, p: Params, name: str = "matches") -> DataFrame:
    return t[name].where(F.col(BATCH) == p[BATCH])


def context(t: Tables, p: Params) -> DataFrame:
    """One row: the batch, its run and month."""
    return F.broadcast(t["monthly_batches"].where(F.col("id") == p[BATCH]).select(F.col("id").alias(BATCH), F.col(RUN).alias("run"), "batch_month"))


def ordered_batches(t: Tables, run: Column) -> DataFrame:
    rows = t["monthly_batches"].where(F.col(RUN) == run)
    return rows.select(F.col("id").alias(BATCH), "batch_month", F.row_number().over(Window.orderBy("batch_month", "batch_sequence", "id")).alias("ordinal"))


def memberships_by_player(t: Tables, p: Params) -> DataFrame:
    return of_run(t, p, "club_memberships").groupBy("player_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("is_primary", F.lit(False))).alias("primary"))


def with_memberships(t: Tables, p: Params) -> DataFrame:
    players = of_run(t, p, "players").select(F.col("id").alias("player_id"), "player_status", RUN)
    return players.join(memberships_by_player(t, p), "player_id", "left").fillna(0, ["total", "primary"])


def match_rosters(t: Tables, matches: DataFrame, *keep: str, exactly: int | None = None) -> DataFrame:
    """A row for each match team: its id, ``keep`` columns and roster key."""
    teams = t["match_teams"].select(F.col("id").alias("match_team_id"), "match_id", "pairing_source")
    sides = matches.withColumnRenamed("id", "match_id").join(teams, "match_id")
    return roster_keys(sides.join(t["match_team_players"].select("match_team_id", "player_id"), "match_team_id"), ["match_team_id", *keep], "player_id", exactly)


def run_ratings(t: Tables, p: Params) -> DataFrame:
    """Each player's last rating of the run: player_id, rating_value."""
    return latest(in_run(t, p, "player_rating_history").select("player_id", "rating_date", "id", "rating_value"), ["player_id"], ["rating_date", "id"]).select("player_id", "rating_value")


def rated_rosters(t: Tables, p: Params) -> DataFrame:
    """Members of active competitive teams, with their ratings: a row for each open membership."""
    teams = of_run(t, p, "teams").where((F.col("team_type") == "competitive") & (F.col("team_status") == "active")).select(F.col("id").alias("team_id"), "country_code", "team_division")
    open_ = t["team_memberships"].where(F.col("left_date").isNull()).select("team_id", "player_id")
    rated = run_ratings(t, p).withColumn("rated_id", F.col("player_id"))
    return teams.join(open_, "team_id").join(rated, "player_id", "left")


def candidate_teams(t: Tables, p: Params) -> DataFrame:
    """Teams of two members: member and rated counts and the rounded mean rating."""
    rows = rated_rosters(t, p).groupBy("team_id", "country_code", "team_division").agg(F.countDistinct("player_id").alias("members"), F.countDistinct("rated_id").alias("rated"), F.round(F.avg("rating_value"), 3).alias("rating"))
    return rows.where(F.col("members") == 2)


def zero_matches(t: Tables, p: Params, status: str, players: DataFrame) -> DataFrame:
    """Of the active players by ``status``, how many have no match in the batch."""
    played = in_batch(t, p).select(F.col("id").alias("match_id")).join(t["match_teams"].select(F.col("id").alias("match_team_id"), "match_id"), "match_id")
    played = played.join(t["match_team_players"].select("match_team_id", "player_id"), "match_team_id").select("player_id").distinct().withColumn("played", F.lit(1))
    rows = players.join(played, "player_id", "left")
    return rows.groupBy(status).agg(F.count("*").alias("active_player_count"), ones(F.col("played").isNull()).alias("zero_match_player_count")).withColumn("zero_match_player_pct", pct(F.col("zero_match_player_count"), F.col("active_player_count")))


def active_players(t: Tables, p: Params) -> DataFrame:
    rows = t["players"].join(context(t, p), F.col(RUN) == F.col("run"))
    return rows.where((F.col("player_status") == "ACTIVE") & (F.col("registration_date") <= F.col("batch_month"))).select(F.col("id").alias("player_id"), "registration_date", "batch_month")


def flagged(players: DataFrame, ids: DataFrame, status: str, yes: str, no: str) -> DataFrame:
    return players.join(ids.select("player_id").distinct().withColumn("flag", F.lit(1)), "player_id", "left").withColumn(status, F.when(F.col("flag").isNull(), no).otherwise(yes))


def teams_at(t: Tables, p: Params) -> DataFrame:
    """Open memberships of active teams as of the batch: team_id, player_id."""
    month = F.col("batch_month")
    teams = t["teams"].join(context(t, p), F.col(RUN) == F.col("run")).where((F.col("team_status") == "active") & active("formation_date", "dissolution_date", month))
    members = t["team_memberships"].select("team_id", "player_id", "joined_date", "left_date")
    return teams.select(F.col("id").alias("team_id"), "batch_month").join(members, "team_id").where(active("joined_date", "left_date", month)).select("team_id", "player_id")


def creation_dates(t: Tables, p: Params) -> DataFrame:
    """Active players with the month of their first registration, else their registration date."""
    first = t["player_registrations"].groupBy("player_id").agg(F.min("registration_month").alias("first_month"))
    return active_players(t, p).join(first, "player_id", "left").withColumn("created", F.coalesce("first_month", "registration_date"))


def batch_games(t: Tables, p: Params) -> DataFrame:
    return t["match_games"].join(in_batch(t, p).select(F.col("id").alias("match_id"), BATCH), "match_id")


def outcomes(t: Tables, p: Params) -> DataFrame:
    """Matches of the batch with the number of the team that won."""
    matches = in_batch(t, p).select(F.col("id").alias("match_id"), BATCH, "winning_team_id", "predicted_winning_team_number", "predicted_win_probability")
    rows = matches.join(t["match_teams"].select("match_id", "team_number", "source_team_id"), "match_id")
    return rows.groupBy("match_id", BATCH, "predicted_winning_team_number", "predicted_win_probability").agg(F.max(F.when(F.col("source_team_id") == F.col("winning_team_id"), F.col("team_number"))).alias("actual"))


def ratings_by_batch(t: Tables, p: Params) -> DataFrame:
    """The rating that each registered player holds in each batch of the run."""
    batches = ordered_batches(t, F.lit(p[RUN]))
    history = t["player_rating_history"].join(F.broadcast(batches.select(BATCH, "ordinal")), BATCH)
    ended = latest(history.select("player_id", "ordinal", "rating_date", "id", "rating_value"), ["player_id", "ordinal"], ["rating_date", "id"])
    last = batches.agg((F.max("ordinal") + 1).alias("last"))
    held = at_each(spans(ended.join(F.broadcast(last)), "player_id", "ordinal", F.col("last")))
    players = of_run(t, p, "players").select(F.col("id").alias("player_id"), "registration_date")
    rows = held.select("player_id", "at", "rating_value").join(F.broadcast(batches), F.col("at") == F.col("ordinal")).join(players, "player_id")
    return rows.where(F.col("registration_date") <= F.col("batch_month")).select(BATCH, "batch_month", "player_id", "rating_value")


def confidence_band(value: str = "confidence_before") -> Column:
    return bucket(F.col(value), [(0.25, "0_24"), (0.5, "25_49"), (0.75, "50_74")], "75_plus", "unknown")


def run_sizes(t: Tables) -> DataFrame:
    runs = t["generation_runs"].select(F.col("id").alias(RUN), "generation_name")
    batches = t["monthly_batches"].select(F.col("id").alias(BATCH), RUN)
    counts = {"player_count": t["players"], "team_count": t["teams"], "match_count": t["matches"].join(batches, BATCH)}
    for name, rows in counts.items():
        runs = runs.join(rows.groupBy(RUN).agg(F.count("*").alias(name)), RUN, "left")
    return runs.fillna(0, list(counts))


# --- players -------------------------------------------------------------------------


@audit(RUN)
def player_roster_summary(t: Tables, p: Params) -> DataFrame:
    out = with_memberships(t, p).groupBy(RUN).agg(F.count("*").alias("player_count"), ones(F.col("player_status") == "ACTIVE").alias("active_player_count"), ones(F.col("primary") == 0).alias("unaffiliated_player_count"), ones(F.col("total") > 1).alias("multi_club_player_count"))
    return out.withColumn("unaffiliated_player_pct", pct(F.col("unaffiliated_player_count"), F.col("player_count")))


def _players_by(t: Tables, p: Params, rows: DataFrame, key: str, targets: str | None) -> DataFrame:
    shares = distribution(rows, key, count="player_count", share="player_pct")
    return with_targets(shares, key, p[targets], "player_count", "player_pct").drop("ordinal") if targets and p.get(targets) else shares


@audit(RUN)
def player_status_distribution(t: Tables, p: Params) -> DataFrame:
    rows = of_run(t, p, "players").withColumn("player_status", F.coalesce("player_status", F.lit("UNKNOWN")))
    return _players_by(t, p, rows, "player_status", "player_status_target_pcts")


@audit(RUN)
def player_gender_distribution(t: Tables, p: Params) -> DataFrame:
    rows = of_run(t, p, "players").withColumn("gender", F.coalesce("gender", F.lit("UNKNOWN")))
    return _players_by(t, p, rows, "gender", "gender_target_pcts")


_AGES = [(18, "under_18"), (30, "18_29"), (45, "30_44"), (60, "45_59"), (75, "60_74")]


@audit(RUN)
def player_age_distribution(t: Tables, p: Params) -> DataFrame:
    rows = of_run(t, p, "players").join(t["player_registrations"].select(F.col("player_id").alias("id"), "registration_month"), "id")
    age = age_years(F.col("birth_date"), F.col("registration_month"))
    return _players_by(t, p, rows.withColumn("age_bucket", bucket(age, _AGES, "75_plus")), "age_bucket", "age_bucket_target_pcts")


@audit(RUN)
def player_registration_age_distribution(t: Tables, p: Params) -> DataFrame:
    age = age_years(F.col("birth_date"), F.col("registration_date"))
    rows = of_run(t, p, "players").withColumn("age_bucket", bucket(age, [(12, "under_12"), (18, "12_17"), *_AGES[1:]], "75_plus"))
    return _players_by(t, p, rows, "age_bucket", None)


@audit(RUN)
def player_region_distribution(t: Tables, p: Params) -> DataFrame:
    players = of_run(t, p, "players")
    counts = players.groupBy(F.col("home_region_id").alias("region_id")).agg(F.count("*").alias("player_count"))
    total = players.agg(F.count("*").alias("total"))
    chance = F.coalesce("selection_probability", F.lit(0.0))
    regions = t["regions"].where(F.col("country_code").isin("US", "CA")).withColumn("share", F.try_divide(F.lit(100.0) * chance, F.sum(chance).over(Window.partitionBy())))
    rows = regions.withColumnRenamed("id", "region_id").join(counts, "region_id").crossJoin(F.broadcast(total))
    seen = F.try_divide(F.lit(100.0) * F.col("player_count"), F.col("total"))
    return rows.select("region_id", "country_code", "state_province_code", "region_name", "player_count", F.round(seen, 2).alias("player_pct"), F.round("share", 2).alias("configured_pct"), F.round(seen - F.col("share"), 2).alias("pct_point_drift"))


@audit(RUN)
def player_registration_by_batch(t: Tables, p: Params) -> DataFrame:
    counts = t["player_registrations"].groupBy(BATCH).agg(F.count("*").alias("registration_count"))
    rows = of_run(t, p, "monthly_batches").select(F.col("id").alias(BATCH), "batch_month").join(counts, BATCH, "left").fillna(0)
    total = of_run(t, p, "players").agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("player_pct", pct(F.col("registration_count"), F.col("total"))).drop("total")


@audit(RUN)
def player_name_uniqueness_summary(t: Tables, p: Params) -> DataFrame:
    names = of_run(t, p, "players").groupBy("first_name", "last_name").agg(F.count("*").alias("n"))
    full = F.concat("first_name", F.lit("|"), "last_name")
    out = names.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("player_count"), F.countDistinct("first_name").alias("distinct_first_name_count"), F.countDistinct("last_name").alias("distinct_last_name_count"), F.countDistinct(full).alias("distinct_full_name_count"), F.coalesce(F.max("n"), F.lit(0)).alias("max_players_sharing_full_name"))
    return out.withColumn(RUN, F.lit(p[RUN]).cast("long")).withColumn("max_full_name_player_pct", pct(F.col("max_players_sharing_full_name"), F.col("player_count")))


@audit(RUN)
def player_first_name_alignment(t: Tables, p: Params) -> DataFrame:
    regions = t["regions"].select(F.col("id").alias("home_region_id"), "country_code", "state_province_code")
    rows = of_run(t, p, "players").withColumn("birth_year", F.year("birth_date")).join(regions, "home_region_id", "left")
    levels = {
        "exact_state_year": ["country_code", "state_province_code", "birth_year", "gender", "first_name"],
        "state_gender_other_year": ["country_code", "state_province_code", "gender", "first_name"],
        "country_year_other_state": ["country_code", "birth_year", "gender", "first_name"],
        "country_gender_other_state_year": ["country_code", "gender", "first_name"],
    }
    for name, keys in levels.items():
        rows = rows.join(t["first_names"].select(*keys).distinct().withColumn(name, F.lit(name)), keys, "left")
    return distribution(rows.withColumn("alignment_bucket", F.coalesce(*levels, F.lit("missing_reference"))), "alignment_bucket", count="player_count", share="player_pct")


@audit(RUN)
def player_last_name_alignment(t: Tables, p: Params) -> DataFrame:
    regions = t["regions"].select(F.col("id").alias("home_region_id"), "country_code", "state_province_code")
    rows = of_run(t, p, "players").join(regions, "home_region_id", "left")
    for name, keys in {"exact_state": ["country_code", "state_province_code", "last_name"], "country_other_state": ["country_code", "last_name"]}.items():
        rows = rows.join(t["last_names"].select(*keys).distinct().withColumn(name, F.lit(name)), keys, "left")
    rows = rows.withColumn("alignment_bucket", F.coalesce("exact_state", "country_other_state", F.lit("missing_reference")))
    return distribution(rows, "alignment_bucket", count="player_count", share="player_pct")


@audit(RUN, "initial_rating_elite_min")
def initial_rating_distribution_summary(t: Tables, p: Params) -> DataFrame:
    players = of_run(t, p, "players").select(F.col("id").alias("player_id"))
    rows = t["player_rating_history"].where(F.col("rating_type") == "initial").join(players, "player_id")
    v, elite = F.col("rating_value"), F.lit(p["initial_rating_elite_min"])
    out = rows.agg(F.count("*").alias("player_count"), F.round(F.avg(v), 3).alias("avg_initial_rating"), F.min(v).alias("min_initial_rating"), F.max(v).alias("max_initial_rating"), ones(v < 1000).alias("sub_1000_count"), ones(v >= 2000).alias("rating_2000_plus_count"), ones(v >= elite).alias("elite_rating_count"))
    return out.withColumns({RUN: F.lit(p[RUN]).cast("long"), "elite_rating_pct": pct(F.col("elite_rating_count"), F.col("player_count")), "configured_elite_min": elite})


# --- clubs and teams -----------------------------------------------------------------


@audit(RUN, "unaffiliated_player_rate", "multi_club_membership_rate")
def club_membership_summary(t: Tables, p: Params) -> DataFrame:
    n, free, many = F.col("player_count"), F.col("unaffiliated_player_count"), F.col("multi_club_player_count")
    out = with_memberships(t, p).agg(F.count("*").alias("player_count"), ones(F.col("total") == 0).alias("unaffiliated_player_count"), ones(F.col("total") > 1).alias("multi_club_player_count"), ones(F.col("primary") > 1).alias("multi_primary_player_count"), F.round(F.avg(F.when(F.col("total") > 0, F.col("total"))), 3).alias("avg_memberships_per_affiliated_player"))
    share = lambda x: F.try_divide(F.lit(100.0) * x, n)
    a, b = p["unaffiliated_player_rate"] * 100.0, p["multi_club_membership_rate"] * 100.0
    return out.withColumns({RUN: F.lit(p[RUN]).cast("long"), "unaffiliated_player_pct": pct(free, n), "multi_club_player_pct": pct(many, n), "configured_unaffiliated_pct": F.round(F.lit(a), 2), "configured_multi_club_pct": F.round(F.lit(b), 2), "unaffiliated_pct_point_drift": F.round(share(free) - a, 2), "multi_club_pct_point_drift": F.round(share(many) - b, 2)})


@audit(RUN)
def club_primary_membership_integrity(t: Tables, p: Params) -> DataFrame:
    k = F.col("primary")
    return with_memberships(t, p).agg(F.count("*").alias("player_count"), ones(k == 0).alias("zero_primary_player_count"), ones(k == 1).alias("valid_primary_player_count"), ones(k > 1).alias("multi_primary_player_count")).withColumn(RUN, F.lit(p[RUN]).cast("long"))


@audit(RUN)
def team_current_roster_integrity(t: Tables, p: Params) -> DataFrame:
    open_ = t["team_memberships"].where(F.col("left_date").isNull()).groupBy("team_id").agg(F.count("*").alias("current_member_count"))
    teams = of_run(t, p, "teams").where(F.col("team_status") == "active").withColumnRenamed("id", "team_id")
    rows = teams.join(open_, "team_id", "left").fillna(0, ["current_member_count"]).where(F.col("current_member_count") != 2)
    return rows.select("team_id", "team_type", "team_division", "team_status", "country_code", "formation_date", "dissolution_date", "current_member_count")


@audit(RUN)
def team_membership_date_integrity(t: Tables, p: Params) -> DataFrame:
    joined, left, formed, ended = (F.col(c) for c in ("joined_date", "left_date", "formation_date", "dissolution_date"))
    rows = of_run(t, p, "teams").withColumnRenamed("id", "team_id").join(t["team_memberships"].select("team_id", "player_id", "joined_date", "left_date"), "team_id")
    issue = F.when(joined < formed, "joined_before_formation").when(left <= joined, "left_not_after_joined").when(ended.isNotNull() & left.isNull(), "open_membership_on_dissolved_team").when(joined > ended, "joined_after_team_dissolution").when(left > ended, "left_after_team_dissolution")
    return rows.withColumn("issue_type", issue).where(F.col("issue_type").isNotNull()).select("team_id", "player_id", "team_type", "team_division", "team_status", "formation_date", "dissolution_date", "joined_date", "left_date", "issue_type")


def _club_load(t: Tables, p: Params) -> DataFrame:
    counts = of_run(t, p, "club_memberships").groupBy("club_id").agg(F.count("*").alias("membership_count"), F.count_if(F.coalesce("is_primary", F.lit(False))).alias("primary_membership_count"))
    clubs = t["clubs"].where(F.col(RUN).isNull() | (F.col(RUN) == p[RUN])).withColumnRenamed("id", "club_id")
    fill = F.when(F.col("member_capacity") > 0, F.col("membership_count").cast("double") / F.col("member_capacity"))
    return clubs.join(counts, "club_id", "left").fillna(0, ["membership_count", "primary_membership_count"]).withColumn("fill", fill)


@audit(RUN, "max_club_fill_ratio")
def club_fill_ratio_summary(t: Tables, p: Params) -> DataFrame:
    most = F.lit(float(p["max_club_fill_ratio"]))
    out = _club_load(t, p).agg(F.count("*").alias("club_count"), ones(F.col("member_capacity") > 0).alias("capacity_tracked_club_count"), ones(F.col("membership_count") == 0).alias("zero_membership_club_count"), F.round(F.avg("fill"), 3).alias("avg_fill_ratio"), F.round(F.max("fill"), 3).alias("max_fill_ratio"), ones(F.col("fill") > most).alias("over_capacity_club_count"))
    return out.withColumns({RUN: F.lit(p[RUN]).cast("long"), "configured_max_fill_ratio": F.round(most, 3)})


@audit(RUN, "max_club_fill_ratio")
def club_fill_ratio_outliers(t: Tables, p: Params) -> DataFrame:
    regions = t["regions"].select(F.col("id").alias("region_id"), "region_name")
    rows = _club_load(t, p).where(F.col("member_capacity") > 0).join(F.broadcast(regions), "region_id", "left").orderBy(F.desc("fill"), F.desc("membership_count"), "club_id").limit(25)
    return rows.select("club_id", "club_name", "region_name", "member_capacity", "membership_count", "primary_membership_count", F.round("fill", 3).alias("fill_ratio"), F.round(F.lit(float(p["max_club_fill_ratio"])), 3).alias("configured_max_fill_ratio"))


def _memberships_by_region(t: Tables, p: Params) -> DataFrame:
    players = t["players"].select(F.col("id").alias("player_id"), "home_region_id")
    clubs = t["clubs"].select(F.col("id").alias("club_id"), "region_id")
    return of_run(t, p, "club_memberships").join(players, "player_id").join(clubs, "club_id").withColumn("main", F.coalesce("is_primary", F.lit(False)))


@audit(RUN, "secondary_membership_same_region_rate", "cross_region_assignment_enabled")
def club_membership_geography(t: Tables, p: Params) -> DataFrame:
    home, club, main = F.col("home_region_id"), F.col("region_id"), F.col("main")
    out = _memberships_by_region(t, p).agg(F.count("*").alias("membership_count"), ones(main).alias("primary_membership_count"), ones(~main).alias("secondary_membership_count"), ones(home != club).alias("cross_region_membership_count"), ones(~main & (home == club)).alias("near"))
    goal = p["secondary_membership_same_region_rate"] * 100.0 if p["cross_region_assignment_enabled"] else 100.0
    return out.withColumns({"same_region_secondary_pct": pct(F.col("near"), F.col("secondary_membership_count")), "configured_same_region_secondary_pct": F.round(F.lit(goal), 2)}).drop("near")


@audit(RUN)
def cross_region_membership_flows(t: Tables, p: Params) -> DataFrame:
    names = F.broadcast(t["regions"].select("id", "region_name"))
    rows = _memberships_by_region(t, p).where(F.col("home_region_id") != F.col("region_id"))
    rows = rows.join(names.withColumnsRenamed({"id": "home_region_id", "region_name": "player_region_name"}), "home_region_id", "left").join(names.withColumnsRenamed({"id": "region_id", "region_name": "club_region_name"}), "region_id", "left")
    out = rows.groupBy("player_region_name", "club_region_name").agg(F.count("*").alias("membership_count"), ones(F.col("main")).alias("primary_membership_count"), ones(~F.col("main")).alias("secondary_membership_count"))
    return out.orderBy(F.desc("membership_count"), "player_region_name", "club_region_name").limit(25)


@audit(RUN)
def team_partner_continuity_by_batch(t: Tables, p: Params) -> DataFrame:
    batches = ordered_batches(t, F.lit(p[RUN]))
    batches = batches.withColumn("prior", F.lag(BATCH).over(Window.orderBy("ordinal")))
    rosters = of_run(t, p, "audit_batch_team_rosters").select(BATCH, "roster_key").distinct()
    before = rosters.select(F.col(BATCH).alias("prior"), "roster_key", F.lit(1).alias("held"))
    rows = batches.join(rosters, BATCH, "left").join(before, ["prior", "roster_key"], "left")
    held = F.coalesce(F.sum("held"), F.lit(0))
    out = rows.groupBy(BATCH, "batch_month", "prior").agg(F.count("roster_key").alias("active_roster_count"), held.alias("persisted_roster_count"), ones(F.col("roster_key").isNotNull() & F.col("held").isNull()).alias("new_roster_count"))
    return out.withColumn("persisted_roster_pct", F.when(F.col("prior").isNotNull(), pct(F.col("persisted_roster_count"), F.col("active_roster_count")))).drop("prior")


@audit(RUN)
def team_age_distribution(t: Tables, p: Params) -> DataFrame:
    last = of_run(t, p, "monthly_batches").agg(F.max("batch_month").alias("last"))
    days = F.datediff(F.coalesce("dissolution_date", "last"), "formation_date")
    rows = of_run(t, p, "teams").crossJoin(F.broadcast(last)).withColumn("days", days)
    rows = rows.withColumn("team_age_band", bucket(F.col("days"), [(30, "0_29"), (90, "30_89"), (180, "90_179")], "180_plus"))
    return rows.groupBy("team_age_band").agg(F.count("*").alias("team_count"), F.round(F.avg("days"), 1).alias("avg_team_age_days"))


@audit(RUN)
def team_dissolution_rate(t: Tables, p: Params) -> DataFrame:
    events = of_run(t, p, "team_lifecycle_events")
    kinds = events.sparkSession.createDataFrame([("dormant",), ("retired",), ("reactivated",)], "event_type string")
    counts = events.groupBy("event_type").agg(F.count("*").alias("event_count"))
    formed = events.agg(F.count_if(F.col("event_type") == "formed").alias("formed_team_count"))
    out = kinds.join(counts, "event_type", "left").fillna(0).crossJoin(F.broadcast(formed))
    return out.withColumn("event_pct_of_formed_teams", pct(F.col("event_count"), F.col("formed_team_count")))


# --- matches -------------------------------------------------------------------------


def _volume(batches: DataFrame, t: Tables) -> DataFrame:
    matches = t["matches"].select(F.col("id").alias("match_id"), BATCH, "match_date", "region_id")
    rows = batches.select(F.col("id").alias(BATCH), "batch_month").join(matches, BATCH, "left")
    out = rows.groupBy(BATCH, "batch_month").agg(F.count("match_id").alias("match_count"), F.countDistinct("match_date").alias("unique_match_days"), F.countDistinct("region_id").alias("distinct_match_regions"))
    return out.withColumn("avg_matches_per_match_day", ratio(F.col("match_count"), F.col("unique_match_days")))


@audit(RUN)
def match_volume_by_batch(t: Tables, p: Params) -> DataFrame:
    return _volume(of_run(t, p, "monthly_batches"), t)


@audit(BATCH)
def match_volume_summary(t: Tables, p: Params) -> DataFrame:
    return _volume(t["monthly_batches"].where(F.col("id") == p[BATCH]), t)


@audit(BATCH)
def match_type_distribution(t: Tables, p: Params) -> DataFrame:
    shares = distribution(in_batch(t, p), "match_type", count="match_count", share="match_pct")
    shares = with_targets(shares, "match_type", p["match_type_target_pcts"], "match_count", "match_pct").drop("ordinal") if p.get("match_type_target_pcts") else shares
    return shares.crossJoin(context(t, p).drop("run"))


@audit(BATCH)
def match_team_pairing_source_distribution(t: Tables, p: Params) -> DataFrame:
    sides = t["match_teams"]
    # Older tables lack the two columns.
    source = F.col("pairing_source") if "pairing_source" in sides.columns else F.lit(None).cast("string")
    team = F.col("source_team_id") if "source_team_id" in sides.columns else F.lit(None).cast("long")
    rows = sides.select("match_id", F.coalesce(source, F.lit("unknown")).alias("pairing_source"), team.alias("team")).join(in_batch(t, p).select(F.col("id").alias("match_id")), "match_id")
    out = rows.groupBy("pairing_source").agg(F.count("*").alias("match_team_count"), F.count("team").alias("source_team_count"))
    return out.withColumns({"match_team_pct": pct(F.col("match_team_count"), F.sum("match_team_count").over(Window.partitionBy())), "source_team_pct": pct(F.col("source_team_count"), F.col("match_team_count"))})


@audit(BATCH)
def match_day_of_week_distribution(t: Tables, p: Params) -> DataFrame:
    rows = in_batch(t, p).withColumn("day_number", F.dayofweek("match_date") - 1)
    return distribution(rows, "day_number", count="match_count", share="match_pct").withColumn("day_name", F.element_at(F.array(*map(F.lit, ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"))), F.col("day_number") + 1))


@audit(BATCH, "weekend_concentration_min", "weekend_concentration_max")
def weekend_match_share(t: Tables, p: Params) -> DataFrame:
    low, high = p["weekend_concentration_min"], p["weekend_concentration_max"]
    out = in_batch(t, p).groupBy(BATCH).agg(F.count("*").alias("total_matches"), ones(F.dayofweek("match_date").isin(1, 7)).alias("weekend_match_count"))
    share = F.try_divide(F.col("weekend_match_count").cast("double"), F.col("total_matches"))
    out = out.withColumns({"weekend_match_pct": pct(F.col("weekend_match_count"), F.col("total_matches")), "configured_weekend_min_pct": F.round(F.lit(low * 100.0), 2), "configured_weekend_max_pct": F.round(F.lit(high * 100.0), 2), "outside_config_range": F.when(share.between(low, high), 0).otherwise(1)})
    return out.join(context(t, p).drop("run"), BATCH)


@audit(BATCH)
def matches_per_team_distribution(t: Tables, p: Params) -> DataFrame:
    teams = roster_keys(teams_at(t, p), ["team_id"], "player_id", 2)
    played = match_rosters(t, in_batch(t, p).select("id")).groupBy("roster_key").agg(F.count("*").alias("n"))
    rows = teams.join(played, "roster_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return distribution(rows.withColumn("match_count_bucket", bucket(F.col("n"), [(1, "0"), (2, "1"), (3, "2"), (5, "3_4")], "5_plus")), "match_count_bucket", count="team_count", share="team_pct")


@audit(BATCH, "monthly_matches_per_active_player_mean", "monthly_matches_per_active_player_std_dev", "match_volume_noise_factor")
def matches_per_player_distribution(t: Tables, p: Params) -> DataFrame:
    players = t["players"].join(context(t, p), F.col(RUN) == F.col("run")).where(F.col("player_status") == "ACTIVE").select(F.col("id").alias("player_id"))
    sides = t["match_teams"].select(F.col("id").alias("match_team_id"), "match_id").join(in_batch(t, p).select(F.col("id").alias("match_id")), "match_id")
    played = t["match_team_players"].join(sides, "match_team_id").groupBy("player_id").agg(F.countDistinct("match_id").alias("n"))
    rows = players.join(played, "player_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = distribution(rows.withColumn("match_count_bucket", bucket(F.col("n"), [(1, "0"), (3, "1_2"), (5, "3_4"), (9, "5_8")], "9_plus")), "match_count_bucket", count="player_count", share="player_pct")
    return out.withColumns({"configured_match_mean": F.lit(p["monthly_matches_per_active_player_mean"]), "configured_match_std_dev": F.lit(p["monthly_matches_per_active_player_std_dev"]), "configured_match_volume_noise_factor": F.lit(p["match_volume_noise_factor"])})


@audit(BATCH)
def repeat_partner_match_distribution(t: Tables, p: Params) -> DataFrame:
    run = t["monthly_batches"].where(F.col("id") == p[BATCH]).select(RUN)
    own = {"monthly_batches": t["monthly_batches"].join(F.broadcast(run), RUN, "left_semi")}
    batches = ordered_batches(own, F.col(RUN))
    now = batches.where(F.col(BATCH) == p[BATCH]).select(F.col("ordinal").alias("now"))
    earlier = batches.join(F.broadcast(now), F.col("ordinal") < F.col("now")).select(BATCH)
    kind = F.when(F.col("match_type").isin("recreational", "clinic"), "casual").when(F.col("match_type").isin("challenge", "ladder"), "semi_competitive").when(F.col("match_type").isin("league", "tournament"), "competitive").otherwise("unknown")
    rosters = match_rosters(t, in_batch(t, p).select("id", kind.alias("match_class")), "match_class", "pairing_source")
    prior = match_rosters(t, t["matches"].join(F.broadcast(earlier), BATCH).select("id")).groupBy("roster_key").agg(F.count("*").alias("n"))
    rows = rosters.join(prior, "roster_key", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "pairing_source": F.coalesce("pairing_source", F.lit("unknown"))})
    rows = rows.withColumn("prior_match_count_bucket", bucket(F.col("n"), [(1, "0"), (3, "1_2"), (6, "3_5")], "6_plus"))
    keys = ["pairing_source", "match_class", "prior_match_count_bucket"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("match_team_count"), F.round(F.avg("n"), 2).alias("avg_prior_match_count"))
    return out.withColumn("match_team_pct_within_source_class", pct(F.col("match_team_count"), F.sum("match_team_count").over(Window.partitionBy(*keys[:2]))))


@audit(BATCH)
def zero_match_players_by_registration_cohort(t: Tables, p: Params) -> DataFrame:
    first = t["monthly_batches"].join(context(t, p).select("run"), F.col(RUN) == F.col("run")).agg(F.min("batch_month").alias("first_batch"))
    rows = creation_dates(t, p).crossJoin(F.broadcast(first))
    return zero_matches(t, p, "registration_cohort", rows.withColumn("registration_cohort", F.when(F.col("created") == F.col("first_batch"), "initial_batch").otherwise("later_batch")))


@audit(BATCH)
def zero_match_players_by_team_membership(t: Tables, p: Params) -> DataFrame:
    return zero_matches(t, p, "team_membership_status", flagged(active_players(t, p), teams_at(t, p), "team_membership_status", "teamed", "unteamed"))


@audit(BATCH)
def zero_match_players_by_competitive_team_status(t: Tables, p: Params) -> DataFrame:
    """Labels apart the same as by team membership: the team's type is not looked at."""
    return zero_matches(t, p, "competitive_team_status", flagged(active_players(t, p), teams_at(t, p), "competitive_team_status", "on_competitive_team", "not_on_competitive_team"))


@audit(BATCH)
def zero_match_players_by_ad_hoc_eligibility(t: Tables, p: Params) -> DataFrame:
    rated = t["player_rating_history"].join(context(t, p).select("batch_month"), F.col("rating_date") <= F.col("batch_month"))
    return zero_matches(t, p, "ad_hoc_eligibility_status", flagged(active_players(t, p), rated, "ad_hoc_eligibility_status", "ad_hoc_eligible", "missing_current_rating"))


@audit(BATCH)
def zero_match_players_by_club_affiliation(t: Tables, p: Params) -> DataFrame:
    """A membership that has ended still counts."""
    rows = t["club_memberships"].join(context(t, p), (F.col(RUN) == F.col("run")) & (F.col("start_date") <= F.col("batch_month")))
    return zero_matches(t, p, "club_affiliation_status", flagged(active_players(t, p), rows, "club_affiliation_status", "affiliated", "unaffiliated"))


@audit(BATCH)
def team_assignment_delay_summary(t: Tables, p: Params) -> DataFrame:
    joined = t["team_memberships"].join(t["teams"].where(F.col("team_type") == "competitive").select(F.col("id").alias("team_id")), "team_id").select("player_id", "joined_date")
    players = creation_dates(t, p).select("player_id", "created", "batch_month")
    within = joined.join(players, "player_id").where(F.col("joined_date").between(F.col("created"), F.col("batch_month"))).groupBy("player_id").agg(F.min("joined_date").alias("first_joined"))
    rows = players.join(within, "player_id", "left").withColumn("days", F.datediff(F.coalesce("first_joined", "batch_month"), "created"))
    has = F.col("first_joined").isNotNull()
    out = rows.agg(F.count("*").alias("player_count"), ones(has).alias("ever_teamed_player_count"), ones(~has).alias("still_unteamed_player_count"), F.round(F.avg(F.when(has, F.col("days"))), 2).alias("avg_days_to_first_team"), F.round(F.avg("days"), 2).alias("avg_days_unteamed_including_unresolved"), F.max("days").alias("max_days_unteamed_including_unresolved"))
    month = t["monthly_batches"].where(F.col("id") == p[BATCH]).agg(F.max("batch_month").alias("batch_month"))
    return out.crossJoin(F.broadcast(month)).withColumn(BATCH, F.lit(p[BATCH]).cast("long"))


@audit(BATCH, "max_daily_matches_per_team")
def daily_team_match_cap_violations(t: Tables, p: Params) -> DataFrame:
    most = p["max_daily_matches_per_team"]
    rows = match_rosters(t, in_batch(t, p).select("id", "match_date"), "match_date").withColumnsRenamed({"first_id": "player_one_id", "second_id": "player_two_id"})
    out = rows.groupBy("roster_key", "player_one_id", "player_two_id", "match_date").agg(F.count("*").alias("daily_match_count"))
    return out.where(F.col("daily_match_count") > most).withColumn("configured_max_daily_matches", F.lit(most))


@audit(BATCH)
def match_winner_integrity(t: Tables, p: Params) -> DataFrame:
    rows = in_batch(t, p).select(F.col("id").alias("match_id"), "match_date", "winning_team_id").join(t["match_teams"].select("match_id", F.col("id").alias("side"), "team_score", "source_team_id"), "match_id", "left")
    won = F.col("source_team_id") == F.col("winning_team_id")
    out = rows.groupBy("match_id", "match_date", "winning_team_id").agg(F.count("side").alias("team_count"), ones(won).alias("winning_team_row_count"), F.max(F.when(won, F.col("team_score"))).alias("winning_team_score"), F.max(F.when(~won, F.col("team_score"))).alias("opposing_team_score"))
    issue = F.when(F.col("winning_team_id").isNull(), "missing_winning_team").when(F.col("team_count") != 2, "unexpected_team_count").when(F.col("winning_team_row_count") == 0, "winning_team_not_in_match").when(F.col("winning_team_score").isNull(), "missing_winning_team_score").when(F.col("opposing_team_score").isNull(), "missing_opposing_team_score").when(F.col("winning_team_score") <= F.col("opposing_team_score"), "winning_team_not_high_score")
    return out.withColumn("issue_type", issue).where(F.col("issue_type").isNotNull())


@audit(BATCH)
def match_game_score_integrity(t: Tables, p: Params) -> DataFrame:
    one, two, won = F.col("team_one_score"), F.col("team_two_score"), F.col("winning_team_number")
    issue = F.when(~won.isin(1, 2), "invalid_winning_team_number").when(one == two, "tied_score").when(((won == 1) & (one <= two)) | ((won == 2) & (two <= one)), "winner_score_mismatch").when(F.greatest(one, two) < F.col("target_score"), "target_score_not_reached").when(F.abs(one - two) < F.col("win_by"), "win_by_not_met")
    rows = batch_games(t, p).withColumn("issue_type", issue).where(F.col("issue_type").isNotNull())
    return rows.select("match_id", F.col("id").alias("game_id"), "game_number", "team_one_score", "team_two_score", "winning_team_number", "target_score", "win_by", "issue_type")


@audit(BATCH)
def batch_region_match_distribution(t: Tables, p: Params) -> DataFrame:
    regions = t["regions"].select(F.col("id").alias("region_id"), "region_name")
    known = F.broadcast(regions.withColumn("known", F.col("region_id")))
    rows = in_batch(t, p).join(known, "region_id", "left").select(F.col("known").alias("region_id"), "region_name")
    return distribution(rows, "region_id", "region_name", count="match_count", share="match_pct")


@audit(BATCH)
def game_competitiveness_summary(t: Tables, p: Params) -> DataFrame:
    one, two = F.col("team_one_score"), F.col("team_two_score")
    out = batch_games(t, p).groupBy(BATCH).agg(F.count("*").alias("game_count"), F.round(F.avg(F.abs(one - two)), 3).alias("avg_margin"), ones(F.greatest(one, two) > F.col("target_score")).alias("extended_game_count"))
    return out.withColumn("extended_game_pct", pct(F.col("extended_game_count"), F.col("game_count")))


@audit(BATCH)
def game_margin_distribution(t: Tables, p: Params) -> DataFrame:
    margin = F.abs(F.col("team_one_score") - F.col("team_two_score"))
    return distribution(batch_games(t, p).withColumn("margin_bucket", bucket(margin, [(3, "0_2"), (6, "3_5"), (9, "6_8")], "9_plus")), "margin_bucket", count="game_count", share="game_pct")


@audit(BATCH)
def upset_rate_summary(t: Tables, p: Params) -> DataFrame:
    out = outcomes(t, p).groupBy(BATCH).agg(F.count("*").alias("total_matches"), ones(F.col("predicted_winning_team_number") != F.col("actual")).alias("upset_match_count"), F.round(F.avg("predicted_win_probability"), 4).alias("avg_predicted_win_probability"))
    return out.withColumn("upset_match_pct", pct(F.col("upset_match_count"), F.col("total_matches")))


@audit(BATCH)
def predicted_vs_actual_outcome_buckets(t: Tables, p: Params) -> DataFrame:
    rows = outcomes(t, p).withColumn("probability_bucket", bucket(F.col("predicted_win_probability"), [(0.6, "50_59"), (0.7, "60_69"), (0.8, "70_79"), (0.9, "80_89")], "90_plus"))
    out = rows.groupBy("probability_bucket").agg(F.count("*").alias("match_count"), ones(F.col("predicted_winning_team_number") == F.col("actual")).alias("favorite_win_count"), F.round(F.avg("predicted_win_probability"), 4).alias("avg_predicted_win_probability"))
    return out.withColumn("favorite_win_pct", pct(F.col("favorite_win_count"), F.col("match_count")))


@audit(RUN)
def repeat_partner_frequency(t: Tables, p: Params) -> DataFrame:
    rosters = match_rosters(t, in_run(t, p, "matches").select("id"), exactly=2)
    return histogram_of_counts(rosters, "roster_key", value="repeat_match_count", count="partnership_count", share="partnership_pct")


@audit(RUN)
def repeat_opponent_rate(t: Tables, p: Params) -> DataFrame:
    sides = t["match_teams"].join(in_run(t, p, "matches").select(F.col("id").alias("match_id")), "match_id")
    one, two = (sides.where(F.col("team_number") == k).select("match_id", F.col("source_team_id").alias(f"t{k}")) for k in (1, 2))
    meetings = unordered(one.join(two, "match_id"), "t1", "t2")
    return histogram_of_counts(meetings, "low_id", "high_id", value="meeting_count", count="matchup_pair_count", share="matchup_pair_pct")


# --- ratings -------------------------------------------------------------------------


@audit(RUN)
def rating_summary_by_batch(t: Tables, p: Params) -> DataFrame:
    v = F.col("rating_value")
    return ratings_by_batch(t, p).groupBy(BATCH, "batch_month").agg(F.count("*").alias("rated_player_count"), F.round(F.avg(v), 3).alias("avg_rating"), F.min(v).alias("min_rating"), F.max(v).alias("max_rating"), F.round(F.max(v) - F.min(v), 3).alias("rating_range"), ones(v < 1000).alias("sub_1000_count"), ones(v >= 2000).alias("rating_2000_plus_count"))


@audit(RUN)
def rating_band_distribution_by_batch(t: Tables, p: Params) -> DataFrame:
    rows = ratings_by_batch(t, p).withColumn("rating_band", bucket(F.col("rating_value"), [(1000, "sub_1000"), (1500, "1000_1499"), (2000, "1500_1999")], "2000_plus"))
    return distribution(rows, BATCH, "batch_month", "rating_band", within=[BATCH], count="player_count", share="player_pct")


@audit(BATCH, "rating_delta_warning_threshold")
def rating_delta_summary(t: Tables, p: Params) -> DataFrame:
    size, most = F.abs("rating_delta"), F.lit(p["rating_delta_warning_threshold"])
    out = in_batch(t, p, "ratings_update_log").groupBy(BATCH).agg(F.count("*").alias("player_update_count"), F.round(F.avg(size), 3).alias("avg_abs_rating_delta"), F.max(size).alias("max_abs_rating_delta"), ones(size >= most).alias("large_delta_count"))
    return out.withColumns({"large_delta_pct": pct(F.col("large_delta_count"), F.col("player_update_count")), "configured_warning_threshold": most})


@audit(BATCH)
def rating_delta_distribution(t: Tables, p: Params) -> DataFrame:
    rows = in_batch(t, p, "ratings_update_log").withColumn("delta_bucket", bucket(F.abs("rating_delta"), [(25, "under_25"), (50, "25_49"), (100, "50_99"), (200, "100_199")], "200_plus"))
    return distribution(rows, "delta_bucket", count="player_update_count", share="player_update_pct")


@audit(BATCH)
def rating_delta_by_confidence_band(t: Tables, p: Params) -> DataFrame:
    size = F.abs("rating_delta")
    return in_batch(t, p, "ratings_update_log").groupBy(confidence_band().alias("confidence_band")).agg(F.count("*").alias("player_update_count"), F.round(F.avg(size), 3).alias("avg_abs_rating_delta"), F.max(size).alias("max_abs_rating_delta"))


@audit(RUN)
def chemistry_effectiveness(t: Tables, p: Params) -> DataFrame:
    matches = in_run(t, p, "matches").select(F.col("id").alias("match_id"), "winning_team_id", "predicted_winning_team_number", "predicted_win_probability")
    teams = t["teams"].where(F.col("chemistry_score").isNotNull()).select(F.col("id").alias("source_team_id"), "chemistry_score")
    chance = F.coalesce("predicted_win_probability", F.lit(0.5))
    rows = t["match_teams"].join(matches, "match_id").join(teams, "source_team_id")
    rows = rows.withColumns({"expected": F.when(F.col("predicted_winning_team_number") == F.col("team_number"), chance).otherwise(1 - chance), "won": F.when(F.col("winning_team_id") == F.col("source_team_id"), 1.0).otherwise(0.0), "chemistry_band": bucket(F.col("chemistry_score"), [(0.4, "low"), (0.7, "medium")], "high")})
    return rows.groupBy("chemistry_band").agg(F.count("*").alias("team_match_count"), F.round(F.avg("chemistry_score"), 4).alias("avg_chemistry_score"), F.round(F.avg("expected"), 4).alias("avg_expected_win_probability"), F.round(F.avg("won"), 4).alias("actual_win_rate"), F.round(F.avg("won") - F.avg("expected"), 4).alias("win_rate_minus_expected"))


@audit(RUN)
def fatigue_effectiveness(t: Tables, p: Params) -> DataFrame:
    log = of_run(t, p, "ratings_update_log").select("player_id", "match_date", "match_id", (F.col("actual_score_share") - F.col("expected_score_share")).alias("gap"))
    daily = log.groupBy("player_id", "match_date").agg(F.countDistinct("match_id").alias("played"))
    rows = log.join(look_back(daily, "player_id", "match_date", "played", 14, "recent"), ["player_id", "match_date"])
    return rows.groupBy(bucket(F.col("recent"), [(1, "0"), (2, "1")], "2_plus").alias("workload_band")).agg(F.count("*").alias("player_update_count"), F.round(F.avg("recent"), 3).alias("avg_recent_match_count"), F.round(F.avg("gap"), 4).alias("avg_score_share_delta"), F.round(F.avg(F.when(F.col("gap") >= 0, 1.0).otherwise(0.0)), 4).alias("met_or_exceeded_expected_rate"))


@audit(RUN)
def confidence_stability(t: Tables, p: Params) -> DataFrame:
    gain = F.coalesce("confidence_after", "confidence_before") - F.col("confidence_before")
    return in_run(t, p, "ratings_update_log").groupBy(confidence_band().alias("confidence_band")).agg(F.count("*").alias("player_update_count"), F.round(F.avg(F.abs("rating_delta")), 3).alias("avg_abs_rating_delta"), F.round(F.avg(gain), 4).alias("avg_confidence_delta"))


@audit(RUN)
def volatility_decay(t: Tables, p: Params) -> DataFrame:
    rows = in_run(t, p, "player_rating_history").where(F.col("volatility_score").isNotNull())
    band = bucket(F.col("match_count_used"), [(5, "0_4"), (10, "5_9")], "10_plus", "unknown")
    return rows.groupBy(band.alias("experience_band")).agg(F.count("*").alias("rating_snapshot_count"), F.round(F.avg("volatility_score"), 4).alias("avg_volatility_score"), F.round(F.avg("confidence_score"), 4).alias("avg_confidence_score"))


@audit(RUN)
def rating_predictiveness(t: Tables, p: Params) -> DataFrame:
    matches = in_run(t, p, "matches").select(F.col("id").alias("match_id"), "winning_team_id", F.col("predicted_winning_team_number").alias("team_number"), "predicted_win_probability")
    rows = matches.join(t["match_teams"].select("match_id", "team_number", "source_team_id", F.lit(True).alias("there")), ["match_id", "team_number"], "left")
    won = F.when(F.col("there"), F.when(F.col("winning_team_id") == F.col("source_team_id"), 1.0).otherwise(0.0))
    band = bucket(F.col("predicted_win_probability"), [(0.6, "50_59"), (0.7, "60_69"), (0.8, "70_79")], "80_plus", "unknown")
    return rows.groupBy(band.alias("prediction_bucket")).agg(F.count(won).alias("predicted_match_count"), F.round(F.avg(won), 4).alias("favorite_win_rate"))


@audit(RUN, "initial_rating_elite_min", "regional_strength_min_rated_players")
def regional_strength_balance(t: Tables, p: Params) -> DataFrame:
    players = of_run(t, p, "players").select(F.col("id").alias("player_id"), F.col("home_region_id").alias("region_id"))
    regions = t["regions"].select(F.col("id").alias("region_id"), "country_code", "state_province_code", "region_name")
    v = F.col("rating_value")
    # Players without a rating add nothing to any of the figures, so an inner join is enough.
    out = players.join(run_ratings(t, p), "player_id").join(F.broadcast(regions), "region_id").groupBy("region_id", "country_code", "state_province_code", "region_name").agg(F.count("*").alias("rated_player_count"), F.round(F.avg(v), 3).alias("avg_rating"), F.round(F.max(v), 3).alias("max_rating"), pct(ones(v >= p["initial_rating_elite_min"]), F.count("*")).alias("elite_player_pct"))
    return out.where(F.col("rated_player_count") >= p["regional_strength_min_rated_players"])


@audit(BATCH)
def rating_outlier_players(t: Tables, p: Params) -> DataFrame:
    size = F.abs("rating_delta")
    out = in_batch(t, p, "ratings_update_log").groupBy("player_id").agg(F.count("*").alias("update_count"), F.round(F.avg(size), 3).alias("avg_abs_rating_delta"), F.max(size).alias("max_abs_rating_delta"), F.round(F.sum("rating_delta"), 3).alias("net_rating_delta"))
    names = t["players"].select(F.col("id").alias("player_id"), "first_name", "last_name")
    return out.join(names, "player_id").orderBy(F.desc("max_abs_rating_delta"), F.desc("avg_abs_rating_delta"), "player_id").limit(25)


# --- depth and readiness -------------------------------------------------------------

PLACE = ["country_code", "team_division"]


@audit(RUN)
def candidate_depth_by_country_division(t: Tables, p: Params) -> DataFrame:
    return candidate_teams(t, p).groupBy(*PLACE).agg(F.count("*").alias("candidate_team_count"), F.sum("members").alias("candidate_player_count"), F.round(F.avg("rating"), 3).alias("avg_team_rating"))


@audit(RUN, "initial_rating_elite_min")
def elite_player_depth(t: Tables, p: Params) -> DataFrame:
    elite = F.when(F.col("rating_value") >= p["initial_rating_elite_min"], F.col("player_id"))
    out = rated_rosters(t, p).groupBy(*PLACE).agg(F.countDistinct(elite).alias("elite_player_count"), F.countDistinct("player_id").alias("rostered_player_count"))
    return out.withColumn("elite_player_pct", pct(F.col("elite_player_count"), F.col("rostered_player_count")))


@audit(RUN, "initial_rating_elite_min")
def elite_team_depth(t: Tables, p: Params) -> DataFrame:
    out = candidate_teams(t, p).groupBy(*PLACE).agg(F.count("*").alias("candidate_team_count"), ones(F.col("rating") >= p["initial_rating_elite_min"]).alias("elite_team_count"))
    return out.withColumn("elite_team_pct", pct(F.col("elite_team_count"), F.col("candidate_team_count")))


@audit(RUN)
def alternate_candidate_depth(t: Tables, p: Params) -> DataFrame:
    """Every team but the first of its country and division; no ranking is needed to count them."""
    out = candidate_teams(t, p).groupBy(*PLACE).agg(F.count("*").alias("ranked_team_count"))
    return out.withColumn("alternate_team_count", F.col("ranked_team_count") - 1)


@audit(RUN)
def missing_gold_inputs(t: Tables, p: Params) -> DataFrame:
    matches = in_run(t, p, "matches").select(F.col("id").alias("match_id"))
    sides = t["match_teams"].join(matches, "match_id").select(F.col("id").alias("match_team_id"))
    rows = {
        "players": of_run(t, p, "players"),
        "teams": of_run(t, p, "teams"),
        "team_memberships": t["team_memberships"].join(of_run(t, p, "teams").select(F.col("id").alias("team_id")), "team_id"),
        "matches": matches,
        "match_teams": sides,
        "match_team_players": t["match_team_players"].join(sides, "match_team_id"),
        "player_rating_history": in_run(t, p, "player_rating_history"),
        "ratings_update_log": in_run(t, p, "ratings_update_log"),
        "clubs": t["clubs"],
        "club_memberships": of_run(t, p, "club_memberships"),
    }
    counts = [df.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(name)) for name, df in rows.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("missing_flag", (F.col("row_count") == 0).cast("int"))


@audit(RUN)
def student_candidate_availability(t: Tables, p: Params) -> DataFrame:
    out = candidate_teams(t, p).groupBy(*PLACE).agg(F.count("*").alias("candidate_team_count"), ones(F.col("rated") == 2).alias("fully_rated_team_count"))
    return out.withColumn("fully_rated_team_pct", pct(F.col("fully_rated_team_count"), F.col("candidate_team_count")))


@audit(RUN)
def division_balance(t: Tables, p: Params) -> DataFrame:
    rows = of_run(t, p, "teams").where((F.col("team_type") == "competitive") & (F.col("team_status") == "active") & F.col("country_code").isNotNull())
    return distribution(rows, *PLACE, within=["country_code"], count="team_count", share="team_pct_within_country")


# --- across runs ---------------------------------------------------------------------


@audit("")
def historical_run_size_regression(t: Tables, p: Params) -> DataFrame:
    rows = growth(run_sizes(t), RUN, "player_count", "team_count", "match_count")
    rows = rows.withColumnsRenamed({f"{x}_count_growth_pct": f"{x}_growth_pct" for x in ("player", "team", "match")})
    return rows.orderBy(F.desc(RUN)).limit(10)


@audit(RUN)
def historical_baseline_scale_regression(t: Tables, p: Params) -> DataFrame:
    sizes, names = run_sizes(t), ("player", "team", "match")
    now = sizes.where(F.col(RUN) == p[RUN])
    done = t["student_dataset_releases"].where((F.col("status") == "succeeded") & (F.col(RUN) != p[RUN]) & F.col("release_type").isin("historical_baseline", "initial_snapshot"))
    base = done.orderBy(F.desc("completed_at"), F.desc(RUN), F.desc("id")).limit(1).select(RUN, F.col("release_name").alias("baseline_release_name"), F.col("release_type").alias("baseline_release_type"), F.coalesce("data_quality_level", F.lit("none")).alias("baseline_data_quality_level"))
    base = base.join(sizes.drop("generation_name"), RUN).withColumnsRenamed({RUN: f"baseline_{RUN}"} | {f"{x}_count": f"baseline_{x}_count" for x in names})
    prior = sizes.where(F.col(RUN) < p[RUN]).orderBy(F.desc(RUN)).limit(3)
    prior = prior.agg(F.count("*").alias("prior_run_count"), *[F.round(F.avg(f"{x}_count"), 2).alias(f"avg_prior_{x}_count") for x in names])
    rows = now.join(F.broadcast(base), F.lit(True), "left").join(F.broadcast(prior), F.lit(True), "left")
    for x in names:
        for against, name in ((f"baseline_{x}_count", f"{x}_delta_vs_baseline_pct"), (f"avg_prior_{x}_count", f"{x}_delta_vs_trend_pct")):
            old = F.col(against).cast("double")
            rows = rows.withColumn(name, F.round(F.try_divide(F.lit(100.0) * (F.col(f"{x}_count") - old), old), 2))
    return rows


@audit("")
def historical_release_file_coverage(t: Tables, p: Params) -> DataFrame:
    rows = t["student_dataset_releases"].withColumn("data_quality_level", F.coalesce("data_quality_level", F.lit("none")))
    files = t["student_dataset_release_files"].select(F.col("release_id").alias("id"), F.lit(1).alias("file"), "row_count")
    return rows.join(files, "id", "left").groupBy(RUN, "release_name", "release_type", "data_quality_level", "status").agg(F.count("file").alias("file_count"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_row_count"))
