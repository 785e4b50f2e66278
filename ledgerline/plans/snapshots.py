"""Release tables: facts of a window's batches, snapshots as of its end, and what changed."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.history import latest, suppressed
from ledgerline.operators.pairs import closure
from ledgerline.operators.releases import changed, known_as_of

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Release:
    """What a release covers: its run, the batches of its facts, those known, and the day it ends before."""

    run: int
    facts: tuple[int, ...]
    known: tuple[int, ...]
    end: date
    prior: Release | None = None

    @property
    def at(self) -> Column:
        return F.lit(self.end)


def _of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among the one column of ``ids``.

    A task holds its part of the ids, once each, and lets the rows pass by: it doesn't sort them.
    """
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).hint("shuffle_hash"), key, "left_semi").select(rows.columns)


def _players(t: Tables, w: Release) -> DataFrame:
    return t["players"].where((F.col("generation_run_id") == w.run) & (F.col("registration_date") < w.at))


def _teams(t: Tables, w: Release) -> DataFrame:
    return t["teams"].where((F.col("generation_run_id") == w.run) & (F.col("formation_date") < w.at))


def _matches(t: Tables, w: Release) -> DataFrame:
    return t["matches"].where(F.col("batch_id").isin(*w.facts))


def _memberships(t: Tables, w: Release) -> DataFrame:
    own = F.col("generation_run_id").isNull() | (F.col("generation_run_id") == w.run)
    return _of(t["club_memberships"].where((F.col("start_date") < w.at) & own), _players(t, w).select("id"), "player_id")


def monthly_batches(t: Tables, w: Release) -> DataFrame:
    return t["monthly_batches"].where((F.col("generation_run_id") == w.run) & F.col("id").isin(*w.facts))


def player_registrations(t: Tables, w: Release) -> DataFrame:
    return _of(t["player_registrations"].where(F.col("batch_id").isin(*w.facts)), _players(t, w).select("id"), "player_id")


def player_master(t: Tables, w: Release) -> DataFrame:
    """Each player with the country of the home region and the last rating known by then."""
    players = _players(t, w)
    history = t["player_rating_history"].where(F.col("batch_id").isin(*w.known) & (F.col("rating_date") < w.at))
    rating = latest(history.select("player_id", "rating_date", "id", "rating_value", "confidence_score", "volatility_score", "match_count_used", "batch_id"), ["player_id"], ["rating_date", "id"])
    rating = rating.drop("id").withColumnRenamed("batch_id", "rating_batch_id")
    regions = t["regions"].select(F.col("id").alias("home_region_id"), "country_code")
    out = players.withColumnRenamed("id", "player_id").drop("generation_run_id").join(rating, "player_id", "left").join(regions, "home_region_id", "left")
    return out.withColumn("snapshot_month", F.trunc(F.date_sub(w.at, 1), "month"))


def matches(t: Tables, w: Release) -> DataFrame:
    return _matches(t, w)


def match_teams(t: Tables, w: Release) -> DataFrame:
    return _of(t["match_teams"], _matches(t, w).select("id"), "match_id").withColumnRenamed("source_team_id", "team_id")


def match_team_players(t: Tables, w: Release) -> DataFrame:
    return _of(t["match_team_players"], match_teams(t, w).select("id"), "match_team_id")


def match_games(t: Tables, w: Release) -> DataFrame:
    return _of(t["match_games"], _matches(t, w).select("id"), "match_id")


def player_assessment_history(t: Tables, w: Release) -> DataFrame:
    """Assessments of the window's batches, of players who are in the release."""
    return _of(t["player_assessment_history"].where(F.col("batch_id").isin(*w.facts)), _players(t, w).select("id"), "player_id")


def teams(t: Tables, w: Release) -> DataFrame:
    """Teams formed by then, without dissolutions that lie ahead."""
    return known_as_of(_teams(t, w), "formation_date", "dissolution_date", w.at, "team_status")


def team_memberships(t: Tables, w: Release) -> DataFrame:
    rows = _of(_of(t["team_memberships"], _teams(t, w).select("id"), "team_id"), _players(t, w).select("id"), "player_id")
    return known_as_of(rows, "joined_date", "left_date", w.at)


def clubs(t: Tables, w: Release) -> DataFrame:
    """The run's own clubs and those with its players."""
    member_of = _memberships(t, w).select(F.col("club_id").alias("id"), F.lit(True).alias("__used")).distinct()
    out = t["clubs"].join(member_of, "id", "left").where((F.col("generation_run_id") == w.run) | F.col("__used"))
    return out.select(t["clubs"].columns)


def club_memberships(t: Tables, w: Release) -> DataFrame:
    rows = _of(_memberships(t, w), clubs(t, w).select("id"), "club_id")
    return rows.withColumn("end_date", suppressed("end_date", w.at)).withColumnsRenamed({"start_date": "joined_date", "end_date": "left_date"})


def regions(t: Tables, w: Release) -> DataFrame:
    """Regions that players, clubs or the window's matches name."""
    named = [_players(t, w).select("home_region_id"), clubs(t, w).select("region_id"), _matches(t, w).select("region_id")]
    return _of(t["regions"], closure(*(x.toDF("id").where(F.col("id").isNotNull()) for x in named)), "id")


SNAPSHOT: dict[str, Callable[[Tables, Release], DataFrame]] = {
    f.__name__: f for f in (monthly_batches, regions, player_master, player_registrations, player_assessment_history, clubs, club_memberships, teams, team_memberships, matches, match_teams, match_team_players, match_games)
}
KEYS = {"player_master": "player_id"}


def delta(name: str, t: Tables, w: Release) -> DataFrame:
    """Rows of a snapshot that the prior release lacks or has otherwise; the month itself does not count."""
    return changed(SNAPSHOT[name](t, w), SNAPSHOT[name](t, w.prior), [KEYS.get(name, "id")], ["snapshot_month"])


def incremental(name: str, t: Tables, w: Release) -> DataFrame:
    """A table of a monthly update. Facts are whole; club memberships are what changed; entities are
    what changed and what the window's facts and changed memberships refer to."""
    if w.prior is None or name in ("monthly_batches", "player_registrations", "player_assessment_history", "matches", "match_teams", "match_team_players", "match_games"):
        return SNAPSHOT[name](t, w)
    if name == "club_memberships":
        return delta(name, t, w)
    key = KEYS.get(name, "id")
    ids = [delta(name, t, w).select(key)]
    if name == "player_master":
        ids += [player_registrations(t, w).select("player_id"), match_team_players(t, w).select("player_id"), delta("club_memberships", t, w).select("player_id"), delta("team_memberships", t, w).select("player_id")]
    elif name == "teams":
        ids += [delta("team_memberships", t, w).select("team_id"), match_teams(t, w).select("team_id")]
    elif name == "clubs":
        ids.append(delta("club_memberships", t, w).select("club_id"))
    return _of(SNAPSHOT[name](t, w), closure(*(x.toDF(key) for x in ids)), key)


def eligible_teams(t: Tables, at: Column) -> DataFrame:
    """team_id, is_active, decided_by: by the last lifecycle event up to ``at``, else by the team's own dates."""
    last = latest(t["team_lifecycle_events"].where(F.col("event_date") <= at).select("team_id", "event_date", "id", "event_type"), ["team_id"], ["event_date", "id"])
    rows = t["teams"].withColumnRenamed("id", "team_id").join(last.select("team_id", "event_type"), "team_id", "left")
    dates = (F.col("formation_date") <= at) & (F.col("team_status") == "active") & (F.col("dissolution_date").isNull() | (F.col("dissolution_date") > at))
    known = F.col("event_type").isNotNull()
    return rows.select("team_id", F.when(known, F.col("event_type").isin("formed", "reactivated")).otherwise(F.coalesce(dates, F.lit(False))).alias("is_active"), F.when(known, "team_lifecycle_events").otherwise("teams").alias("decided_by"))


def match_summaries(t: Tables) -> DataFrame:
    """Of each match: games won and points by side, the winning side (null if even), mean score share of side one."""
    one, two = F.col("team_one_score").cast("double"), F.col("team_two_score").cast("double")
    share = F.coalesce(F.try_divide(one, one + two), F.lit(0.5))
    out = t["match_games"].groupBy("match_id").agg(F.count("*").alias("games"), F.count_if(one > two).alias("games_one"), F.count_if(two > one).alias("games_two"), F.sum("team_one_score").alias("points_one"), F.sum("team_two_score").alias("points_two"), F.round(F.avg(share), 6).alias("share_one"))
    return out.withColumn("winning_team_number", F.when(F.col("games_one") > F.col("games_two"), 1).when(F.col("games_two") > F.col("games_one"), 2))


def resolved_winners(t: Tables) -> DataFrame:
    """match_id, resolved_team_id, decided_by, agrees: who won, and whether the match says the same.

    By games won; if even by points; then by the predicted chance of side one where that isn't a
    half; then the lower team id (a side without one counts by its number).
    """
    sides = t["match_teams"].groupBy("match_id").agg(*[F.max(F.when(F.col("team_number") == k, F.struct(F.col("source_team_id").alias("id"))))["id"].alias(f"team_{k}") for k in (1, 2)])
    chance = F.when(F.col("predicted_winning_team_number") == 1, F.col("predicted_win_probability")).when(F.col("predicted_winning_team_number") == 2, 1 - F.col("predicted_win_probability"))
    said = t["matches"].select(F.col("id").alias("match_id"), "winning_team_id", chance.alias("chance"))
    rows = said.join(sides, "match_id").join(match_summaries(t).drop("winning_team_number"), "match_id", "left")
    ahead = lambda one, two: F.when(one > two, 1).when(two > one, 2)
    key = [F.coalesce(f"team_{k}", F.lit(k)) for k in (1, 2)]
    rungs = {"games": ahead(F.col("games_one"), F.col("games_two")), "points": ahead(F.col("points_one"), F.col("points_two")), "chance": ahead(F.col("chance"), F.lit(0.5)), "id": F.when(key[0] <= key[1], 1).otherwise(2)}
    won, decided = F.coalesce(*rungs.values()), F.coalesce(*[F.when(x.isNotNull(), F.lit(n)) for n, x in rungs.items()])
    rows = rows.select("match_id", F.when(won == 1, F.col("team_1")).otherwise(F.col("team_2")).alias("resolved_team_id"), decided.alias("decided_by"), "winning_team_id")
    return rows.select("match_id", "resolved_team_id", "decided_by", F.col("winning_team_id").eqNullSafe(F.col("resolved_team_id")).alias("agrees"))


def initial_states(t: Tables, batch: int, start: float = 1500.0) -> DataFrame:
    """Each player's last rating and confidence up to and with ``batch``, and how many rated matches those have.

    A player without any rating starts at ``start``; a confidence that is not known stays null.
    """
    until = t["player_rating_history"].where(F.col("batch_id") <= batch)
    last = latest(until.select("player_id", "rating_date", "id", "rating_value", "confidence_score"), ["player_id"], ["rating_date", "id"])
    rated = until.where(F.col("rating_type") == "match_update").groupBy("player_id").agg(F.count("*").alias("rated"))
    rows = t["players"].select(F.col("id").alias("player_id")).join(last, "player_id", "left").join(rated, "player_id", "left")
    return rows.select("player_id", F.coalesce("rating_value", F.lit(start)).alias("rating"), F.col("confidence_score").alias("confidence"), F.coalesce("rated", F.lit(0)).alias("rated_matches"))


def recent_opponents(t: Tables, since: Column) -> DataFrame:
    """The last day since ``since`` on which two teams met: low_id, high_id, met_on, meetings."""
    one, two = (t["match_teams"].where(F.col("team_number") == k).select("match_id", F.col("source_team_id").alias(f"t{k}")) for k in (1, 2))
    rows = t["matches"].where(F.col("match_date") >= since).select(F.col("id").alias("match_id"), "match_date").join(one, "match_id").join(two, "match_id")
    return rows.groupBy(F.least("t1", "t2").alias("low_id"), F.greatest("t1", "t2").alias("high_id")).agg(F.max("match_date").alias("met_on"), F.count("*").alias("meetings"))


def opponent_days(t: Tables, since: Column) -> DataFrame:
    """All days since ``since`` on which two teams met, in order, as text: low_id, high_id, days."""
    one, two = (t["match_teams"].where(F.col("team_number") == k).select("match_id", F.col("source_team_id").alias(f"t{k}")) for k in (1, 2))
    rows = t["matches"].where(F.col("match_date") >= since).select(F.col("id").alias("match_id"), "match_date").join(one, "match_id").join(two, "match_id")
    met = rows.groupBy(F.least("t1", "t2").alias("low_id"), F.greatest("t1", "t2").alias("high_id")).agg(F.array_sort(F.collect_set("match_date")).alias("days"))
    return met.withColumn("days", F.concat_ws(",", F.transform("days", lambda d: d.cast("string"))))


def shared_clubs(t: Tables) -> DataFrame:
    """Teams whose players are members of the same clubs: team_id, clubs (in order, as text), n."""
    clubs_of = t["club_memberships"].groupBy("player_id").agg(F.collect_set("club_id").alias("clubs"))
    one, two = (t["team_memberships"].where(F.col("player_position") == k).select("team_id", "player_id").join(clubs_of, "player_id").select("team_id", F.col("clubs").alias(f"c{k}")) for k in (1, 2))
    rows = one.join(two, "team_id").select("team_id", F.array_sort(F.array_intersect("c1", "c2")).alias("both")).where(F.size("both") > 0)
    return rows.select("team_id", F.concat_ws(",", F.transform("both", lambda c: c.cast("string"))).alias("clubs"), F.size("both").alias("n"))


def unrated_players(t: Tables) -> DataFrame:
    """Players of the table without any rated match: the difference of two sets of ids."""
    return t["players"].select(F.col("id").alias("player_id")).subtract(t["player_rating_history"].where(F.col("rating_type") == "match_update").select("player_id"))


def previous(w: Release, facts: tuple[int, ...], end: date) -> Release:
    """The release before ``w``."""
    return replace(w, facts=facts, known=tuple(b for b in w.known if b <= max(facts)), end=end, prior=None)
