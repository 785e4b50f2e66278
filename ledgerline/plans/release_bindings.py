"""Release tables, their checks, match inputs and run-time reports bound to the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import checks, ratings, tournament
from ledgerline.sources.interim import kept

from . import domain, reports, snapshots
from .snapshots import Release

PRIOR = Release(1, (5,), (1, 2, 3, 4, 5), date(2000, 1, 1))
UPDATE = Release(1, (6,), (1, 2, 3, 4, 5, 6), date(2001, 1, 1), PRIOR)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, run: Callable[[dict[str, DataFrame]], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(domain.tables(spark, sf_dir))
    ORACLE_SQL[name] = domain.oracle(sql)


# --- release tables ---------------------------------------------------------------------


def _sql(batch: int, end: str) -> dict[str, str]:
    """Each release table in SQL, for the facts of one batch and all known before ``end``."""
    players = f"SELECT * FROM players WHERE generation_run_id = 1 AND registration_date < DATE '{end}'"
    teams = f"SELECT * FROM teams WHERE generation_run_id = 1 AND formation_date < DATE '{end}'"
    members = f"SELECT * FROM club_memberships WHERE start_date < DATE '{end}' AND coalesce(generation_run_id, 1) = 1 AND player_id IN (SELECT id FROM ({players}))"
    clubs = f"SELECT * FROM clubs WHERE generation_run_id = 1 OR id IN (SELECT club_id FROM ({members}))"
    matches = f"SELECT * FROM matches WHERE batch_id = {batch}"
    sides = f"SELECT * FROM match_teams WHERE match_id IN (SELECT id FROM ({matches}))"
    ends = lambda column: f"CASE WHEN {column} >= DATE '{end}' THEN NULL ELSE {column} END"
    return {
        "monthly_batches": f"SELECT * FROM monthly_batches WHERE generation_run_id = 1 AND id = {batch}",
        "regions": f"SELECT * FROM regions WHERE id IN (SELECT home_region_id FROM ({players}) UNION SELECT region_id FROM ({clubs}) UNION SELECT region_id FROM ({matches}))",
        "player_master": f"""SELECT p.id AS player_id, p.* EXCLUDE (id, generation_run_id), h.rating_date, h.rating_value, h.confidence_score, h.volatility_score, h.match_count_used, h.batch_id AS rating_batch_id, g.country_code,
            CAST(date_trunc('month', DATE '{end}' - 1) AS DATE) AS snapshot_month FROM ({players}) p LEFT JOIN (SELECT * FROM player_rating_history WHERE batch_id <= {batch} AND rating_date < DATE '{end}'
            QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY rating_date DESC, id DESC) = 1) h ON h.player_id = p.id LEFT JOIN regions g ON g.id = p.home_region_id""",
        "player_registrations": f"SELECT * FROM player_registrations WHERE batch_id = {batch} AND player_id IN (SELECT id FROM ({players}))",
        "player_assessment_history": f"SELECT * FROM player_assessment_history WHERE batch_id = {batch} AND player_id IN (SELECT id FROM ({players}))",
        "clubs": clubs,
        "club_memberships": f"SELECT * EXCLUDE (start_date, end_date), start_date AS joined_date, {ends('end_date')} AS left_date FROM ({members}) WHERE club_id IN (SELECT id FROM ({clubs}))",
        "teams": f"SELECT * EXCLUDE (team_status, dissolution_date), CASE WHEN dissolution_date >= DATE '{end}' AND team_status IN ('dormant', 'retired') THEN 'active' ELSE team_status END AS team_status, {ends('dissolution_date')} AS dissolution_date FROM ({teams})",
        "team_memberships": f"SELECT * EXCLUDE (left_date), {ends('left_date')} AS left_date FROM team_memberships WHERE joined_date < DATE '{end}' AND team_id IN (SELECT id FROM ({teams})) AND player_id IN (SELECT id FROM ({players}))",
        "matches": matches,
        "match_teams": f"SELECT * EXCLUDE (source_team_id), source_team_id AS team_id FROM ({sides})",
        "match_team_players": f"SELECT * FROM match_team_players WHERE match_team_id IN (SELECT id FROM ({sides}))",
        "match_games": f"SELECT * FROM match_games WHERE match_id IN (SELECT id FROM ({matches}))",
    }


_NOW, _BEFORE = _sql(6, "2001-01-01"), _sql(5, "2000-01-01")


def _delta(name: str, key: str) -> str:
    """Keys of rows that the prior release lacks or has otherwise."""
    rest = "* EXCLUDE (snapshot_month)" if name == "player_master" else "*"
    return f"SELECT {key} FROM (SELECT {rest} FROM ({_NOW[name]}) EXCEPT SELECT {rest} FROM ({_BEFORE[name]}))"


_ALSO = {
    "player_master": ("player_id", [f"SELECT player_id FROM ({_NOW['player_registrations']})", f"SELECT player_id FROM ({_NOW['match_team_players']})", _delta("club_memberships", "player_id"), _delta("team_memberships", "player_id")]),
    "teams": ("id", [_delta("team_memberships", "team_id"), f"SELECT team_id FROM ({_NOW['match_teams']})"]),
    "clubs": ("id", [_delta("club_memberships", "club_id")]),
    "club_memberships": ("id", []),
    "team_memberships": ("id", []),
    "regions": ("id", []),
}

for _name, _text in _NOW.items():
    add(f"release_{_name}", partial(lambda t, name: snapshots.SNAPSHOT[name](t, UPDATE), name=_name), f"SELECT * FROM ({_text})")
for _name, (_key, _more) in _ALSO.items():
    _ids = " UNION ".join([_delta(_name, _key), *_more])
    add(f"release_update_{_name}", partial(lambda t, name: snapshots.incremental(name, t, UPDATE), name=_name), f"SELECT * FROM ({_NOW[_name]}) WHERE {_key} IN ({_ids})")


# --- checks of a release ----------------------------------------------------------------

_REFERENCES = (("match_teams", "match_id", "matches", "id"), ("match_team_players", "match_team_id", "match_teams", "id"), ("match_games", "match_id", "matches", "id"), ("team_memberships", "team_id", "teams", "id"), ("team_memberships", "player_id", "player_master", "player_id"), ("club_memberships", "club_id", "clubs", "id"), ("player_master", "home_region_id", "regions", "id"), ("match_team_players", "player_id", "player_master", "player_id"), ("player_assessment_history", "player_id", "player_master", "player_id"), ("player_assessment_history", "batch_id", "monthly_batches", "id"))
_REQUIRED = (("player_master", "rating_value"), ("matches", "winning_team_id"), ("match_games", "winning_team_number"))


#: A rating state is there whole or not at all.
_COHERENT = "CASE WHEN rating_date IS NULL THEN rating_batch_id IS NULL AND rating_value IS NULL AND confidence_score IS NULL AND volatility_score IS NULL AND match_count_used IS NULL ELSE rating_batch_id IS NOT NULL AND rating_value IS NOT NULL END"
_TEMPORAL = (
    ("teams", "formation_date < snapshot_end"),
    ("teams", "dissolution_date IS NULL OR dissolution_date < snapshot_end"),
    ("teams", "dissolution_date IS NULL OR dissolution_date >= formation_date"),
    ("team_memberships", "joined_date < snapshot_end"),
    ("team_memberships", "left_date IS NULL OR left_date < snapshot_end"),
    ("club_memberships", "joined_date < snapshot_end"),
    ("club_memberships", "left_date IS NULL OR left_date < snapshot_end"),
    ("player_master", "registration_date < snapshot_end"),
    ("player_master", "rating_date IS NULL OR rating_date < snapshot_end"),
)


def _winners_in(made: dict[str, DataFrame]) -> DataFrame:
    """Matches with a winner, and whether it is one of their sides."""
    sides = made["match_teams"].select("match_id", F.col("team_id").alias("winning_team_id"), F.lit(True).alias("plays")).distinct()
    rows = made["matches"].where(F.col("winning_team_id").isNotNull()).select(F.col("id").alias("match_id"), "winning_team_id")
    return rows.join(sides, ["match_id", "winning_team_id"], "left").withColumn("plays", F.col("plays").isNotNull())


def _release_checks(t: dict[str, DataFrame]) -> DataFrame:
    made = {name: kept(f(t, UPDATE)) for name, f in snapshots.SNAPSHOT.items()}  # each is made once and checked from there
    out = [checks.unique(n, rows, snapshots.KEYS.get(n, "id")) for n, rows in made.items()] + [checks.not_empty(n, rows) for n, rows in made.items()]
    out += [checks.references(f"{c}.{fk}", made[c], fk, made[p], pk) for c, fk, p, pk in _REFERENCES] + [checks.required(f"{n}.{c}", made[n], c) for n, c in _REQUIRED]
    out.append(checks.holds("window", "matches.match_date", made["matches"], "match_date >= DATE '2000-01-01' AND match_date < DATE '2001-01-01'"))
    out.append(checks.holds("shape", "two teams", made["match_teams"].groupBy("match_id").agg(F.count("*").alias("k")), "k = 2"))
    out.append(checks.holds("coherence", "snapshot month", made["player_master"], "snapshot_month = DATE '2000-12-01'"))
    out.append(checks.holds("coherence", "rating state", made["player_master"], _COHERENT))
    out.append(checks.holds("shape", "winner plays", _winners_in(made), "plays"))
    sides = made["match_teams"].select(F.col("id").alias("match_team_id"))
    out.append(checks.holds("shape", "sides with players", sides.join(made["match_team_players"].select("match_team_id", F.lit(True).alias("has")).distinct(), "match_team_id", "left"), "has is not null"))
    out.append(checks.unique("monthly_batches.batch_month", made["monthly_batches"], "batch_month"))
    out += [checks.holds("temporal", f"{n}: {x}", made[n], x.replace("snapshot_end", "DATE '2001-01-01'")) for n, x in _TEMPORAL]
    out += [checks.references(f"{n}.batch_id", made[n], "batch_id", made["monthly_batches"], "id") for n in ("matches", "player_registrations")]
    out.append(checks.holds("shape", "two players", made["match_team_players"].groupBy("match_team_id").agg(F.count("*").alias("k")), "k = 2"))
    return checks.report(*out)


def _check_sql() -> str:
    rows = lambda name: f"({_NOW[name]})"
    one = lambda category, name, failures: f"SELECT '{category}' AS category, '{name}' AS name, CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END AS status, n AS failures FROM ({failures})"
    out = [one("primary_key", n, f"SELECT count(*) AS n FROM (SELECT {k} FROM {rows(n)} GROUP BY 1 HAVING count(*) > 1)") for n in _NOW for k in [snapshots.KEYS.get(n, "id")]]
    out += [one("not_empty", n, f"SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS n FROM {rows(n)}") for n in _NOW]
    out += [one("foreign_key", f"{c}.{fk}", f"SELECT count(*) AS n FROM {rows(c)} x WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {rows(p)} y WHERE y.{pk} = x.{fk})") for c, fk, p, pk in _REFERENCES]
    out += [one("required", f"{n}.{c}", f"SELECT count(*) AS n FROM {rows(n)} WHERE {c} IS NULL") for n, c in _REQUIRED]
    out.append(one("window", "matches.match_date", f"SELECT count(*) AS n FROM {rows('matches')} WHERE match_date < DATE '2000-01-01' OR match_date >= DATE '2001-01-01'"))
    out.append(one("coherence", "snapshot month", f"SELECT count(*) FILTER (WHERE snapshot_month <> DATE '2000-12-01') AS n FROM {rows('player_master')}"))
    out.append(one("coherence", "rating state", f"SELECT count(*) FILTER (WHERE NOT ({_COHERENT})) AS n FROM {rows('player_master')}"))
    out.append(one("shape", "winner plays", f"SELECT count(*) AS n FROM {rows('matches')} m WHERE winning_team_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {rows('match_teams')} s WHERE s.match_id = m.id AND s.team_id = m.winning_team_id)"))
    out.append(one("shape", "sides with players", f"SELECT count(*) AS n FROM {rows('match_teams')} s WHERE NOT EXISTS (SELECT 1 FROM {rows('match_team_players')} x WHERE x.match_team_id = s.id)"))
    out.append(one("primary_key", "monthly_batches.batch_month", f"SELECT count(*) AS n FROM (SELECT batch_month FROM {rows('monthly_batches')} GROUP BY 1 HAVING count(*) > 1)"))
    out += [one("temporal", f"{n}: {x}", f"SELECT count(*) FILTER (WHERE NOT ({x.replace('snapshot_end', "DATE '2001-01-01'")})) AS n FROM {rows(n)}") for n, x in _TEMPORAL]
    out += [one("foreign_key", f"{n}.batch_id", f"SELECT count(*) AS n FROM {rows(n)} WHERE batch_id IS NOT NULL AND batch_id NOT IN (SELECT id FROM {rows('monthly_batches')})") for n in ("matches", "player_registrations")]
    out += [one("shape", name, f"SELECT count(*) AS n FROM (SELECT {key} FROM {rows(table)} GROUP BY 1 HAVING count(*) <> 2)") for name, table, key in (("two teams", "match_teams", "match_id"), ("two players", "match_team_players", "match_team_id"))]
    return " UNION ALL ".join(out)


add("release_checks", _release_checks, _check_sql())


# --- what matches and ratings start from ------------------------------------------------

_SUMMARY = """SELECT match_id, count(*) AS games, count(*) FILTER (WHERE team_one_score > team_two_score) AS games_one, count(*) FILTER (WHERE team_two_score > team_one_score) AS games_two, CAST(sum(team_one_score) AS BIGINT) AS points_one, CAST(sum(team_two_score) AS BIGINT) AS points_two,
    round(avg(CASE WHEN team_one_score + team_two_score = 0 THEN 0.5 ELSE team_one_score::DOUBLE / (team_one_score + team_two_score) END), 6) AS share_one FROM match_games GROUP BY 1"""
_WON = f"SELECT *, CASE WHEN games_one > games_two THEN 1 WHEN games_two > games_one THEN 2 END AS winning_team_number FROM ({_SUMMARY})"

add("match_summaries", snapshots.match_summaries, _WON)
add("resolved_winners", snapshots.resolved_winners, f"""
    WITH s AS (SELECT match_id, max(source_team_id) FILTER (WHERE team_number = 1) AS a, max(source_team_id) FILTER (WHERE team_number = 2) AS b FROM match_teams GROUP BY 1),
    x AS (SELECT m.id, m.winning_team_id, a, b, w.games_one - w.games_two AS g, w.points_one - w.points_two AS p, (CASE predicted_winning_team_number WHEN 1 THEN predicted_win_probability WHEN 2 THEN 1 - predicted_win_probability END) - 0.5 AS c
          FROM matches m JOIN s ON s.match_id = m.id LEFT JOIN ({_SUMMARY}) w ON w.match_id = m.id),
    d AS (SELECT *, CASE WHEN g <> 0 THEN 'games' WHEN p <> 0 THEN 'points' WHEN c <> 0 THEN 'chance' ELSE 'id' END AS decided_by FROM x),
    e AS (SELECT *, CASE decided_by WHEN 'games' THEN g > 0 WHEN 'points' THEN p > 0 WHEN 'chance' THEN c > 0 ELSE coalesce(a, 1) <= coalesce(b, 2) END AS first FROM d)
    SELECT id AS match_id, CASE WHEN first THEN a ELSE b END AS resolved_team_id, decided_by, winning_team_id IS NOT DISTINCT FROM CASE WHEN first THEN a ELSE b END AS agrees FROM e""")
add("eligible_teams", lambda t: snapshots.eligible_teams(t, F.lit(date(1998, 1, 1))), """
    SELECT t.id AS team_id, CASE WHEN e.event_type IS NOT NULL THEN e.event_type IN ('formed', 'reactivated') ELSE coalesce(formation_date <= DATE '1998-01-01' AND team_status = 'active' AND (dissolution_date IS NULL OR dissolution_date > DATE '1998-01-01'), false) END AS is_active,
           CASE WHEN e.event_type IS NOT NULL THEN 'team_lifecycle_events' ELSE 'teams' END AS decided_by
    FROM teams t LEFT JOIN (SELECT * FROM team_lifecycle_events WHERE event_date <= DATE '1998-01-01' QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY event_date DESC, id DESC) = 1) e ON e.team_id = t.id""")
add("initial_states", lambda t: snapshots.initial_states(t, 4), """
    SELECT p.id AS player_id, coalesce(h.rating_value, 1500.0::DOUBLE) AS rating, h.confidence_score AS confidence, coalesce(k, 0) AS rated_matches FROM players p
    LEFT JOIN (SELECT * FROM player_rating_history WHERE batch_id <= 4 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY rating_date DESC, id DESC) = 1) h ON h.player_id = p.id
    LEFT JOIN (SELECT player_id, count(*) AS k FROM player_rating_history WHERE batch_id <= 4 AND rating_type = 'match_update' GROUP BY 1) c ON c.player_id = p.id""")
add("recent_opponents", lambda t: snapshots.recent_opponents(t, F.lit(date(1999, 6, 1))), """
    SELECT least(a.source_team_id, b.source_team_id) AS low_id, greatest(a.source_team_id, b.source_team_id) AS high_id, max(match_date) AS met_on, count(*) AS meetings FROM matches m
    JOIN match_teams a ON a.match_id = m.id AND a.team_number = 1 JOIN match_teams b ON b.match_id = m.id AND b.team_number = 2 WHERE match_date >= DATE '1999-06-01' GROUP BY 1, 2""")
add("shared_clubs", snapshots.shared_clubs, """
    SELECT team_id, string_agg(club_id::VARCHAR, ',' ORDER BY club_id) AS clubs, CAST(count(*) AS INTEGER) AS n FROM (SELECT DISTINCT a.team_id, x.club_id FROM team_memberships a JOIN team_memberships b ON b.team_id = a.team_id AND a.player_position = 1 AND b.player_position = 2
    JOIN club_memberships x ON x.player_id = a.player_id JOIN club_memberships y ON y.player_id = b.player_id AND y.club_id = x.club_id) GROUP BY 1""")
add("unrated_players", snapshots.unrated_players, "SELECT id AS player_id FROM players EXCEPT SELECT player_id FROM player_rating_history WHERE rating_type = 'match_update'")


_LEAGUE = f"""
    g AS (SELECT m.batch_id, t.country_code, t.team_division, a.source_team_id AS one, b.source_team_id AS two, m.winning_team_id AS winner, coalesce(x.games_one, 0) AS games_one, coalesce(x.games_two, 0) AS games_two, coalesce(points_one, 0) AS points_one, coalesce(points_two, 0) AS points_two
          FROM matches m JOIN match_teams a ON a.match_id = m.id AND a.team_number = 1 JOIN match_teams b ON b.match_id = m.id AND b.team_number = 2 JOIN teams t ON t.id = a.source_team_id LEFT JOIN ({_SUMMARY}) x ON x.match_id = m.id WHERE m.winning_team_id IN (a.source_team_id, b.source_team_id)),
    s AS (SELECT batch_id, country_code, team_division, one AS team_id, two AS rival, winner = one AS won, games_one AS gw, games_two AS gl, points_one AS pf, points_two AS pa FROM g UNION ALL SELECT batch_id, country_code, team_division, two, one, winner = two, games_two, games_one, points_two, points_one FROM g),
    b AS (SELECT batch_id, country_code, team_division, team_id, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses, CAST(sum(gw) AS BIGINT) AS games_won, CAST(sum(gl) AS BIGINT) AS games_lost, CAST(sum(pf) AS BIGINT) AS points_for, CAST(sum(pa) AS BIGINT) AS points_against FROM s GROUP BY 1, 2, 3, 4),
    h AS (SELECT s.batch_id, s.country_code, s.team_division, s.team_id, count(*) FILTER (WHERE s.won) AS among FROM s JOIN b x USING (batch_id, country_code, team_division, team_id) JOIN b y ON y.batch_id = s.batch_id AND y.country_code = s.country_code AND y.team_division = s.team_division AND y.team_id = s.rival WHERE x.wins = y.wins GROUP BY 1, 2, 3, 4),
    r AS (SELECT b.*, games_won - games_lost AS game_diff, points_for - points_against AS point_diff, CAST(row_number() OVER (PARTITION BY batch_id, country_code, team_division ORDER BY wins DESC, coalesce(among, 0) DESC, games_won - games_lost DESC, points_for - points_against DESC, sha256('cup:' || team_id), team_id) AS INTEGER) AS place FROM b LEFT JOIN h USING (batch_id, country_code, team_division, team_id))"""


def _league(t: dict[str, DataFrame]) -> DataFrame:
    one, two = (t["match_teams"].where(F.col("team_number") == k).select("match_id", F.col("source_team_id").alias(n)) for k, n in ((1, "one"), (2, "two")))
    rows = t["matches"].select(F.col("id").alias("match_id"), "batch_id", F.col("winning_team_id").alias("winner")).join(one, "match_id").join(two, "match_id").where("winner = one or winner = two")
    rows = rows.join(t["teams"].select(F.col("id").alias("one"), "country_code", "team_division"), "one").join(snapshots.match_summaries(t).select("match_id", "games_one", "games_two", "points_one", "points_two"), "match_id", "left")
    return tournament.league_table(rows, ["batch_id", "country_code", "team_division"], "cup")


add("league_tables", _league, f"WITH {_LEAGUE} SELECT * FROM r")
add("league_credits", lambda t: tournament.credits(_league(t), t["portfolio_picks"]), f"""
    WITH {_LEAGUE}, k AS (SELECT DISTINCT group_id, team_id FROM portfolio_picks)
    SELECT group_id, sum(wins * 1.0::DOUBLE + CASE place WHEN 1 THEN 10 WHEN 2 THEN 6 ELSE 0 END + CASE WHEN place <= 4 THEN 3 ELSE 0 END) AS score, count(*) FILTER (WHERE place = 1) AS champions, count(*) FILTER (WHERE place = 2) AS runners_up, count(*) FILTER (WHERE place <= 4) AS top_four, CAST(sum(wins) AS BIGINT) AS match_wins FROM r JOIN k USING (team_id) GROUP BY 1""")
add("opponent_days", lambda t: snapshots.opponent_days(t, F.lit(date(1999, 6, 1))), """
    SELECT least(a.source_team_id, b.source_team_id) AS low_id, greatest(a.source_team_id, b.source_team_id) AS high_id, string_agg(DISTINCT match_date::VARCHAR, ',' ORDER BY match_date::VARCHAR) AS days FROM matches m
    JOIN match_teams a ON a.match_id = m.id AND a.team_number = 1 JOIN match_teams b ON b.match_id = m.id AND b.team_number = 2 WHERE match_date >= DATE '1999-06-01' GROUP BY 1, 2""")

_STATES = "SELECT id AS player_id, CAST(id * 31 % 5000 AS DOUBLE) AS rating, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 50 AS DOUBLE) / 64 END AS confidence, id % 15 AS match_count FROM players"


def _rating_fold(t: dict[str, DataFrame]) -> DataFrame:
    shares = [F.round(c, 4).alias(c) for c in ("expected_score_share", "actual_score_share")]
    states = t["players"].select(F.col("id").alias("player_id"), (F.col("id") * 31 % 5000).cast("double").alias("rating"), F.when(F.col("id") % 5 != 0, (F.col("id") % 50).cast("double") / 64).alias("confidence"), (F.col("id") % 15).alias("match_count"))
    return ratings.fold(t["ratings_update_log"].select("player_id", "match_date", "match_id", *shares), states)


add("rating_fold", _rating_fold, f"""
    SELECT * FROM (WITH RECURSIVE st AS (SELECT player_id, CAST(rating AS DECIMAL(8,3)) AS r, CAST(round(confidence, 3) AS DECIMAL(8,3)) AS c, match_count AS n FROM ({_STATES})),
    u AS (SELECT player_id, match_date, match_id, e, a, row_number() OVER (PARTITION BY player_id ORDER BY match_date, match_id, e, a) AS i FROM (SELECT player_id, match_date, match_id, CAST(round(expected_score_share, 4) AS DECIMAL(8,4)) AS e, CAST(round(actual_score_share, 4) AS DECIMAL(8,4)) AS a FROM ratings_update_log)),
    f AS (SELECT player_id, 0::BIGINT AS i, NULL::DATE AS match_date, NULL::BIGINT AS match_id, NULL::DECIMAL(8,3) AS k, NULL::DECIMAL(8,3) AS before, r, NULL::DECIMAL(8,3) AS sure, c, n FROM st
        UNION ALL SELECT player_id, i, match_date, match_id, k, r, CAST(greatest(0, least(5000, r + CAST(round(k * (a - e), 3) AS DECIMAL(8,3)))) AS DECIMAL(8,3)), c, CASE WHEN c IS NOT NULL THEN CAST(least(1, c + 0.02) AS DECIMAL(8,3)) END, n + 1
        FROM (SELECT f.player_id, u.i, u.match_date, u.match_id, u.e, u.a, f.r, f.c, f.n, CAST(CASE WHEN f.r >= 4000 THEN 16 WHEN f.n < 10 THEN 48 ELSE 24 END AS DECIMAL(8,3)) AS k FROM f JOIN u ON u.player_id = f.player_id AND u.i = f.i + 1))
    SELECT player_id, match_date, match_id, k AS k_factor, before AS rating_before, r - before AS rating_delta, r AS rating_after, sure AS confidence_before, c AS confidence_after, n AS match_count FROM f WHERE i > 0)""")


# --- hidden influences and pairs --------------------------------------------------------

_SIDE = {"age": "20 + id % {a} + 0.5::DOUBLE", "recent_games": "CASE WHEN id % 9 = 0 THEN NULL ELSE id % {b} END", "days_rest": "CASE WHEN id % 8 = 0 THEN NULL ELSE id % {c} END", "region_strength": "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % {a} - 15 AS DOUBLE) END", "shared_club": "id % {c} = 0", "prior_matches": "CASE WHEN id % 11 = 0 THEN NULL ELSE id % {a} END", "recent_matches": "id % {c}", "rating": "CAST(id * {b} % 5000 AS DOUBLE)"}
_INFLUENCED = "SELECT id AS match_id, " + ", ".join(f"{x.format(a=a, b=b, c=c)} AS {side}_{n}" for side, a, b, c in (("one", 41, 13, 5), ("two", 47, 17, 4)) for n, x in _SIDE.items()) + " FROM matches"


def _influence(me: str, other: str) -> str:
    """The capped total for one side, in SQL."""
    held = lambda x, low, high: f"greatest({low}::DOUBLE, least({high}::DOUBLE, {x}))"
    close = lambda times: f"CASE WHEN competitiveness >= 0.75 THEN {times}::DOUBLE ELSE 1.0::DOUBLE END"
    prior = f"coalesce({me}_prior_matches, 0)"
    age = held(f"({other}_age - {me}_age) * 1.25::DOUBLE * {close(1.5)}", -35.0, 35.0)
    fatigue = f"CASE WHEN coalesce({me}_days_rest >= 3, false) THEN 0.0 ELSE -{held(f'coalesce({me}_recent_games, 0) * 2.0::DOUBLE', 0.0, 25.0)} END"
    region = held(f"coalesce({me}_region_strength, 0) - coalesce({other}_region_strength, 0)", -20.0, 20.0)
    affinity = held(f"CASE WHEN {me}_shared_club THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN {prior} >= 25 THEN 12.0::DOUBLE WHEN {prior} >= 10 THEN 8 WHEN {prior} = 0 THEN -10 ELSE 0 END + CASE WHEN {me}_recent_matches > 0 THEN 5 ELSE 0 END", -25.0, 25.0)
    experience = held(f"ln(1 + {prior}::DOUBLE) * 2.0::DOUBLE * {close(1.25)}", 0.0, 15.0)
    return held(f"{age} + ({fatigue}) + {region} + {affinity} + {experience}", -50.0, 50.0)


_ELO = "round(1 / (1 + pow(10.0::DOUBLE, ({two} - {one}) / 400.0)), 4)"


def _adjusted(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["matches"].sparkSession.sql(_INFLUENCED.replace("::DOUBLE", "D").replace("FROM matches", "FROM {matches}"), matches=t["matches"])
    out = ratings.adjusted_chances(rows)
    return out.select("match_id", "visible_chance", "competitiveness", *[F.round(f"{s}_effective", 6).alias(f"{s}_effective") for s in ("one", "two")], "chance")


add("adjusted_chances", _adjusted, f"""
    WITH x AS ({_INFLUENCED}), v AS (SELECT *, {_ELO.format(one='one_rating', two='two_rating')} AS visible_chance FROM x), c AS (SELECT *, round(1 - abs(visible_chance - 0.5) * 2, 3) AS competitiveness FROM v),
    e AS (SELECT *, one_rating + {_influence('one', 'two')} AS one_effective, two_rating + {_influence('two', 'one')} AS two_effective FROM c)
    SELECT match_id, visible_chance, competitiveness, round(one_effective, 6) AS one_effective, round(two_effective, 6) AS two_effective, {_ELO.format(one="one_effective", two="two_effective")} AS chance FROM e""")

_PAIRED = "SELECT id AS team_id, CAST(id * 31 % 5000 AS DOUBLE) AS first_rating, CAST(id * 17 % 5000 AS DOUBLE) AS second_rating, id % 9 AS first_region, id % 4 AS second_region, id % 3 = 0 AS shared_club, id % 30 AS prior_count, id % 6 AS first_load, id % 11 AS second_load FROM teams"


def _weights(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["teams"].sparkSession.sql(_PAIRED.replace("FROM teams", "FROM {teams}"), teams=t["teams"])
    return rows.select("team_id", F.round(tournament.pair_weight("semi_competitive", 400.0, 2000.0, 2), 6).alias("weight"))


add("ad_hoc_pair_weights", _weights, f"""
    SELECT team_id, round(greatest(0.01, 1 + greatest(0.05, 1 - abs(first_rating - second_rating) / 400) + CASE WHEN first_region = second_region THEN 1.0 ELSE 0.25 END + CASE WHEN first_region = 2 OR second_region = 2 THEN 0.75 ELSE 0 END + CASE WHEN shared_club THEN 0.5 ELSE 0 END
        + greatest(0.05, 1 - abs((first_rating + second_rating) / 2 - 2000) / 400) + least(prior_count * 0.10, 1) - 0.05 * (first_load + second_load))::DOUBLE, 6) AS weight FROM ({_PAIRED})""")


# --- run-time reports -------------------------------------------------------------------


def _report(name: str, run: Callable[..., DataFrame], sql: str, *args) -> None:
    add(f"report_{name}", lambda t: run({**t, "generation_runtime_metrics": t["runtime_details"]}, *args), sql)


def _shares(rows: str, whole: str | None = None) -> str:
    return f"""SELECT subphase_name, count(*) AS metric_rows, round(sum(elapsed_ms)::DOUBLE / 1000, 3) AS elapsed_seconds, round(100.0::DOUBLE * sum(elapsed_ms)::DOUBLE / (SELECT nullif(sum(elapsed_ms), 0) FROM runtime_details WHERE {whole or rows}), 2) AS pct_of_whole,
        round(avg(elapsed_ms) / 1000, 3) AS avg_seconds, round(max(elapsed_ms)::DOUBLE / 1000, 3) AS max_seconds, CAST(sum(input_count) AS BIGINT) AS input_count, CAST(sum(output_count) AS BIGINT) AS output_count, CAST(sum(attempt_count) AS BIGINT) AS attempt_count FROM runtime_details WHERE {rows} GROUP BY 1"""


_report("subphases_by_batch", reports.subphases_by_batch, """
    SELECT r.id, batch_sequence, batch_month, r.batch_id, subphase_name, event_type, round(elapsed_ms::DOUBLE / 1000, 3) AS elapsed_seconds, input_count, output_count, attempt_count, started_at, completed_at
    FROM runtime_details r LEFT JOIN monthly_batches b ON b.id = r.batch_id WHERE stage_name = 'matches'""", "matches")
for _name, _stage in (("pipeline_stages", "monthly_pipeline"), ("player_totals", "players"), ("rating_totals", "ratings")):
    _report(_name, reports.stage_totals, _shares(f"stage_name = '{_stage}' AND event_type = 'completed'"), _stage)
for _name, _part in (("planning", "planning"), ("scoring", "scoring"), ("persistence", "persist_match_related_rows")):
    _report(_name, reports.detail_totals, _shares(f"stage_name = 'matches' AND json_extract_string(metadata_json, '$.parent_subphase') = '{_part}'", f"stage_name = 'matches' AND subphase_name = '{_part}' AND event_type = 'completed'"), "matches", _part)
_report("player_batches", reports.batch_spans, """
    SELECT batch_sequence, batch_month, b.id AS batch_id, round(sum(elapsed_ms)::DOUBLE / 1000, 3) AS measured_seconds, CAST(floor(epoch(max(completed_at))) - floor(epoch(min(started_at))) AS BIGINT) AS span_seconds,
           round(sum(elapsed_ms) FILTER (WHERE subphase_name = 'click')::DOUBLE / 1000, 3) AS synthesize_seconds, round(sum(elapsed_ms) FILTER (WHERE subphase_name = 'view')::DOUBLE / 1000, 3) AS player_flush_seconds,
           max(output_count) FILTER (WHERE subphase_name = 'refund') AS name_lookup_queries
    FROM monthly_batches b LEFT JOIN runtime_details r ON r.batch_id = b.id AND stage_name = 'players' AND event_type = 'completed' WHERE b.generation_run_id = 1 GROUP BY 1, 2, 3""", "players", {"synthesize": "click", "player_flush": "view"}, {"name_lookup_queries": "refund"}, 1)
