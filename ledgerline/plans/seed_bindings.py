"""Regions, names by state, release windows, events of teams and ids of pairs bound to the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import pairs, releases, sampling, seeds

from . import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(domain.tables(spark, sf_dir))
        ORACLE_SQL[f.__name__] = domain.oracle(sql)
        return f

    return add


_METROS = "(SELECT p.id, g.country_code, g.state_province_code, p.first_name AS region_name, p.id * 10 AS population FROM players p JOIN regions g ON g.id = p.home_region_id)"


@query(f"""
    WITH m AS (SELECT country_code, state_province_code, region_name, CAST(sum(population) AS BIGINT) AS population, min(id) AS first_id FROM {_METROS} GROUP BY 1, 2, 3)
    SELECT *, CASE country_code WHEN 'US' THEN 'MSA' ELSE 'metro' END AS region_type FROM m""")
def metro_regions(t: dict[str, DataFrame]) -> DataFrame:
    rows = seeds.metro_regions(_metros(t))
    return rows.select("country_code", "state_province_code", "region_name", "population", F.col("latitude").alias("first_id"), "region_type")


def _metros(t: dict[str, DataFrame]) -> DataFrame:
    places = t["regions"].select(F.col("id").alias("home_region_id"), "country_code", "state_province_code")
    rows = t["players"].join(places, "home_region_id")
    return rows.select("id", "country_code", "state_province_code", F.col("first_name").alias("region_name"), (F.col("id") * 10).alias("population"), F.col("id").alias("latitude"), F.col("id").alias("longitude"))


@query(f"""
    WITH m AS (SELECT country_code, state_province_code, region_name, CAST(sum(population) AS BIGINT) AS population FROM {_METROS} GROUP BY 1, 2, 3)
    SELECT country_code, state_province_code, region_name, population, row_number() OVER (PARTITION BY country_code ORDER BY population DESC, region_name) AS place FROM m
    QUALIFY place <= 10""")
def largest_metros(t: dict[str, DataFrame]) -> DataFrame:
    return seeds.largest_regions(seeds.metro_regions(_metros(t))).select("country_code", "state_province_code", "region_name", "population", F.col("place").cast("long").alias("place"))


@query("""
    WITH m AS (SELECT m.team_id, bool_or(coalesce(player_status = 'RETIRED', false)) AS gone FROM team_memberships m JOIN players p ON p.id = m.player_id GROUP BY 1),
    s AS (SELECT team_id, CASE WHEN gone THEN 'retired' ELSE 'active' END AS team_status FROM m)
    SELECT s.team_id, CASE WHEN s.team_status = 'active' THEN 'reactivated' ELSE s.team_status END AS event_type, DATE '2001-01-01' AS event_date FROM s JOIN teams b ON b.id = s.team_id WHERE s.team_status <> b.team_status""")
def team_status_events(t: dict[str, DataFrame]) -> DataFrame:
    members = t["team_memberships"].join(t["players"].select(F.col("id").alias("player_id"), "player_status"), "player_id")
    return sampling.lifecycle_events(sampling.team_status(members), t["teams"].select(F.col("id").alias("team_id"), "team_status"), "2001-01-01")


@query("""
    WITH r AS (SELECT team_id, min(player_id) AS a, max(player_id) AS b, min(joined_date) AS since FROM team_memberships GROUP BY 1 HAVING count(DISTINCT player_id) = 2),
    w AS (SELECT DISTINCT a AS low_id, b AS high_id FROM r), k AS (SELECT a AS low_id, b AS high_id, min(team_id) AS team_id FROM r WHERE since < DATE '1996-01-01' GROUP BY 1, 2)
    SELECT low_id, high_id, team_id AS known_id, team_id IS NULL AS is_new FROM w LEFT JOIN k USING (low_id, high_id)""")
def pair_identities(t: dict[str, DataFrame]) -> DataFrame:
    rosters = t["team_memberships"].groupBy("team_id").agg(F.min("player_id").alias("a"), F.max("player_id").alias("b"), F.min("joined_date").alias("since"), F.count_distinct("player_id").alias("n")).where("n = 2")
    known = rosters.where("since < DATE '1996-01-01'").groupBy(F.col("a").alias("low_id"), F.col("b").alias("high_id")).agg(F.min("team_id").alias("team_id"))
    ids = sampling.pair_ids(rosters, known, "b", "a")
    return ids.select("low_id", "high_id", F.when(~F.col("is_new"), F.col("team_id")).alias("known_id"), "is_new")


@query(f"""
    WITH m AS (SELECT country_code, state_province_code, region_name, CAST(sum(population) AS BIGINT) AS population FROM {_METROS} WHERE country_code <> 'MX' GROUP BY 1, 2, 3),
    f AS (SELECT country_code, state_province_code, min(g.region_name) AS region_name FROM clubs c JOIN regions g ON g.id = c.region_id GROUP BY 1, 2)
    SELECT country_code, state_province_code, region_name, CASE country_code WHEN 'US' THEN 'MSA' ELSE 'metro' END AS region_type, population, round(population::DOUBLE / sum(population) OVER (), 8) AS selection_probability FROM m
    UNION ALL SELECT country_code, state_province_code, region_name, 'territory', NULL, 0 FROM f WHERE (country_code, state_province_code) NOT IN (SELECT (country_code, state_province_code) FROM m)""")
def regions_with_territories(t: dict[str, DataFrame]) -> DataFrame:
    states = t["regions"].select(F.col("id").alias("region_id"), "country_code", "state_province_code", F.col("region_name").alias("state_province_name"))
    targets = t["clubs"].join(states, "region_id").groupBy("country_code", "state_province_code").agg(F.min("state_province_name").alias("state_province_name"), F.count("*").alias("target_club_count"))
    rows = seeds.with_territories(seeds.metro_regions(_metros(t).where("country_code <> 'MX'")), targets)
    return rows.select("country_code", "state_province_code", "region_name", "region_type", "population", "selection_probability")


# --- last names by state ----------------------------------------------------------------

_NAMED = "(SELECT g.country_code, p.last_name FROM players p JOIN regions g ON g.id = p.home_region_id)"


def _named(t: dict[str, DataFrame]) -> DataFrame:
    return t["players"].join(t["regions"].select(F.col("id").alias("home_region_id"), "country_code"), "home_region_id").select("country_code", "last_name")


@query(f"""
    WITH n AS (SELECT country_code, last_name, count(*) AS k FROM {_NAMED} GROUP BY 1, 2), s AS (SELECT DISTINCT country_code, state_province_code FROM regions),
    b AS (SELECT country_code, state_province_code, last_name, length(last_name) * 0.75::DOUBLE AS m FROM last_names),
    a AS (SELECT country_code, state_province_code, last_name, k, coalesce(m, 1.0::DOUBLE) AS bias_multiplier FROM n JOIN s USING (country_code) LEFT JOIN b USING (country_code, state_province_code, last_name))
    SELECT country_code, state_province_code, last_name, k AS frequency_count, bias_multiplier, round(k * bias_multiplier / sum(k * bias_multiplier) OVER (PARTITION BY country_code, state_province_code), 8) AS probability FROM a""")
def last_name_shares(t: dict[str, DataFrame]) -> DataFrame:
    names = _named(t).groupBy("country_code", "last_name").agg(F.count("*").alias("frequency_count"))
    biases = t["last_names"].withColumn("bias_multiplier", F.length("last_name") * F.lit(0.75))
    rows = seeds.last_name_probabilities(names, t["regions"], biases)
    return rows.select("country_code", "state_province_code", "last_name", "frequency_count", "bias_multiplier", F.col("normalized_probability").alias("probability"))


@query(f"""
    WITH b AS (SELECT country_code, state_province_code, last_name FROM last_names UNION ALL SELECT country_code, state_province_code, first_name FROM first_names WHERE gender = 'F'), n AS {_NAMED}
    SELECT 'duplicate' AS problem, country_code, state_province_code, last_name FROM b GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'unknown_name', country_code, state_province_code, last_name FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.country_code = b.country_code AND n.last_name = b.last_name)""")
def name_bias_problems(t: dict[str, DataFrame]) -> DataFrame:
    strange = t["first_names"].where("gender = 'F'").select("country_code", "state_province_code", F.col("first_name").alias("last_name"))
    return seeds.bias_problems(t["last_names"].unionByName(strange), _named(t))


# --- windows and rosters ----------------------------------------------------------------


@query("""
    WITH b AS (SELECT DISTINCT CAST(date_trunc('month', match_date) AS DATE) AS month FROM matches),
    o AS (SELECT month, row_number() OVER w AS n, lag(month) OVER w AS prior, min(month) OVER () AS earliest FROM b WINDOW w AS (ORDER BY month)),
    g AS (SELECT *, bool_and(prior IS NULL OR prior + INTERVAL 1 MONTH = month) OVER (ORDER BY month) AS contiguous FROM o)
    SELECT CAST(n - 11 AS INTEGER) AS release, CASE WHEN n = 12 THEN 'historical_baseline' ELSE 'monthly_update' END AS kind, CASE WHEN n = 12 THEN earliest ELSE month END AS facts_from, month AS facts_to,
        earliest AS snapshot_from, month AS snapshot_to, CASE WHEN n > 12 THEN prior END AS prior_to, CAST(n AS INTEGER) AS months, contiguous FROM g WHERE n >= 12""")
def release_windows(t: dict[str, DataFrame]) -> DataFrame:
    return releases.planned(t["matches"], "match_date", 12)


@query("SELECT team_id, CAST(to_json(list(player_id ORDER BY player_position, player_id)) AS VARCHAR) AS roster FROM team_memberships GROUP BY team_id")
def team_roster_lists(t: dict[str, DataFrame]) -> DataFrame:
    return pairs.ordered_json(t["team_memberships"], ["team_id"], ["player_position", "player_id"], "player_id", "roster")
