"""Certification, trends of batch sizes and clubs of a state bound to the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import clubs, history, quality, seeds

from . import audit, audit_oracle, certify, domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(domain.tables(spark, sf_dir))
        ORACLE_SQL[f.__name__] = domain.oracle(sql)
        return f

    return add


# --- certification ----------------------------------------------------------------------

#: The results that are certified, and their rules' measures in SQL, in the order of the rules.
MEASURES = {
    "player_status_distribution": ["max(abs(pct_point_drift))"],
    "weekend_match_share": ["max(abs(outside_config_range))"],
    "club_fill_ratio_summary": ["max(abs(over_capacity_club_count))"],
    "team_assignment_delay_summary": ["max(abs(avg_days_to_first_team))", f"greatest(0, ({certify.ON_TEAMS * certify.COMPETITIVE!r}::DOUBLE - coalesce(max(ever_teamed_player_count)::DOUBLE / nullif(max(player_count), 0), 0)) * 100)"],
    "chemistry_effectiveness": ["max(abs(win_rate_minus_expected))"],
    "rating_predictiveness": ["min(favorite_win_rate)"],
    "regional_strength_balance": ["CASE WHEN count(avg_rating) > 1 THEN max(avg_rating) - min(avg_rating) END"],
    "repeat_partner_frequency": ["CASE WHEN count(*) FILTER (WHERE repeat_match_count > 1) = 0 THEN max(partnership_pct) FILTER (WHERE repeat_match_count = 1) END"],
    "repeat_opponent_rate": ["CASE WHEN count(*) > 0 THEN coalesce(sum(matchup_pair_pct) FILTER (WHERE meeting_count >= 3), 0) END"],
    "elite_player_depth": ["min(elite_player_count)"],
    "missing_gold_inputs": ["max(abs(missing_flag))"],
    "historical_run_size_regression": ["greatest(max(abs(player_growth_pct)), max(abs(team_growth_pct)), max(abs(match_growth_pct)))"],
    "historical_release_file_coverage": ["count(*) FILTER (WHERE status <> 'succeeded' OR file_count <= 0 OR total_row_count <= 0)"],
    "match_winner_integrity": ["count(*)"],
    "daily_team_match_cap_violations": ["count(*)"],
}
RULES = tuple(r for r in certify.RULES if r.query in MEASURES)


def _certified_sql() -> str:
    left = {q: list(m) for q, m in MEASURES.items()}
    rows = []
    for r in RULES:
        limit = lambda x: "NULL::DOUBLE" if x is None else f"{float(x)!r}::DOUBLE"
        rows.append(f"SELECT '{r.pillar}' AS pillar, '{r.query}' AS query, {limit(r.warning)} AS warning, {limit(r.error)} AS error, {r.low} AS low, {r.blocks} AS blocks, CAST((SELECT {left[r.query].pop(0)} FROM ({audit_oracle.SQL[r.query]})) AS DOUBLE) AS value")
    severity = "CASE rank WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'blocker' END AS severity"
    return f"""
        WITH m AS MATERIALIZED ({" UNION ALL ".join(rows)}),
        k AS (SELECT pillar, query, CASE WHEN value IS NULL THEN 0 WHEN CASE WHEN low THEN value < error ELSE value >= error END THEN CASE WHEN blocks THEN 3 ELSE 2 END WHEN CASE WHEN low THEN value < warning ELSE value >= warning END THEN 1 ELSE 0 END AS rank FROM m),
        w AS (SELECT pillar, query, max(rank) AS rank FROM k GROUP BY 1, 2),
        p AS (SELECT pillar, count(*) AS queries, max(rank) AS rank, round_even(100 - sum(CASE rank WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 25 END)::DOUBLE / count(*), 1) AS score FROM w GROUP BY 1),
        o AS (SELECT CAST(sum(queries) AS BIGINT) AS queries, max(rank) AS rank, round_even(sum(score * queries) / sum(queries), 1) AS score, count(*) AS pillars FROM p)
        SELECT 'query' AS kind, query AS name, pillar, {severity}, 1::BIGINT AS queries, NULL::DOUBLE AS score, NULL AS decision FROM w
        UNION ALL SELECT 'pillar', pillar, pillar, {severity}, queries, score, NULL FROM p
        UNION ALL SELECT 'overall', 'all', NULL, {severity}, queries, score, CASE WHEN rank = 3 OR score < 80 THEN 'FAIL' WHEN score >= 95 AND pillars = 6 THEN 'PASS' ELSE 'REVIEW' END FROM o"""


@query(_certified_sql())
def certification(t: dict[str, DataFrame]) -> DataFrame:
    results = {q: audit.CATALOGUE[q].run(t, audit.DEFAULTS) for q in MEASURES}
    limits = certify.thresholds(t["players"].sparkSession, RULES)
    return certify.decided(certify.measured(results, RULES), limits)


@query("""
    WITH s AS (SELECT batch_id, count(*) AS n FROM matches GROUP BY 1),
    x AS (SELECT batch_id, n, regr_slope(n, batch_id) OVER w AS slope, regr_intercept(n, batch_id) OVER w AS intercept, count(*) OVER w AS earlier FROM s WINDOW w AS (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT *, CASE WHEN earlier >= 2 THEN round(slope * batch_id + intercept, 4) END AS expected FROM x),
    d AS (SELECT *, round(100.0::DOUBLE * (n - expected) / nullif(expected, 0), 2) AS delta_pct FROM e)
    SELECT batch_id, n, earlier, expected, delta_pct, CASE WHEN abs(delta_pct) >= 25 THEN 'error' WHEN abs(delta_pct) >= 15 THEN 'warning' ELSE 'ok' END AS severity FROM d""")
def batch_size_trend(t: dict[str, DataFrame]) -> DataFrame:
    sizes = t["matches"].groupBy("batch_id").agg(F.count("*").alias("n"))
    return history.trend(sizes, "batch_id", "n", 15, 25)


# --- clubs ------------------------------------------------------------------------------

_KINDS = (*clubs.TYPES, "Unknown Club")
_SIZES = tuple(clubs.CAPACITY)


def _of_id(values: tuple[str, ...], id_: str) -> str:
    return f"CASE {id_} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def club_inputs(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbers of clubs to have, names, regions): names only of clubs that state a capacity, so some states run short."""
    people = t["players"].groupBy(F.col("home_region_id").alias("id")).agg(F.count("*").alias("population"))
    regions = t["regions"].join(people, "id", "left").withColumn("population", F.coalesce("population", F.lit(0)))
    placed = t["clubs"].join(t["regions"].select(F.col("id").alias("region_id"), *clubs.SCOPE), "region_id")
    names = placed.where(F.col("member_capacity").isNotNull()).select(*clubs.SCOPE, F.col("id").alias("club_seed"), "club_name", F.expr(_of_id(_KINDS, "id")).alias("club_type"), F.expr(_of_id(_SIZES, "id")).alias("size_tier"))
    return placed.groupBy(*clubs.SCOPE).agg(F.count("*").cast("int").alias("target_club_count")), names, regions


def _hash(text: str) -> str:
    return f"CAST('0x' || substr(sha256({text}), 1, 16) AS UBIGINT)"


def _pick(column: str, values: dict, otherwise: object) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {otherwise!r} END"


def _span(text: str, ranges: dict) -> str:
    low, high = (_pick("size_tier", {k: v[i] for k, v in ranges.items()}, ranges["Small"][i]) for i in (0, 1))
    return f"CAST({low} + {_hash(text)} % CAST({high} - {low} + 1 AS UBIGINT) AS INTEGER)"


_FIRST, _LAST = (_pick("club_type", {k: v[i] for k, v in clubs.FOUNDED.items()}, clubs.FOUNDED_OTHERWISE[i]) for i in (0, 1))
_BORN = _hash("'founding|' || club_seed || '|' || club_type || '|' || size_tier")


@query(f"""
    WITH pop AS (SELECT g.*, coalesce(k, 0) AS population FROM regions g LEFT JOIN (SELECT home_region_id, count(*) AS k FROM players GROUP BY 1) c ON c.home_region_id = g.id),
    own AS (SELECT c.*, g.country_code, g.state_province_code FROM clubs c JOIN regions g ON g.id = c.region_id),
    q AS (SELECT country_code, state_province_code, count(*) AS target FROM own GROUP BY 1, 2),
    nm AS (SELECT country_code, state_province_code, id AS club_seed, club_name, {_of_id(_KINDS, 'id')} AS raw_type, {_of_id(_SIZES, 'id')} AS size_tier, row_number() OVER (PARTITION BY country_code, state_province_code ORDER BY id) - 1 AS index FROM own WHERE member_capacity IS NOT NULL),
    cnt AS (SELECT country_code, state_province_code, count(*) AS k FROM nm GROUP BY 1, 2),
    slot AS (SELECT country_code, state_province_code, coalesce(k, 0) AS k, unnest(range(target)) AS index FROM q LEFT JOIN cnt USING (country_code, state_province_code)),
    cand AS (SELECT country_code, state_province_code, index, CAST(club_seed AS UBIGINT) AS club_seed, club_name, raw_type, size_tier FROM nm JOIN q USING (country_code, state_province_code) WHERE index < target
        UNION ALL SELECT country_code, state_province_code, index, {_hash("'placeholder|' || country_code || '|' || state_province_code || '|' || index")}, 'Not Enough Club Names ' || state_province_code || '-' || (index + 1), 'Community Recreation Club', 'Tiny' FROM slot WHERE index >= k),
    wt AS (SELECT *, CASE WHEN sum(selection_probability) OVER (PARTITION BY country_code, state_province_code) > 0 THEN selection_probability ELSE 1 END AS w FROM pop WHERE country_code IN ('US', 'CA')),
    part AS (SELECT *, sum(w) OVER (PARTITION BY country_code, state_province_code ORDER BY region_name, id) AS cum, sum(w) OVER (PARTITION BY country_code, state_province_code) AS total FROM wt),
    host AS (SELECT id FROM wt WHERE population > 0 QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY population DESC, region_name) <= 10),
    at_ AS (SELECT *, CAST({_hash("club_seed || '|' || country_code || '|' || state_province_code || '|' || index")} AS DOUBLE) / 18446744073709551616.0::DOUBLE AS frac FROM cand),
    placed AS (SELECT a.country_code, a.state_province_code, a.index, a.club_seed, a.club_name, a.raw_type, p.id AS region_id, CASE WHEN a.size_tier = 'Mega' AND p.id NOT IN (SELECT id FROM host) THEN 'Large' ELSE a.size_tier END AS size_tier
        FROM at_ a JOIN part p ON p.country_code = a.country_code AND p.state_province_code = a.state_province_code AND frac >= (cum - w) / total AND (frac < cum / total OR cum >= total)),
    typed AS (SELECT *, {_pick('raw_type', clubs.TYPES, 'community_center')} AS club_type, size_tier IN ('Large', 'Mega') AS large FROM placed),
    more AS (SELECT *, {_span("'courts|' || club_seed", clubs.COURTS)} AS courts, {_BORN} AS born, CASE WHEN large THEN greatest(1970, {_FIRST} - 10) ELSE {_FIRST} END AS first_year, {_LAST} AS last_year FROM typed),
    ins AS (SELECT *, CAST(round_even(courts * {_pick('club_type', {k: float(v) for k, v in clubs.INDOOR.items()}, float(clubs.INDOOR_OTHERWISE))}::DOUBLE, 0) AS INTEGER) AS inside FROM more),
    cut AS (SELECT *, least(courts, CASE WHEN club_type = 'dedicated_facility' THEN greatest(1, inside) ELSE inside END) AS indoor_court_count FROM ins)
    SELECT country_code, state_province_code, CAST(index AS INTEGER) AS index, club_name, region_id, club_type, CASE WHEN raw_type IN ('Tournament Club', 'Competitive Training Club') THEN CASE WHEN large THEN 'elite' ELSE 'competitive' END WHEN raw_type IN ('League Organization', 'Indoor Facility Club', 'Private Athletic Club') THEN 'mixed' ELSE 'recreational' END AS competitiveness_level,
        size_tier, {_span('club_seed::VARCHAR', clubs.CAPACITY)} AS member_capacity, make_date(CAST(first_year + born % CAST(last_year - first_year + 1 AS UBIGINT) AS BIGINT), CAST(1 + (born // 32) % 12 AS BIGINT), CAST(1 + (born // 512) % 28 AS BIGINT)) AS founding_date, indoor_court_count, courts - indoor_court_count AS outdoor_court_count FROM cut""")
def club_assignment(t: dict[str, DataFrame]) -> DataFrame:
    return clubs.assigned(*club_inputs(t))


# --- names, ratings and differences that had no query -----------------------------------


@query("""
    WITH s AS (SELECT country_code, state_province_code, birth_year, gender, first_name, sum(frequency_count) AS k FROM first_names GROUP BY ALL)
    SELECT country_code, state_province_code, birth_year, gender, first_name, CAST(k AS BIGINT) AS frequency_count, round(k::DOUBLE / sum(k) OVER (PARTITION BY country_code, state_province_code, birth_year, gender), 8) AS probability FROM s""")
def first_name_shares(t: dict[str, DataFrame]) -> DataFrame:
    rows = seeds.first_name_probabilities(t["first_names"].withColumn("source_dataset", F.lit("names")))
    return rows.select("country_code", "state_province_code", "birth_year", "gender", "first_name", F.col("frequency_count").cast("long").alias("frequency_count"), F.round(F.col("normalized_probability").cast("double"), 8).alias("probability"))


_ADDED = "SELECT id + 100000000 AS id, team_type, upper(team_division) AS team_division, team_status FROM teams WHERE team_status = 'retired'"


@query(f"""
    WITH c AS (SELECT id, team_type, team_division, team_status FROM teams), x AS (SELECT * FROM c WHERE team_status <> 'dormant' UNION ALL {_ADDED}),
    a AS (SELECT * FROM x WHERE id NOT IN (SELECT id FROM c))
    SELECT (SELECT count(*) FROM c WHERE id NOT IN (SELECT id FROM x)) AS lost, (SELECT count(*) FROM a) AS added, (SELECT count(*) FROM a WHERE EXISTS (SELECT 1 FROM c WHERE c.team_type = a.team_type AND c.team_division = lower(a.team_division) AND c.team_status = a.team_status)) AS duplicate_like""")
def lost_and_added(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["teams"].select("id", "team_type", "team_division", "team_status")
    more = rows.where("team_status = 'retired'").withColumn("id", F.col("id") + 100000000).withColumn("team_division", F.upper("team_division"))
    return quality.lost_and_added(rows, rows.where("team_status <> 'dormant'").unionByName(more), "id", ["team_type", "team_division"], ["team_status"])
