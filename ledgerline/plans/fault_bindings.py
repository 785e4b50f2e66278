"""Exact faults and the checks after them, bound to the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import faults, quality

from . import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = {"missing": ("rating_type", "note"), "soft_join": ("note",), "outlier": ("rating_value",), "jitter": ("seen_on",)}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(domain.tables(spark, sf_dir))
        ORACLE_SQL[f.__name__] = domain.oracle(sql)
        return f

    return add


def injection(level: str) -> faults.Injection:
    return faults.Injection("ratings", "id", RULES, level, "exact", "7", "second")


def clean(t: dict[str, DataFrame]) -> DataFrame:
    return t["player_rating_history"].select("id", "player_id", "rating_date", "rating_type", F.concat(F.lit("land and sea "), "rating_type").alias("note"), "rating_value", F.col("rating_date").alias("seen_on"))


_CLEAN = "SELECT id, player_id, rating_date, rating_type, 'land and sea ' || rating_type AS note, rating_value, rating_date AS seen_on FROM player_rating_history"
_NEW = {
    ("missing", "rating_type"): "NULL",
    ("missing", "note"): "NULL",
    ("soft_join", "note"): "CASE k % 3 WHEN 0 THEN note || ' ' WHEN 1 THEN ' ' || note ELSE replace(note, 'and', '&') END",
    ("outlier", "rating_value"): "round(rating_value * (1.15::DOUBLE + k % 50 / 100.0::DOUBLE), 3)",
    ("jitter", "seen_on"): "CASE WHEN k % 2 = 0 THEN seen_on - 1 ELSE seen_on + 1 END",
}


def _turns(level: str) -> str:
    """The kinds' turns as common table expressions: m1, m2, ... hold the cells hit so far."""
    out = [f"r AS ({_CLEAN})", "m0 AS (SELECT 0::BIGINT AS id, '' AS column_name, '' AS issue_type, '' AS tainted_value WHERE false)"]
    for i, (kind, columns) in enumerate(RULES.items(), 1):
        k = "CAST('0x' || substr(sha256('exact|{kind}|{c}|' || id), 1, 13) AS BIGINT)"
        cells = " UNION ALL ".join(f"SELECT id, '{c}' AS column_name, k, CAST({_NEW[kind, c]} AS VARCHAR) AS tainted_value FROM (SELECT *, {k.format(kind=kind, c=c)} AS k FROM r) WHERE {c} IS NOT NULL AND ({_NEW[kind, c]}) IS DISTINCT FROM {c}" for c in columns)
        out.append(f"c{i} AS (SELECT c.*, coalesce(used, 0) AS used FROM ({cells}) c LEFT JOIN (SELECT id, count(*) AS used FROM m{i - 1} GROUP BY id) u ON u.id = c.id WHERE NOT EXISTS (SELECT 1 FROM m{i - 1} m WHERE m.id = c.id AND m.column_name = c.column_name))")
        out.append(f"w{i} AS (SELECT * FROM c{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, column_name) <= 2 - used)")
        rate = quality.rate_of(level, quality.FAMILY[kind])
        out.append(f"m{i} AS (SELECT * FROM m{i - 1} UNION ALL SELECT id, column_name, '{kind}', tainted_value FROM (SELECT * FROM w{i} QUALIFY row_number() OVER (ORDER BY k, id, column_name) <= (SELECT floor(count(*) * {rate!r}::DOUBLE) FROM r)))")
    return ", ".join(out)


_LAST = f"m{len(RULES)}"


@query(f"WITH {_turns('very_high')} SELECT id, column_name, issue_type FROM {_LAST}")
def exact_fault_cells(t: dict[str, DataFrame]) -> DataFrame:
    return faults.exact_cells(clean(t), injection("very_high")).select("id", "column_name", "issue_type")


@query(" UNION ALL ".join(f"SELECT '{level}' AS level, * FROM (WITH {_turns(level)} SELECT issue_type, count(*) AS cells, count(DISTINCT id) AS rows FROM {_LAST} GROUP BY 1)" for level in quality.LEVELS))
def fault_counts_by_level(t: dict[str, DataFrame]) -> DataFrame:
    out = None
    for level, found in faults.exact_cells_by_level(clean(t), injection("low"), list(quality.LEVELS)).items():
        cells = found.groupBy("issue_type").agg(F.count("*").alias("cells"), F.count_distinct("id").alias("rows")).select(F.lit(level).alias("level"), "issue_type", "cells", "rows")
        out = cells if out is None else out.unionByName(cells)
    return out


@query(f"""
    WITH {_turns('medium')} SELECT r.id, player_id, rating_date, CASE WHEN a.id IS NULL THEN rating_type END AS rating_type, CASE WHEN b.id IS NULL THEN note ELSE b.tainted_value END AS note, coalesce(CAST(c.tainted_value AS DOUBLE), rating_value) AS rating_value, coalesce(CAST(d.tainted_value AS DATE), seen_on) AS seen_on
    FROM r LEFT JOIN {_LAST} a ON a.id = r.id AND a.column_name = 'rating_type' LEFT JOIN {_LAST} b ON b.id = r.id AND b.column_name = 'note' LEFT JOIN {_LAST} c ON c.id = r.id AND c.column_name = 'rating_value' LEFT JOIN {_LAST} d ON d.id = r.id AND d.column_name = 'seen_on'""")
def exact_faults_applied(t: dict[str, DataFrame]) -> DataFrame:
    rows = clean(t)
    return faults.applied(rows, "id", faults.exact_cells(rows, injection("medium")))


def _checks_sql() -> str:
    one = lambda category, name, n: f"SELECT '{category}' AS category, '{name}' AS name, CAST({n} AS BIGINT) AS failures"
    size = "(SELECT count(*) FROM r)"
    hit = f"(SELECT count(DISTINCT id) FROM {_LAST}"
    out = [one("shape", "ratings", "0"), one("row_count", "ratings", "0"), one("primary_key", "ratings.id", "0")]
    out += [one("protected", f"ratings.{c}", "0") for c in ("id", "player_id", "rating_date")] + [one("protected", "ratings: manifest", "0")]
    out += [one("required", "ratings", f"(SELECT count(*) FROM {_LAST} WHERE column_name = 'rating_type' AND tainted_value IS NULL)"), one("limits", "fields a row", f"(SELECT count(*) FROM (SELECT id FROM {_LAST} GROUP BY 1 HAVING count(*) > 2))")]
    out.append(one("limits", "rows in all", f"greatest(0, {hit}) - floor({size} * 0.05::DOUBLE))"))
    highest = {k: quality.LEVELS["very_high"][quality.FAMILIES[quality.FAMILY[k]]][1] / 100 for k in RULES}
    out += [one("limits", k, f"greatest(0, {hit} WHERE issue_type = '{k}') - floor({size} * {x!r}::DOUBLE))") for k, x in highest.items()]
    return f"WITH {_turns('very_high')} SELECT category, name, CASE WHEN failures = 0 THEN 'passed' ELSE 'failed' END AS status, failures FROM ({' UNION ALL '.join(out)})"


@query(_checks_sql())
def injection_checks(t: dict[str, DataFrame]) -> DataFrame:
    rows, what = clean(t), injection("very_high")
    cells = faults.exact_cells(rows, what)
    return faults.injection_checks(rows, faults.applied(rows, "id", cells), cells, what, ["rating_type"])
