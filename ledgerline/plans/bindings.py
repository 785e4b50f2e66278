"""Operators bound to the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import checks, history, pairs, quality, ratings, reconcile, releases, sampling, tournament
from ledgerline.operators.shares import bucket, distribution, histogram_of_counts, normalised, pct, with_targets

from . import domain, panel, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id")
def latest_event_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return history.latest(rows, ["user_id"], ["ts", "event_id"], F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))


@query("SELECT o_orderstatus, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM orders GROUP BY 1")
def order_status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution(load(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 2) AS pct FROM orders GROUP BY 1, 2")
def priority_distribution_within_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", within=["o_orderstatus"])


@query("""
    WITH s AS (SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY 1),
    g(event_type, ordinal, configured_pct) AS (VALUES ('click', 0, 40.0::DOUBLE), ('view', 1, 30.0::DOUBLE), ('refund', 2, 5.0::DOUBLE))
    SELECT event_type, coalesce(n, 0) AS n, coalesce(pct, 0) AS pct, coalesce(ordinal, 3) AS ordinal, configured_pct, round(coalesce(pct, 0) - configured_pct, 2) AS pct_point_drift FROM s FULL JOIN g USING (event_type)""")
def event_type_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_targets(distribution(load(spark, sf_dir, "events"), "event_type"), "event_type", {"click": 40, "view": 30, "refund": 5})


@query("WITH c AS (SELECT o_custkey, count(*) AS times FROM orders GROUP BY 1) SELECT times, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM c GROUP BY 1")
def orders_per_customer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_of_counts(load(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT CASE WHEN l_quantity < 10 THEN 'under_10' WHEN l_quantity < 25 THEN '10_24' WHEN l_quantity < 40 THEN '25_39' ELSE '40_plus' END AS quantity_band, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM lineitem GROUP BY 1")
def quantity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = bucket(F.col("l_quantity"), [(10, "under_10"), (25, "10_24"), (40, "25_39")], "40_plus")
    return distribution(load(spark, sf_dir, "lineitem").select(band.alias("quantity_band")), "quantity_band")


@query("""
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2)
    SELECT a.user_id, a.day, a.kinds, CAST(coalesce(sum(b.kinds), 0) AS BIGINT) AS recent FROM d a LEFT JOIN d b ON b.user_id = a.user_id AND b.day BETWEEN a.day - 14 AND a.day - 1 GROUP BY 1, 2, 3""")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = load(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.countDistinct("event_type").alias("kinds"))
    return history.look_back(daily, "user_id", "day", "kinds", 14, "recent")


@query("""
    WITH e AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
    d AS (SELECT CAST(unnest(range(31)) AS INTEGER) AS day)
    SELECT d.day, count(*) AS users, round(sum(v), 2) AS total FROM (SELECT d.day, user_id, arg_max(value, e.day) AS v FROM d JOIN e ON e.day <= d.day GROUP BY 1, 2) d GROUP BY 1""")
def value_held_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    rows = load(spark, sf_dir, "events").select("user_id", day.alias("day"), "ts", "event_id", "value")
    ended = history.latest(rows, ["user_id", "day"], ["ts", "event_id"])
    held = history.at_each(history.spans(ended, "user_id", "day", F.lit(31)))
    return held.groupBy(F.col("at").alias("day")).agg(F.count("*").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query("""
    WITH s AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events)
    SELECT user_id, event_id, ts FROM s WHERE ts <= TIMESTAMP '2024-01-20' AND (until IS NULL OR until > TIMESTAMP '2024-01-20')""")
def active_interval_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("until", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.where(history.active("ts", "until", F.lit("2024-01-20").cast("timestamp_ntz"))).drop("until")


@query("""
    WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
    SELECT month, total, round(100.0 * (total - lag(total) OVER w) / lag(total) OVER w, 2) AS total_growth_pct, round(total / first_value(total) OVER w, 3) AS multiple_of_first FROM m WINDOW w AS (ORDER BY month)""")
def monthly_order_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    rows = load(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return history.growth(rows, "month", "total").withColumn("multiple_of_first", F.round(F.col("total") / F.first("total").over(Window.orderBy("month")), 3))


@query("WITH p AS (SELECT min(l_suppkey) AS a, max(l_suppkey) AS b, l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2) SELECT a::VARCHAR || ':' || b::VARCHAR AS roster_key, count(*) AS times FROM p GROUP BY 1")
def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.roster_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", 2).groupBy("roster_key").agg(F.count("*").alias("times"))


@query("""
    WITH p AS (SELECT least(a.l_suppkey, b.l_suppkey) AS low_id, greatest(a.l_suppkey, b.l_suppkey) AS high_id FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)
    SELECT meetings, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM (SELECT low_id, high_id, count(*) AS meetings FROM p GROUP BY 1, 2) GROUP BY 1""")
def supplier_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    one, two = (rows.where(F.col("l_linenumber") == k).select("l_orderkey", F.col("l_suppkey").alias(f"s{k}")) for k in (1, 2))
    return histogram_of_counts(pairs.unordered(one.join(two, "l_orderkey"), "s1", "s2"), "low_id", "high_id", value="meetings")


@query("""
    WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996)
    SELECT c_mktsegment, count(*) AS customers, count(*) FILTER (WHERE o_custkey IS NULL) AS without_orders, round(100.0::DOUBLE * count(*) FILTER (WHERE o_custkey IS NULL) / count(*), 2) AS without_pct
    FROM customer LEFT JOIN a ON o_custkey = c_custkey GROUP BY 1""")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = load(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("bought")).distinct()
    rows = load(spark, sf_dir, "customer").join(bought, "c_custkey", "left")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count_if(F.col("bought").isNull()).alias("without_orders")).withColumn("without_pct", pct(F.col("without_orders"), F.col("customers")))


@query("SELECT m AS month, s AS o_orderstatus FROM (SELECT DISTINCT month(o_orderdate) AS m FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders) EXCEPT SELECT DISTINCT month(o_orderdate), o_orderstatus FROM orders WHERE o_totalprice > 494000")
def missing_month_status_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate").cast("long"))
    seen = orders.where(F.col("o_totalprice") > 494000).select("month", "o_orderstatus").distinct()
    return pairs.missing_cells(seen, orders.select("month").distinct(), orders.select("o_orderstatus").distinct())


@query("SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spend FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY spend DESC, c_custkey LIMIT 25")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(spend, "c_custkey").orderBy(F.desc("spend"), "c_custkey").limit(25)


@query("WITH g AS (SELECT p_brand, p_type, count(*) AS frequency, CASE WHEN p_type LIKE 'STANDARD%' THEN 1.5 ELSE 1.0 END::DOUBLE AS bias FROM part GROUP BY 1, 2) SELECT p_brand, p_type, frequency, round(frequency * bias / sum(frequency * bias) OVER (PARTITION BY p_brand), 8) AS probability FROM g")
def type_probability_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("frequency"))
    bias = F.when(F.col("p_type").startswith("STANDARD"), 1.5).otherwise(1.0)
    return normalised(rows, F.col("frequency") * bias, "p_brand")


@query("""
    WITH v AS (SELECT user_id, list(value - 50 ORDER BY ts, event_id) AS l FROM events GROUP BY 1)
    SELECT user_id, list_reduce(list_prepend(100.0::DOUBLE, l), lambda a, x: least(250.0, greatest(0.0, a + x))) AS state, CAST(len(l) AS BIGINT) AS steps FROM v""")
def clamped_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("change", F.col("value") - 50)
    return ratings.clamped_sum(rows, "user_id", ["ts", "event_id"], "change", 0, 250, 100)


@query("SELECT s_suppkey, round(1 / (1 + pow(10.0::DOUBLE, (5000 - s_acctbal) / 400.0)), 4) AS chance, round(1 - abs(round(1 / (1 + pow(10.0::DOUBLE, (5000 - s_acctbal) / 400.0)), 4) - 0.5) * 2, 3) AS closeness FROM supplier")
def win_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    chance = ratings.win_probability(F.col("s_acctbal"), F.lit(5000.0))
    return load(spark, sf_dir, "supplier").select("s_suppkey", chance.alias("chance"), ratings.competitiveness(chance).alias("closeness"))


@query("""
    WITH t(category, name, failures) AS (
      SELECT 'primary_key', 'orders', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
      UNION ALL SELECT 'primary_key', 'orders by customer', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))
      UNION ALL SELECT 'required', 'customer', (SELECT count(*) FROM customer WHERE c_name IS NULL OR c_nationkey IS NULL)
      UNION ALL SELECT 'foreign_key', 'lineitem to orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
      UNION ALL SELECT 'foreign_key', 'lineitem to finished orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
      UNION ALL SELECT 'foreign_key', 'nation to region', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region))
      UNION ALL SELECT 'temporal', 'shipped in time', (SELECT count(*) FROM lineitem WHERE NOT (l_shipdate < TIMESTAMP '2001-01-01'))
      UNION ALL SELECT 'not_empty', 'part', (SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM part)
      UNION ALL SELECT 'row_count', 'region', (SELECT abs(count(*) - 5) FROM region)
      UNION ALL SELECT 'columns', 'region', 0)
    SELECT category, name, CASE WHEN failures = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(failures AS BIGINT) AS failures FROM t""")
def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: load(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "nation", "region", "part")}
    return checks.report(
        checks.unique("orders", t["orders"], "o_orderkey"),
        checks.unique("orders by customer", t["orders"], "o_custkey"),
        checks.required("customer", t["customer"], "c_name", "c_nationkey"),
        checks.references("lineitem to orders", t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"),
        checks.references("lineitem to finished orders", t["lineitem"], "l_orderkey", t["orders"].where(F.col("o_orderstatus") == "F"), "o_orderkey"),
        checks.references("nation to region", t["nation"], "n_regionkey", t["region"], "r_regionkey"),
        checks.holds("temporal", "shipped in time", t["lineitem"], "l_shipdate < timestamp_ntz'2001-01-01'"),
        checks.not_empty("part", t["part"]).withColumn("failures", F.col("failures").cast("long")),
        checks.count_is("region", t["region"], 5),
        checks.columns_are("region", t["region"], ["r_regionkey", "r_name"]),
    )


STATE = "SELECT o_custkey, count(*) AS orders, max(o_orderstatus) AS status, max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS pending FROM orders WHERE o_orderdate < TIMESTAMP '{d}' GROUP BY 1"


def _state(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderstatus").alias("status"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("pending"))


@query(f"WITH a AS ({STATE.format(d='1999-01-01')}), b AS ({STATE.format(d='1997-01-01')}) SELECT a.* FROM a LEFT JOIN b ON b.o_custkey = a.o_custkey WHERE b.o_custkey IS NULL OR a.status IS DISTINCT FROM b.status OR a.pending IS DISTINCT FROM b.pending")
def customer_state_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.changed(_state(spark, sf_dir, "1999-01-01"), _state(spark, sf_dir, "1997-01-01"), ["o_custkey"], ["orders"])


@query("SELECT o_custkey AS id FROM orders WHERE o_totalprice > 425000 UNION SELECT user_id FROM events UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def referenced_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = load(spark, sf_dir, "orders").where(F.col("o_totalprice") > 425000).select(F.col("o_custkey").alias("id"))
    two = load(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return pairs.closure(one, two, load(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id")))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus IN ('dormant', 'retired') AND o_orderdate + INTERVAL 700 DAY >= TIMESTAMP '1998-01-01' THEN 'active' ELSE o_orderstatus END AS state, CASE WHEN o_orderdate + INTERVAL 700 DAY >= TIMESTAMP '1998-01-01' THEN NULL ELSE o_orderdate + INTERVAL 700 DAY END AS ended
    FROM (SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'retired' WHEN 'P' THEN 'dormant' ELSE 'active' END AS o_orderstatus FROM orders) WHERE o_orderdate < TIMESTAMP '1998-01-01'""")
def orders_known_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "retired").when(F.col("o_orderstatus") == "P", "dormant").otherwise("active")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", state.alias("state"), (F.col("o_orderdate") + F.expr("INTERVAL 700 DAY")).alias("ended"))
    return releases.project(releases.known_as_of(rows, "o_orderdate", "ended", F.lit("1998-01-01").cast("timestamp_ntz"), "state"), ["o_orderkey", "state", "ended"])


TOKEN = "CAST('0x' || substr(sha256('taint|{c}|' || o_orderkey), 1, 13) AS BIGINT)"
BAR = int(0.03 * 2**52)
TAINTED = f"""t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
      CASE WHEN {TOKEN.format(c='o_orderstatus')} < {BAR} THEN NULL ELSE o_orderstatus END AS s,
      CASE WHEN {TOKEN.format(c='o_totalprice')} < {BAR} THEN round(o_totalprice * (1.15::DOUBLE + {TOKEN.format(c='o_totalprice')} % 50 / 100.0::DOUBLE), 3) ELSE o_totalprice END AS v,
      CASE WHEN {TOKEN.format(c='o_orderpriority')} >= {BAR} THEN o_orderpriority WHEN {TOKEN.format(c='o_orderpriority')} % 4 = 0 THEN lower(o_orderpriority) WHEN {TOKEN.format(c='o_orderpriority')} % 4 = 1 THEN upper(o_orderpriority) WHEN {TOKEN.format(c='o_orderpriority')} % 4 = 2 THEN replace(o_orderpriority, '_', ' ') ELSE replace(o_orderpriority, '_', '-') END AS p FROM orders)"""
RULES = {"o_orderstatus": "missing", "o_totalprice": "outlier", "o_orderpriority": "categorical"}


def _tainted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    clean = load(spark, sf_dir, "orders").select("o_orderkey", *RULES)
    return clean, *quality.inject(clean, "o_orderkey", RULES, 0.03, "taint")


@query(f"""
    WITH {TAINTED} SELECT o_orderkey, 'o_orderstatus' AS column_name, 'missing' AS issue_type, o_orderstatus AS clean_value, s AS tainted_value FROM t WHERE s IS DISTINCT FROM o_orderstatus
    UNION ALL SELECT o_orderkey, 'o_orderpriority', 'categorical', o_orderpriority, p FROM t WHERE p <> o_orderpriority""")
def taint_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tainted(spark, sf_dir)[2].where(F.col("column_name") != "o_totalprice")


@query(f"""
    WITH {TAINTED}, c AS (SELECT *, round_even(o_totalprice, 1) = v OR round_even(o_totalprice, 2) = v OR round_even(o_totalprice, 3) = v OR round_even(v, 1) = o_totalprice OR round_even(v, 2) = o_totalprice OR round_even(v, 3) = o_totalprice AS near FROM t)
    SELECT 'o_totalprice' AS column_name, 0::BIGINT AS missing, 0::BIGINT AS text_variants, count(*) FILTER (WHERE v <> o_totalprice AND near) AS rounded, count(*) FILTER (WHERE v <> o_totalprice AND NOT near AND abs(v - o_totalprice) >= greatest(1, abs(o_totalprice) * 0.1)) AS outliers, count(*) FILTER (WHERE v <> o_totalprice AND NOT near AND abs(v - o_totalprice) < greatest(1, abs(o_totalprice) * 0.1)) AS other FROM c
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE s IS NULL), 0, 0, 0, 0 FROM t
    UNION ALL SELECT 'o_orderpriority', 0, count(*) FILTER (WHERE p <> o_orderpriority), 0, 0, 0 FROM t""")
def taint_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, tainted, _ = _tainted(spark, sf_dir)
    return quality.compare(clean, tainted, "o_orderkey", ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])


@query("""
    WITH l AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal < 9000),
    r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN upper(s_name) ELSE s_name || ' ' END AS name, CASE WHEN s_suppkey % 9 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS balance FROM supplier WHERE s_acctbal > -500)
    SELECT l.s_suppkey, '*' AS column_name, 'missing' AS issue, false AS waived FROM l WHERE s_suppkey NOT IN (SELECT s_suppkey FROM r)
    UNION ALL SELECT s_suppkey, '*', 'extra', false FROM r WHERE s_suppkey NOT IN (SELECT s_suppkey FROM l)
    UNION ALL SELECT s_suppkey, 's_name', 'value', true FROM l JOIN r USING (s_suppkey) WHERE s_name <> trim(name)
    UNION ALL SELECT s_suppkey, 's_acctbal', 'value', s_suppkey = 9 FROM l JOIN r USING (s_suppkey) WHERE s_acctbal <> balance""")
def supplier_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    k = F.col("s_suppkey")
    right = rows.where("s_acctbal > -500").select("s_suppkey", F.when(k % 7 == 0, F.upper("s_name")).otherwise(F.concat("s_name", F.lit(" "))).alias("name"), F.when(k % 9 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("balance"))
    waivers = spark.createDataFrame([("s_name", None), ("s_acctbal", "9")], "column_name string, waived_key string")
    return reconcile.differences(rows.where("s_acctbal < 9000"), right, "s_suppkey", {"s_name": "name", "s_acctbal": "balance"}, waivers).select("s_suppkey", "column_name", "issue", "waived")


CUP = 20
_TEAMS = "t AS (SELECT s_suppkey AS team_id, s_suppkey // 8 AS division, s_acctbal AS rating FROM supplier)"
_GAME = "CASE WHEN CAST('0x' || substr(sha256('cup|' || iteration || '|' || one || '|' || two || '|{g}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < chance THEN 1 ELSE 0 END"
MATCHES = f"""{_TEAMS}, p AS (SELECT a.division, a.team_id AS one, b.team_id AS two, round(1 / (1 + pow(10.0::DOUBLE, (b.rating - a.rating) / 400.0)), 4) AS chance, CAST(unnest(range({CUP})) AS BIGINT) AS iteration FROM t a JOIN t b ON b.division = a.division AND a.team_id < b.team_id),
    g AS (SELECT *, {" + ".join(_GAME.format(g=i) for i in range(3))} AS games_one FROM p), m AS (SELECT *, 3 - games_one AS games_two, CASE WHEN games_one > 3 - games_one THEN one ELSE two END AS winner FROM g)"""
PLACES = f"""{MATCHES}, s AS (SELECT iteration, division, one AS team_id, two AS rival, winner = one AS won, games_one - games_two AS diff FROM m UNION ALL SELECT iteration, division, two, one, winner = two, games_two - games_one FROM m),
    b AS (SELECT iteration, division, team_id, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses, sum(diff) AS game_diff FROM s GROUP BY 1, 2, 3),
    h AS (SELECT s.iteration, s.division, s.team_id, count(*) FILTER (WHERE s.won) AS among FROM s JOIN b x ON x.iteration = s.iteration AND x.division = s.division AND x.team_id = s.team_id JOIN b y ON y.iteration = s.iteration AND y.division = s.division AND y.team_id = s.rival WHERE x.wins = y.wins GROUP BY 1, 2, 3),
    r AS (SELECT b.*, row_number() OVER (PARTITION BY b.iteration, b.division ORDER BY wins DESC, coalesce(among, 0) DESC, game_diff DESC, sha256('cup:' || b.team_id), b.team_id) AS place FROM b LEFT JOIN h ON h.iteration = b.iteration AND h.division = b.division AND h.team_id = b.team_id)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team_id"), F.floor(F.col("s_suppkey") / 8).alias("division"), F.col("s_acctbal").alias("rating"))
    return tournament.standings(tournament.simulate(teams, CUP, "cup"), "cup")


@query(f"WITH {PLACES} SELECT division, team_id, round(count(*) FILTER (WHERE place = 1) / {CUP}.0::DOUBLE, 4) AS title_share, round(count(*) FILTER (WHERE place <= 3) / {CUP}.0::DOUBLE, 4) AS top_three_share, round(avg(place), 4) AS mean_place, round(sum(wins)::DOUBLE / (sum(wins) + sum(losses)), 4) AS win_share FROM r GROUP BY 1, 2")
def cup_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament.chances(_places(spark, sf_dir), CUP)


@query(f"""
    WITH {PLACES}, k AS (SELECT team_id, team_id % 5 AS group_id FROM t UNION SELECT team_id, team_id % 7 FROM t)
    SELECT iteration, group_id, sum(wins + CASE place WHEN 1 THEN 10 WHEN 2 THEN 6 ELSE 0 END + CASE WHEN place <= 4 THEN 3 ELSE 0 END)::DOUBLE AS score, count(*) FILTER (WHERE place = 1) AS champions, CAST(sum(wins) AS BIGINT) AS match_wins FROM r JOIN k USING (team_id) GROUP BY 1, 2""")
def cup_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = load(spark, sf_dir, "supplier")
    picks = pairs.closure(*[teams.select(F.col("s_suppkey").alias("team_id"), (F.col("s_suppkey") % k).alias("group_id")) for k in (5, 7)])
    return tournament.group_scores(_places(spark, sf_dir), picks)


@query("""
    WITH w AS (SELECT n_regionkey, n_nationkey, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS w FROM nation),
    i AS (SELECT n_regionkey, n_nationkey, (sum(w) OVER o - w) / sum(w) OVER p AS lower, CASE WHEN sum(w) OVER o >= sum(w) OVER p THEN 2.0 ELSE sum(w) OVER o / sum(w) OVER p END AS upper FROM w WINDOW p AS (PARTITION BY n_regionkey), o AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT c_custkey, CAST(c_custkey % 6 AS INTEGER) AS n_regionkey, CAST('0x' || substr(sha256('pick|' || c_custkey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM customer)
    SELECT c_custkey, c.n_regionkey, n_nationkey FROM c LEFT JOIN i ON i.n_regionkey = c.n_regionkey AND u >= lower AND u < upper""")
def weighted_nation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 6).cast("int").alias("n_regionkey"))
    options = load(spark, sf_dir, "nation").withColumn("w", (F.col("n_nationkey") % 5 + 1).cast("double"))
    return sampling.weighted_choice(rows, options, ["n_regionkey"], "n_nationkey", "w", sampling.fraction("pick", "c_custkey")).select("c_custkey", "n_regionkey", "n_nationkey")


@query("""
    WITH k AS (SELECT DISTINCT o_orderpriority AS p, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE year(o_orderdate) IN (1995, 1998, 2000)), w AS (SELECT p, CAST(y AS INTEGER) AS y FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT unnest(range(1993, 2003)) AS y))
    SELECT w.p, w.y, arg_min(k.y, (abs(w.y - k.y), k.y)) AS nearest FROM w JOIN k ON k.p = w.p GROUP BY 1, 2""")
def nearest_known_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"))
    wanted = orders.select("p").distinct().withColumn("y", F.explode(F.sequence(F.lit(1993), F.lit(2002))))
    return sampling.nearest_year(wanted, orders.where(F.col("y").isin(1995, 1998, 2000)), ["p"], "y")


@query(domain.oracle("""
    SELECT b.id AS batch_id, b.generation_run_id, batch_month, (SELECT count(*) FROM player_registrations x WHERE x.batch_id = b.id) AS players, (SELECT count(*) FROM matches x WHERE x.batch_id = b.id) AS matches,
           (SELECT count(*) FROM ratings_update_log x WHERE x.batch_id = b.id) AS rating_updates,
           round(100.0::DOUBLE * (SELECT count(*) FROM matches x WHERE x.batch_id = b.id) / (SELECT count(*) FROM matches x JOIN monthly_batches y ON y.id = x.batch_id WHERE y.generation_run_id = b.generation_run_id), 2) AS match_pct
    FROM monthly_batches b"""))
def panel_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.batch_totals(domain.tables(spark, sf_dir))


@query(domain.oracle("SELECT r.id, release_name, status, count(f.id) AS file_count, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS row_count FROM student_dataset_releases r LEFT JOIN student_dataset_release_files f ON f.release_id = r.id GROUP BY 1, 2, 3"))
def panel_release_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.release_files(domain.tables(spark, sf_dir))


PARTS = {"planning": ["click", "view"], "saving": ["purchase"]}
METRICS = "g AS (SELECT * FROM generation_runtime_metrics WHERE stage_name = 'matches')"


@query(domain.oracle(f"WITH {METRICS} SELECT batch_id, round(sum(elapsed_ms) / 1000, 3) AS total_seconds, round(sum(elapsed_ms) FILTER (WHERE subphase_name IN ('click', 'view')) / 1000, 3) AS planning_seconds, round(sum(elapsed_ms) FILTER (WHERE subphase_name = 'purchase') / 1000, 3) AS saving_seconds FROM g GROUP BY 1"))
def report_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.batch_summary(domain.tables(spark, sf_dir), "matches", PARTS)


@query(domain.oracle("SELECT stage_name, subphase_name, count(*) AS metrics, round(sum(elapsed_ms) / 1000, 3) AS total_seconds, round(max(elapsed_ms) / 1000, 3) AS longest_seconds, round(100.0::DOUBLE * sum(elapsed_ms) / sum(sum(elapsed_ms)) OVER (PARTITION BY stage_name), 2) AS pct_of_stage FROM generation_runtime_metrics GROUP BY 1, 2"))
def report_subphase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.subphase_totals(domain.tables(spark, sf_dir))


@query(domain.oracle("SELECT batch_id, stage_name, CAST(sum(output_count) AS BIGINT) AS rows, round(sum(output_count) * 1000.0::DOUBLE / nullif(sum(elapsed_ms), 0), 3) AS rows_per_second, round(sum(attempt_count)::DOUBLE / nullif(sum(output_count), 0), 3) AS attempts_per_row FROM generation_runtime_metrics GROUP BY 1, 2"))
def report_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.throughput(domain.tables(spark, sf_dir))


@query(domain.oracle(f"""WITH {METRICS}, b AS (SELECT batch_id, CAST(sum(elapsed_ms) AS BIGINT) AS t FROM g GROUP BY 1)
    SELECT batch_id, round(t / 1000, 3) AS total_seconds, round((t - lag(t) OVER w) / 1000, 3) AS seconds_more, round(t::DOUBLE / first_value(t) OVER w, 3) AS multiple_of_first, round(100.0::DOUBLE * (t - lag(t) OVER w) / lag(t) OVER w, 2) AS total_growth_pct FROM b WINDOW w AS (ORDER BY batch_id)"""))
def report_slow_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.slow_down(domain.tables(spark, sf_dir), "matches")


@query(domain.oracle("SELECT id, batch_id, stage_name, subphase_name, round(elapsed_ms / 1000, 3) AS elapsed_seconds FROM generation_runtime_metrics ORDER BY elapsed_ms DESC, id LIMIT 25"))
def report_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.slowest(domain.tables(spark, sf_dir))


@query(domain.oracle(f"""WITH {METRICS}, e AS (SELECT DISTINCT batch_id, p AS subphase_name FROM generation_runtime_metrics, (VALUES ('click'), ('view'), ('absent')) v(p))
    SELECT e.batch_id, e.subphase_name, coalesce(g.event_type, 'missing') AS metric_status FROM e LEFT JOIN g ON g.batch_id = e.batch_id AND g.subphase_name = e.subphase_name WHERE g.id IS NULL OR g.event_type <> 'completed'"""))
def report_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gaps(domain.tables(spark, sf_dir), "matches", ["click", "view", "absent"])
