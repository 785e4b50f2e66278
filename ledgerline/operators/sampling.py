"""Seeded choices by weight, nearest cohorts, and people made from reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import token

CELLS = 256


def fraction(seed: str, *parts: str | Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    return token(seed, *parts) / F.lit(2.0**52)


def intervals(options: DataFrame, cohort: Sequence[str], item: str, weight: str) -> DataFrame:
    """cohort, item, lower, upper: each option's part of [0, 1), by weight, in the order of items."""
    options = options.where(F.col(weight) > 0)
    order = Window.partitionBy(*cohort).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(Window.partitionBy(*cohort))
    upper = F.sum(weight).over(order)
    return options.select(*cohort, item, ((upper - F.col(weight)) / total).alias("lower"), F.when(upper >= total, 2.0).otherwise(upper / total).alias("upper"))


def weighted_choice(rows: DataFrame, options: DataFrame, cohort: Sequence[str], item: str, weight: str, at: Column) -> DataFrame:
    """Adds ``item``: the option of the row's cohort in whose interval ``at`` lies, else null.

    [0, 1) is cut into cells, and rows and options meet by cohort and cell, so a row meets
    about one option however many its cohort has.
    """
    cells = F.sequence(F.floor(F.col("lower") * CELLS), F.least(F.floor(F.col("upper") * CELLS), F.lit(CELLS - 1)))
    spread = intervals(options, cohort, item, weight).withColumn("cell", F.explode(cells))
    rows = rows.withColumn("__at", at).withColumn("cell", F.floor(F.col("__at") * CELLS))
    keys = [*cohort, "cell"]
    right = spread.select(*[F.col(k).alias(f"__{k}") for k in keys], item, "lower", "upper")
    match = [rows[k] == right[f"__{k}"] for k in keys] + [F.col("__at") >= F.col("lower"), F.col("__at") < F.col("upper")]
    return rows.join(right, match, "left").drop("__at", "cell", "lower", "upper", *[f"__{k}" for k in keys])


def nearest_year(wanted: DataFrame, known: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """keys, year, nearest: the known year that is nearest to each wanted one, the earlier of two.

    Cohorts are few (states, genders, years), so a key's years meet each other.
    """
    have = known.select(*keys, F.col(year).alias("nearest")).distinct()
    rows = wanted.select(*keys, year).distinct().join(have, list(keys))
    return rows.groupBy(*keys, year).agg(F.min(F.struct(F.abs(F.col(year) - F.col("nearest")).alias("d"), "nearest")).alias("x")).select(*keys, year, "x.nearest")


def name_cohorts(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``place`` and ``nearest``: the cohort from which a first name comes.

    The state's names of the birth year, else of the state's nearest year (the earlier of two), else of the country (place ``*``) in
    the same way; null where the country has none for the gender.
    """
    state, country = ["country_code", "state_province_code", "gender"], ["country_code", "gender"]
    near = nearest_year(rows, names, state, "birth_year").withColumnRenamed("nearest", "in_state")
    far = nearest_year(rows, names, country, "birth_year").withColumnRenamed("nearest", "in_country")
    both = rows.join(near, [*state, "birth_year"], "left").join(far, [*country, "birth_year"], "left")
    place = F.when(F.col("in_state").isNotNull(), F.col("state_province_code")).when(F.col("in_country").isNotNull(), "*")
    return both.withColumns({"place": place, "nearest": F.coalesce("in_state", "in_country")}).drop("in_state", "in_country")


def first_names(rows: DataFrame, names: DataFrame, at: Column) -> DataFrame:
    """Adds ``first_name`` by frequency within the cohort of ``name_cohorts``."""
    year = F.col("birth_year").alias("nearest")
    states = names.select("country_code", F.col("state_province_code").alias("place"), "gender", year, "first_name", "frequency_count")
    whole = names.groupBy("country_code", F.lit("*").alias("place"), "gender", year, "first_name").agg(F.sum("frequency_count").alias("frequency_count"))
    options = states.unionByName(whole).groupBy("country_code", "place", "gender", "nearest", "first_name").agg(F.sum("frequency_count").alias("frequency_count"))
    return weighted_choice(name_cohorts(rows, names), options, ["country_code", "place", "gender", "nearest"], "first_name", "frequency_count", at).drop("place", "nearest")


def initial_rating(at: Column, tail: Column, low: float = 800.0, high: float = 2200.0, elite_share: float = 0.01, elite_from: float = 4000.0, elite_to: float = 4800.0) -> Column:
    """A starting rating: even over a range, and for a small share far above it."""
    usual = F.lit(low) + at * (high - low)
    return F.round(F.when(tail < elite_share, F.lit(elite_from) + at * (elite_to - elite_from)).otherwise(usual), 3)


def players(spark: SparkSession, n: int, seed: str, regions: DataFrame, names: DataFrame, last_names: DataFrame, month: str) -> DataFrame:
    """``n`` players: region by its probability, age, names of their cohort, first rating.

    Each column depends on the seed and the player's number only. First names are of the
    cohort of ``name_cohorts``; last names of the state.
    """
    u = lambda what: fraction(seed, F.lit(what), F.col("id"))
    rows = spark.range(1, n + 1).withColumn("one", F.lit(1))
    rows = weighted_choice(rows, regions.withColumn("one", F.lit(1)), ["one"], "region_id", "selection_probability", u("region")).drop("one")
    places = regions.select("region_id", "country_code", "state_province_code")
    born = F.date_sub(F.lit(month).cast("date"), (F.lit(12 * 365.2425) + u("age") * (70 * 365.2425)).cast("int"))
    rows = rows.join(F.broadcast(places), "region_id", "left").withColumns({"gender": F.when(u("gender") < 0.5, "F").otherwise("M"), "birth_date": born, "birth_year": F.year(born)})
    rows = first_names(rows, names, u("first name"))
    rows = weighted_choice(rows, last_names, ["country_code", "state_province_code"], "last_name", "normalized_probability", u("last name"))
    return rows.withColumns({"registration_date": F.lit(month).cast("date"), "player_status": F.lit("ACTIVE"), "initial_rating": initial_rating(u("rating"), u("elite"))})


def team_status(members: DataFrame) -> DataFrame:
    """A team is retired if a member is, else dormant if one is injured, else active."""
    worst = lambda s: F.bool_or(F.col("player_status") == s)
    return members.groupBy("team_id").agg(F.when(worst("RETIRED"), "retired").when(worst("INJURED"), "dormant").otherwise("active").alias("team_status"))


def lifecycle_events(now: DataFrame, before: DataFrame, at: str) -> DataFrame:
    """An event for each team whose status is another than before."""
    both = now.join(before.withColumnRenamed("team_status", "was"), "team_id").where(F.col("team_status") != F.col("was"))
    kind = F.when(F.col("team_status") == "active", "reactivated").otherwise(F.col("team_status"))
    return both.select("team_id", kind.alias("event_type"), F.lit(at).cast("date").alias("event_date"))


def pair_ids(pairs: DataFrame, known: DataFrame, one: str, two: str) -> DataFrame:
    """The id of each unordered pair; new pairs get the next free ids, without gaps.

    ``known`` has team_id, low_id, high_id. New ids are counted within buckets of the pairs'
    hash and joined by the buckets' totals, so they need no single task.
    """
    low, high = F.least(one, two).alias("low_id"), F.greatest(one, two).alias("high_id")
    wanted = pairs.select(low, high).distinct()
    new = wanted.join(known, ["low_id", "high_id"], "left_anti").withColumn("bucket", F.pmod(F.hash("low_id", "high_id"), F.lit(64)))
    start = known.agg(F.coalesce(F.max("team_id"), F.lit(0)).alias("start"))
    sizes = new.groupBy("bucket").agg(F.count("*").alias("k"))
    offsets = sizes.select("bucket", F.coalesce(F.sum("k").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = new.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("low_id", "high_id"))).join(F.broadcast(offsets), "bucket").crossJoin(F.broadcast(start))
    ids = numbered.select((F.col("start") + F.col("offset") + F.col("n")).alias("team_id"), "low_id", "high_id", F.lit(True).alias("is_new"))
    old = wanted.join(known.select("team_id", "low_id", "high_id"), ["low_id", "high_id"]).select("team_id", "low_id", "high_id", F.lit(False).alias("is_new"))
    return old.unionByName(ids)
