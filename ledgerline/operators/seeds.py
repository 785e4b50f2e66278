"""Reference data: names to probabilities, metro areas to regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shares import normalised


def first_name_probabilities(names: DataFrame) -> DataFrame:
    """A name's share of its country, state, birth year and gender."""
    cohort = ["country_code", "state_province_code", "birth_year", "gender"]
    rows = names.groupBy(*cohort, "first_name").agg(F.sum("frequency_count").alias("frequency_count"), F.min("source_dataset").alias("source_dataset"))
    return normalised(rows, F.col("frequency_count"), *cohort).withColumnRenamed("probability", "normalized_probability")


def last_name_probabilities(names: DataFrame, states: DataFrame, biases: DataFrame) -> DataFrame:
    """A name's share within each state of its country, after the state's bias for the name.

    States and biases are small tables; the product is names x states of one country.
    """
    rows = names.groupBy("country_code", "last_name").agg(F.sum("frequency_count").alias("frequency_count"))
    rows = rows.join(F.broadcast(states.select("country_code", "state_province_code").distinct()), "country_code")
    rows = rows.join(biases.select("country_code", "state_province_code", "last_name", "bias_multiplier"), ["country_code", "state_province_code", "last_name"], "left")
    rows = rows.withColumn("bias_multiplier", F.coalesce("bias_multiplier", F.lit(1.0))).withColumn("adjusted_frequency_count", F.round(F.col("frequency_count") * F.col("bias_multiplier"), 4))
    return normalised(rows, F.col("adjusted_frequency_count"), "country_code", "state_province_code").withColumnRenamed("probability", "normalized_probability")


def bias_problems(biases: DataFrame, names: DataFrame) -> DataFrame:
    """problem, country_code, state_province_code, last_name: doubled rules and unknown names."""
    key = ["country_code", "state_province_code", "last_name"]
    twice = biases.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.lit("duplicate").alias("problem"), *key)
    unknown = biases.join(names.select("country_code", "last_name").distinct(), ["country_code", "last_name"], "left_anti").select(F.lit("unknown_name").alias("problem"), *key).distinct()
    return twice.unionByName(unknown)


def metro_regions(metros: DataFrame) -> DataFrame:
    """One region a natural key: summed population, other fields of the first row by id.

    A region without people has probability 0; where none has people it is null. The type follows from the country
    and, in Canada, from the mark after the name.
    """
    rows = metros.groupBy("country_code", "state_province_code", "region_name").agg(F.sum("population").alias("population"), F.min_by("latitude", "id").alias("latitude"), F.min_by("longitude", "id").alias("longitude"))
    people = F.greatest(F.coalesce("population", F.lit(0)), F.lit(0))
    rows = normalised(rows, people).withColumnRenamed("probability", "selection_probability")
    canada = F.col("country_code") == "CA"
    marked = F.when(canada & F.contains("region_name", F.lit("(CMA)")), "CMA").when(canada & F.contains("region_name", F.lit("(CA)")), "CA")
    return rows.withColumn("region_type", F.when(F.col("country_code") == "US", "MSA").otherwise(F.coalesce(marked, F.lit("metro"))))


def fallback_territories(regions: DataFrame, territories: DataFrame) -> DataFrame:
    """Territories that no metro region covers."""
    return territories.join(regions.select("country_code", "state_province_code").distinct(), ["country_code", "state_province_code"], "left_anti")


def with_territories(regions: DataFrame, targets: DataFrame) -> DataFrame:
    """``regions`` and one territory for each state that is to have clubs but no region.

    A territory bears the state's name, has no population and is never drawn by weight (probability 0).
    """
    wanted = targets.where(F.col("target_club_count") > 0)
    rows = fallback_territories(regions, wanted).groupBy("country_code", "state_province_code").agg(F.min("state_province_name").alias("region_name"))
    rows = rows.withColumn("region_type", F.lit("territory")).withColumn("selection_probability", F.lit(0.0))
    return regions.unionByName(rows, allowMissingColumns=True)


def largest_regions(regions: DataFrame, per_country: int = 10) -> DataFrame:
    order = Window.partitionBy("country_code").orderBy(F.desc("population"), "region_name")
    return regions.where(F.col("population") > 0).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_country)
