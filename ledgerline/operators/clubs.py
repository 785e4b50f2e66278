"""Clubs of each state from a list of names, a number of clubs to have, and regions by weight."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import weighted_choice
from .seeds import largest_regions

SCOPE = ("country_code", "state_province_code")

#: Kinds of clubs as they are staged and as they are kept.
TYPES = {
    "Community Recreation Club": "community_center",
    "Competitive Training Club": "dedicated_facility",
    "Indoor Facility Club": "dedicated_facility",
    "League Organization": "municipal_recreation",
    "Private Athletic Club": "private_club",
    "Public Park Club": "public_park",
    "Retirement Community Club": "community_center",
    "Social Club": "community_center",
    "Tournament Club": "dedicated_facility",
}
#: Members and courts from and to by size, and the share of courts indoors.
CAPACITY = {"Tiny": (10, 30), "Small": (31, 75), "Medium": (76, 200), "Large": (201, 500), "Mega": (501, 1000)}
COURTS = {"Tiny": (1, 2), "Small": (2, 4), "Medium": (4, 8), "Large": (8, 16), "Mega": (16, 32)}
INDOOR = {"dedicated_facility": "0.75", "public_park": "0.00", "private_club": "0.45", "municipal_recreation": "0.35"}
INDOOR_OTHERWISE = "0.30"
#: The years in which clubs of a kind were founded.
FOUNDED = {"dedicated_facility": (2008, 2024), "resort": (2008, 2024), "public_park": (1980, 2020), "community_center": (1980, 2020), "municipal_recreation": (1980, 2020)}
FOUNDED_OTHERWISE = (1990, 2022)


def number(*parts: str | Column) -> Column:
    """64 bits of a hash of the parts, joined by bars, as a whole number."""
    text = F.concat_ws("|", *[(F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def _by(column: str, values: dict, otherwise) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)) if out is None else out.when(F.col(column) == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def _within(n: Column, column: str, ranges: dict, otherwise: str = "Small") -> Column:
    low = _by(column, {k: v[0] for k, v in ranges.items()}, ranges[otherwise][0])
    high = _by(column, {k: v[1] for k, v in ranges.items()}, ranges[otherwise][1])
    return (low + (n % (high - low + 1))).cast("int")


def candidates(targets: DataFrame, names: DataFrame) -> DataFrame:
    """scope, index, club_seed, club_name, raw_type, size_tier: as many as each state is to have.

    Names are taken by their seeds; where they run short, the rest are placeholders. The missing
    indexes come from the counts, so no list of names is ever held.
    """
    wanted = targets.where(F.col("target_club_count") > 0).select(*SCOPE, "target_club_count")
    ranked = names.withColumn("index", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("club_seed")) - 1)
    real = ranked.join(wanted, list(SCOPE)).where(F.col("index") < F.col("target_club_count")).select(*SCOPE, "index", F.col("club_seed").cast("decimal(20,0)").alias("club_seed"), "club_name", F.col("club_type").alias("raw_type"), "size_tier")
    there = names.groupBy(*SCOPE).agg(F.count("*").alias("n"))
    short = wanted.join(there, list(SCOPE), "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < F.col("target_club_count"))
    made = short.withColumn("index", F.explode(F.sequence(F.col("n").cast("int"), F.col("target_club_count") - 1)))
    made = made.select(*SCOPE, "index", number("placeholder", *map(F.col, SCOPE), F.col("index")).alias("club_seed"), F.concat(F.lit("Not Enough Club Names "), "state_province_code", F.lit("-"), (F.col("index") + 1).cast("string")).alias("club_name"), F.lit("Community Recreation Club").alias("raw_type"), F.lit("Tiny").alias("size_tier"))
    return real.unionByName(made)


def without_regions(targets: DataFrame, regions: DataFrame) -> DataFrame:
    """States that are to have clubs and have no region for them; ``assigned`` has no clubs for those."""
    return targets.where(F.col("target_club_count") > 0).join(regions.select(*SCOPE), list(SCOPE), "left_anti").select(*SCOPE, "target_club_count")


def assigned(targets: DataFrame, names: DataFrame, regions: DataFrame, hosts: int = 10) -> DataFrame:
    """The clubs: name, region, kind, level, capacity, founding date, courts.

    A club's region is the one in whose part of the state's cumulative weight its hash lies, regions by
    name and id (equal weights where all are zero). Mega clubs stay so only in the ``hosts`` largest
    regions of the country. All else depends on the club's seed, kind and size only.
    """
    regions = regions.where(F.col("country_code").isin("US", "CA") & F.col("state_province_code").isNotNull())
    weight = F.coalesce(F.col("selection_probability").cast("double"), F.lit(0.0))
    total = F.sum(weight).over(Window.partitionBy(*SCOPE))
    options = regions.select(*SCOPE, F.struct("region_name", "id").alias("region"), F.when(total > 0, weight).otherwise(1.0).alias("weight"))
    clubs = candidates(targets, names)
    at = number(F.col("club_seed"), *map(F.col, SCOPE), F.col("index")).cast("double") / F.lit(2.0**64)
    rows = weighted_choice(clubs, options, SCOPE, "region", "weight", at).where(F.col("region").isNotNull()).withColumn("region_id", F.col("region.id"))
    mega = largest_regions(regions.where(F.coalesce("population", F.lit(0)) > 0), hosts).select(F.col("id").alias("region_id"), F.lit(True).alias("host"))
    rows = rows.join(F.broadcast(mega), "region_id", "left")
    rows = rows.withColumn("size_tier", F.when((F.col("size_tier") == "Mega") & F.col("host").isNull(), "Large").otherwise(F.col("size_tier"))).withColumn("club_type", _by("raw_type", TYPES, "community_center"))
    large = F.coalesce(F.col("size_tier").isin("Large", "Mega"), F.lit(False))
    level = F.when(F.col("raw_type").isin("Tournament Club", "Competitive Training Club"), F.when(large, "elite").otherwise("competitive")).when(F.col("raw_type").isin("League Organization", "Indoor Facility Club", "Private Athletic Club"), "mixed").otherwise("recreational")
    first, last = (_by("club_type", {k: v[i] for k, v in FOUNDED.items()}, FOUNDED_OTHERWISE[i]) for i in (0, 1))
    first = F.when(large, F.greatest(F.lit(1970), first - 10)).otherwise(first)
    born = number("founding", F.col("club_seed"), F.col("club_type"), F.coalesce("size_tier", F.lit("None")))
    founded = F.make_date((first + F.col("born") % (last - first + 1)).cast("int"), F.expr("cast(1 + (born div 32) % 12 as int)"), F.expr("cast(1 + (born div 512) % 28 as int)"))
    courts = _within(number("courts", F.col("club_seed")), "size_tier", COURTS)
    inside = F.bround(F.col("courts") * _by("club_type", {k: Decimal(v) for k, v in INDOOR.items()}, Decimal(INDOOR_OTHERWISE)), 0).cast("int")
    inside = F.least("courts", F.when(F.col("club_type") == "dedicated_facility", F.greatest(F.lit(1), inside)).otherwise(inside))
    rows = rows.withColumn("courts", courts).withColumn("indoor_court_count", inside).withColumn("born", born)
    return rows.select(*SCOPE, "index", "club_name", "region_id", "club_type", level.alias("competitiveness_level"), "size_tier", _within(number(F.col("club_seed")), "size_tier", CAPACITY).alias("member_capacity"), founded.alias("founding_date"), "indoor_court_count", (F.col("courts") - F.col("indoor_court_count")).alias("outdoor_court_count"))
