"""Delimited seed files: typed rows on one side, rejects with reasons on the other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A target column: where it comes from, its type and what it must satisfy."""

    source: str
    kind: str = "string"  # string, int, decimal or country
    required: bool = True
    allowed: tuple[str, ...] = ()
    positive: bool = False


@dataclass(frozen=True)
class Dataset:
    name: str
    fields: Mapping[str, Field]
    delimiter: str = ","
    header: bool = True
    columns: Sequence[str] = field(default_factory=tuple)  # of files without a header


#: The countries' spellings that occur in the files.
COUNTRIES = {"USA": "US", "UNITED STATES": "US", "US": "US", "CANADA": "CA", "CAN": "CA", "CA": "CA"}


def clean(value: Column) -> Column:
    """Outer space goes; nothing left is null."""
    return F.nullif(F.trim(value), F.lit(""))


def parse(value: Column, kind: str) -> Column:
    text = clean(value)
    if kind == "int":
        return F.regexp_replace(text, ",", "").try_cast("double").cast("long")
    if kind == "decimal":
        return F.regexp_replace(text, ",", "").try_cast(T.DecimalType(20, 8))
    if kind == "country":
        out = F.upper(text)
        for old, new in COUNTRIES.items():
            out = F.when(F.upper(text) == old, new).otherwise(out)
        return out
    return text


def read(spark: SparkSession, paths: Sequence[str] | str, dataset: Dataset, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, with the file's name."""
    reader = spark.read.option("delimiter", dataset.delimiter).option("header", dataset.header).option("encoding", encoding).option("mode", "PERMISSIVE")
    if not dataset.header:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in dataset.columns]))
    rows = reader.csv(list(paths) if not isinstance(paths, str) else paths)
    return rows.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def split(rows: DataFrame, dataset: Dataset) -> tuple[DataFrame, DataFrame]:
    """(valid typed rows, rejects): a reject has its joined errors and its text as JSON.

    Both keep source_file and, where rows have one, source_row_number.
    """
    typed, errors = {}, []
    for name, f in dataset.fields.items():
        value = parse(F.col(f.source), f.kind)
        typed[name] = value
        if f.required:
            errors.append(F.when(clean(F.col(f.source)).isNull(), f"{name} is missing"))
        if f.kind in ("int", "decimal"):
            errors.append(F.when(clean(F.col(f.source)).isNotNull() & value.isNull(), f"{name} is not a number"))
        if f.positive:
            errors.append(F.when(value <= 0, f"{name} is not positive"))
        if f.allowed:
            errors.append(F.when(~value.isin(*f.allowed), f"{name} is not allowed"))
    place = [c for c in ("source_file", "source_row_number") if c in rows.columns]
    raw = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in place]))
    both = rows.select(*place, F.array_compact(F.array(*errors)).alias("errors"), raw.alias("raw_payload"), *[v.alias(n) for n, v in typed.items()])
    good = both.where(F.size("errors") == 0).select(*typed, *place).withColumn("source_dataset", F.lit(dataset.name))
    bad = both.where(F.size("errors") > 0).select(*place, F.lit("invalid_row").alias("error_code"), F.array_join("errors", "; ").alias("error_message"), "raw_payload")
    return good, bad


DATASETS: dict[str, Dataset] = {
    "first_names_us": Dataset("first_names_us", {"country_code": Field("country", "country"), "state_province_code": Field("state"), "gender": Field("gender", allowed=("M", "F")), "birth_year": Field("year", "int"), "first_name": Field("name"), "frequency_count": Field("count", "int", positive=True)}, header=False, columns=("state", "gender", "year", "name", "count", "country")),
    "last_names": Dataset("last_names", {"country_code": Field("country", "country"), "last_name": Field("last_name"), "frequency_count": Field("frequency", "int", positive=True)}, delimiter="|"),
    "metro_areas": Dataset("metro_areas", {"country_code": Field("country", "country"), "region_name": Field("name"), "state_province_code": Field("state"), "population": Field("population", "int", positive=True)}),
    "clubs": Dataset("clubs", {"club_name": Field("club_name"), "region_name": Field("region", required=False)}),
}
