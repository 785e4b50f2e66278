"""Exact numbers of seeded faults, their manifest, and what must hold afterwards.

``quality.inject`` decides each cell by itself and hits about its rate. Here each kind of
fault hits exactly floor(rows x midpoint) cells, as far as the table has so many.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.interim import kept
from ledgerline.sources.interim import path as new_path

from .quality import FAMILIES, FAMILY, KINDS, LEVELS, rate_of, token
from .selection import BITS, n_smallest

#: Limits for all kinds of fault together.
MAX_ROWS_PCT, MAX_FIELDS = 5.0, 2
COARSE = 12  # bits of a hash that the histogram of all kinds looks at


@dataclass(frozen=True)
class Injection:
    """What faults are made for: a release's table, the level and the seed; ``rules`` name columns by kind, in order."""

    table: str
    pk: str
    rules: Mapping[str, Sequence[str]]
    level: str
    seed: str
    release_id: str = ""
    release_name: str = ""
    per_row: int = MAX_FIELDS
    protected: Sequence[str] = ()

    def barred(self, rows: DataFrame) -> list[str]:
        """Columns that no fault may touch: the key, names ending in _id, dates, and those named."""
        dates = {f.name for f in rows.schema if f.dataType.simpleString() in ("date", "timestamp", "timestamp_ntz")}
        jittered = set(self.rules.get("jitter", ()))
        return [c for c in rows.columns if c == self.pk or c.endswith("_id") or c in self.protected or (c in dates and c not in jittered)]


def _changing(rows: DataFrame, what: Injection, kind: str) -> Column:
    """k, column_name, clean_value, tainted_value of a row's cells that a kind may change, in the order of their hashes."""
    each = []
    for c in what.rules[kind]:
        k = token(what.seed, F.lit(kind), F.lit(c), F.col(what.pk))
        new = KINDS[kind](F.col(c), k).cast(rows.schema[c].dataType)
        changes = F.col(c).isNotNull() & ~new.eqNullSafe(F.col(c))
        each.append(F.when(changes, F.struct(k.alias("k"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("clean_value"), new.cast("string").alias("tainted_value"))))
    return F.array_sort(F.array_compact(F.array(*each)))


def _bars(rows: DataFrame, what: Injection, total: int, levels: Sequence[str]) -> dict[str, dict[str, int]]:
    """By kind and level a hash below which the cells lie that can be chosen.

    A row that no earlier kind has hit keeps one cell at least, so (n + all earlier hits) x columns cells
    leave n of them. One histogram of 2**COARSE counts a kind, for all levels together.
    """
    cells = F.concat(*[F.transform(_changing(rows, what, kind), lambda x, kind=kind: F.struct(F.lit(kind).alias("kind"), F.shiftright(x["k"], BITS - COARSE).alias("b"))) for kind in what.rules])
    counted = rows.select(F.explode(cells).alias("x")).groupBy("x.kind", "x.b").agg(F.count("*").alias("n")).collect()
    out = {}
    for i, (kind, columns) in enumerate(what.rules.items()):
        own = sorted((r["b"], r["n"]) for r in counted if r["kind"] == kind)
        up_to = list(accumulate(n for _, n in own))
        out[kind] = {}
        for level in levels:
            n, *earlier = (floor(total * rate_of(level, FAMILY[x])) for x in (kind, *list(what.rules)[:i]))
            at = bisect_left(up_to, (n + sum(earlier)) * len(columns))
            out[kind][level] = (own[at][0] + 1) << (BITS - COARSE) if at < len(own) else 1 << BITS
    return out


def _cells(own: DataFrame, what: Injection, hits: DataFrame | None) -> DataFrame:
    """pk, column_name, clean_value, tainted_value, k: of each row's cells in ``own`` those that ``hits`` leave a kind."""
    if hits is None:
        own = own.withColumn("own", F.slice("own", 1, what.per_row))
    else:
        taken = hits.groupBy(F.col(what.pk).alias("__pk")).agg(F.collect_list("column_name").alias("taken"))
        own = own.join(taken, own[what.pk] == taken["__pk"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
        own = own.withColumn("own", F.slice(F.filter("own", lambda x: ~F.array_contains("taken", x["column_name"])), F.lit(1), what.per_row - F.size("taken")))
    return own.select(what.pk, F.explode("own").alias("x")).select(what.pk, "x.*")


def exact_cells(rows: DataFrame, what: Injection) -> DataFrame:
    """pk, column_name, issue_type, clean_value, tainted_value: the cells that are hit.

    Kinds take their turns. Of a row's cells in the order of their hashes a kind may take as many as
    the row has left of ``per_row``; of those it takes the floor(rows x midpoint) of smallest hash,
    which is what going through all cells in that order would give. Cells are hit once; null
    cells and those that a fault would leave as they are don't count. The table itself is never
    shuffled or sorted: only what earlier kinds have hit is joined to it.
    """
    return exact_cells_by_level(rows, what, [what.level])[what.level]


def exact_cells_by_level(rows: DataFrame, what: Injection, levels: Sequence[str]) -> dict[str, DataFrame]:
    """``exact_cells`` at each of several levels, whatever the level of ``what``.

    Hashes don't depend on the level. The table is gone through three times for all levels: for its rows, for a
    histogram of hashes and for the cells that can be chosen at any level, which are written; the turns go over those.
    """
    barred = set(what.barred(rows))
    wrong = [c for columns in what.rules.values() for c in columns if c in barred]
    if wrong:
        raise ValueError(f"protected columns: {', '.join(sorted(set(wrong)))}")
    total, spark = rows.count(), rows.sparkSession
    bars, path = _bars(rows, what, total, levels), new_path(spark, "candidates")
    below = lambda own, bar: F.filter(own, lambda x: x["k"] < bar)
    each = [F.struct(F.lit(kind).alias("issue_type"), below(_changing(rows, what, kind), max(bars[kind].values())).alias("own")) for kind in what.rules]
    found = rows.select(what.pk, F.explode(F.array(*each)).alias("x")).select(what.pk, "x.issue_type", "x.own").where(F.size("own") > 0)
    found.write.partitionBy("issue_type").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    out = {}
    for level in levels:
        hits = None
        for kind in what.rules:
            n = floor(total * rate_of(level, FAMILY[kind]))
            own = found.where(F.col("issue_type") == kind).select(what.pk, below(F.col("own"), bars[kind][level]).alias("own")).where(F.size("own") > 0)
            chosen = n_smallest(_cells(own, what, hits), "k", n, what.pk, "column_name")
            chosen = chosen.select(what.pk, "column_name", F.lit(kind).alias("issue_type"), "clean_value", "tainted_value")
            if n or hits is None:
                hits = kept(chosen if hits is None else hits.unionByName(chosen))
        out[level] = hits
    return out


def applied(rows: DataFrame, pk: str, cells: DataFrame) -> DataFrame:
    """``rows`` with the tainted values of ``cells``."""
    by_row = cells.groupBy(F.col(pk).alias("__pk")).agg(F.map_from_entries(F.collect_list(F.struct("column_name", "tainted_value"))).alias("__new"))
    both = rows.join(by_row, rows[pk] == by_row["__pk"], "left")
    return both.select(*[F.when(F.map_contains_key("__new", F.lit(f.name)), F.col("__new")[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in rows.schema])


def manifest(cells: DataFrame, what: Injection, at: Column) -> DataFrame:
    """The record of each fault: twelve columns, as a release keeps them."""
    return cells.select(
        F.lit(what.release_id).alias("release_id"), F.lit(what.release_name).alias("release_name"), F.lit(what.table).alias("table_name"), F.col(what.pk).cast("string").alias("record_primary_key"), "column_name", "issue_type",
        F.col("clean_value").alias("original_value"), F.col("tainted_value").alias("injected_value"), F.lit(what.level).alias("injection_level"), F.lit(what.seed).alias("random_seed"), F.concat(F.lit(f"{what.table}."), "issue_type").alias("rule_id"), at.alias("injected_at"),
    )


def fingerprints(rows: DataFrame, pk: str, columns: Sequence[str]) -> DataFrame:
    """One row: rows, and for each column a sum over hashes of (key, value).

    Two tables whose sums are equal have the same values under the same keys, but for a chance of some
    2**-52: no join and no order. Rows may come from anywhere in any partitioning.
    """
    total = lambda c: F.coalesce(F.sum(token("fingerprint", F.lit(c), F.col(pk), F.coalesce(F.col(c).cast("string"), F.lit("\0"))).cast("decimal(38,0)")), F.lit(0))
    return rows.agg(F.count("*").alias("rows"), *[total(c).alias(c) for c in columns])


def injection_checks(clean: DataFrame, tainted: DataFrame, cells: DataFrame, what: Injection, required: Sequence[str] = (), added: int = 0) -> DataFrame:
    """category, name, status, failures: what must hold after an injection.

    The columns are the same; there are ``added`` more rows; keys are unique and there; protected columns
    are as they were (by fingerprints of the clean keys' rows); no required cell became null; no more rows are hit than
    the limit allows, and of no kind more than its level's upper bound.
    """
    barred = what.barred(clean)
    same = list(clean.columns) == list(tainted.columns)
    original = tainted if not added else tainted.join(clean.select(what.pk), what.pk, "left_semi")
    old = fingerprints(clean, what.pk, barred).toDF("rows", *[f"old_{c}" for c in barred])
    new = fingerprints(original, what.pk, barred).toDF("kept_rows", *[f"new_{c}" for c in barred])
    keys = tainted.groupBy(what.pk).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("tainted_rows"), F.count_if((F.col("k") > 1) | F.col(what.pk).isNull()).alias("bad_keys"))
    by_row = cells.groupBy(what.pk).agg(F.collect_set("issue_type").alias("kinds"), F.count_if(F.col("column_name").isin(*required) & F.col("tainted_value").isNull()).alias("nulled"), F.count_if(F.col("column_name").isin(*barred)).alias("touched"), F.count("*").alias("fields"))
    hit = by_row.agg(F.count("*").alias("hit_rows"), F.coalesce(F.sum("nulled"), F.lit(0)).alias("nulled"), F.coalesce(F.sum("touched"), F.lit(0)).alias("touched"), F.count_if(F.col("fields") > what.per_row).alias("crowded"), *[F.count_if(F.array_contains("kinds", k)).alias(f"hit_{k}") for k in what.rules])
    zero = lambda x: F.greatest(x, F.lit(0)).cast("long")
    highest = lambda kind: LEVELS[what.level][FAMILIES[FAMILY[kind]]][1] / 100
    found = [
        ("shape", what.table, F.lit(0 if same else 1)),
        ("row_count", what.table, F.abs(F.col("tainted_rows") - F.col("rows") - added)),
        ("primary_key", f"{what.table}.{what.pk}", F.col("bad_keys")),
        *[("protected", f"{what.table}.{c}", (F.col(f"old_{c}") != F.col(f"new_{c}")).cast("int")) for c in barred],
        ("protected", f"{what.table}: manifest", F.col("touched")),
        ("required", what.table, F.col("nulled")),
        ("limits", "fields a row", F.col("crowded")),
        ("limits", "rows in all", zero(F.col("hit_rows") - F.floor(F.col("rows") * (MAX_ROWS_PCT / 100)))),
        *[("limits", kind, zero(F.col(f"hit_{kind}") - F.floor(F.col("rows") * highest(kind)))) for kind in what.rules],
    ]
    rows = old.crossJoin(F.broadcast(new)).crossJoin(F.broadcast(keys)).crossJoin(F.broadcast(hit))
    out = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("name"), x.cast("long").alias("failures")) for c, n, x in found])).alias("r")).select("r.*")
    return out.select("category", "name", F.when(F.col("failures") == 0, "passed").otherwise("failed").alias("status"), "failures")


def looks_jittered(clean: Column, tainted: Column) -> Column:
    """A date or time that moved by at most a day."""
    days = F.abs(F.unix_timestamp(clean.cast("timestamp")) - F.unix_timestamp(tainted.cast("timestamp")))
    return (clean != tainted) & (days <= 86_400)

