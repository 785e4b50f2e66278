"""Seeded faults in clean tables, and finding them again by comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token(seed: str, *parts: str | Column) -> Column:
    """A hash in [0, 2**52) of the seed and some columns, the same in any SQL engine."""
    columns = [F.lit(p) if isinstance(p, str) and p.startswith("=") else (F.col(p) if isinstance(p, str) else p) for p in parts]
    text = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def missing(value: Column, pick: Column) -> Column:
    return F.lit(None)


def categorical(value: Column, pick: Column) -> Column:
    """Another case, or another separator."""
    return F.when(pick % 4 == 0, F.lower(value)).when(pick % 4 == 1, F.upper(value)).when(pick % 4 == 2, F.replace(value, F.lit("_"), F.lit(" "))).otherwise(F.replace(value, F.lit("_"), F.lit("-")))


def formatting(value: Column, pick: Column) -> Column:
    """A stray space, or & for and."""
    return F.when(pick % 3 == 0, F.concat(value, F.lit(" "))).when(pick % 3 == 1, F.concat(F.lit(" "), value)).otherwise(F.replace(value, F.lit("and"), F.lit("&")))


def rounding(value: Column, pick: Column) -> Column:
    return F.when(pick % 2 == 0, F.round(value, 1)).otherwise(F.round(value, 0))


def outlier(value: Column, pick: Column) -> Column:
    return F.round(value * (F.lit(1.15) + (pick % 50) / 100), 3)


def name_case(value: Column, pick: Column) -> Column:
    """A person's name in another case, or with a space after it."""
    return F.when(pick % 4 == 0, F.upper(value)).when(pick % 4 == 1, F.lower(value)).when(pick % 4 == 2, F.initcap(value)).otherwise(F.concat(value, F.lit(" ")))


def jitter(value: Column, pick: Column) -> Column:
    """A date one day earlier or later."""
    return F.date_add(value, F.when(pick % 2 == 0, -1).otherwise(1))


#: A soft join is a text that people join by, written otherwise: the faults are those of formatting.
KINDS = {"missing": missing, "categorical": categorical, "formatting": formatting, "soft_join": formatting, "name_case": name_case, "rounding": rounding, "outlier": outlier, "jitter": jitter}

#: The percentages from and to of each level, for fields, rows, categories and duplicate-like rows.
LEVELS = {
    "none": ((0, 0), (0, 0), (0, 0), (0, 0)),
    "low": ((0.1, 0.5), (0.05, 0.25), (0.1, 0.3), (0.01, 0.05)),
    "medium": ((0.5, 2), (0.25, 1), (0.3, 1), (0.05, 0.2)),
    "high": ((2, 5), (1, 3), (1, 3), (0.2, 0.75)),
    "very_high": ((5, 10), (3, 6), (3, 6), (0.75, 1.5)),
}
FAMILIES = {"fields": 0, "rows": 1, "categories": 2, "duplicates": 3}
FAMILY = dict.fromkeys(("missing", "rounding", "outlier", "jitter"), "fields") | dict.fromkeys(("categorical", "formatting", "soft_join", "name_case"), "categories")


def shifted(level: str, by: int = -1) -> str:
    """The level ``by`` steps further on, within the known ones: monthly updates take the one below."""
    names = list(LEVELS)
    return names[max(0, min(len(names) - 1, names.index(level) + by))]


def rate_of(level: str, family: str) -> float:
    """The middle of a level's range, as a share."""
    low, high = LEVELS[level][FAMILIES[family]]
    return (low + high) / 200


def inject_level(rows: DataFrame, pk: str, rules: Mapping[str, str], level: str, seed: str, protected: Sequence[str] = (), per_row: int = 2) -> tuple[DataFrame, DataFrame]:
    """``inject`` at a level's rates; keys, names ending in ``_id`` and ``protected`` columns are refused.

    At most ``per_row`` fields of a row are hit: the first ones, by the order of the rules.
    """
    barred = [c for c in rules if c == pk or c.endswith("_id") or c in protected]
    if barred:
        raise ValueError(f"protected columns: {', '.join(barred)}")
    return inject(rows, pk, rules, {c: rate_of(level, FAMILY[kind]) for c, kind in rules.items()}, seed, per_row)


def family_copies(tables: Mapping[str, DataFrame], root: str, keys: Mapping[str, str], links: Mapping[str, tuple[str, str]], rate: float, seed: str) -> dict[str, DataFrame]:
    """Copies of about rate x rows of ``root``, and of all that belongs to those: of each table its copies only.

    ``links`` maps a child to (its reference, the parent), parents first. A copy's key is its
    original's plus the largest key of the table, so keys stay unique, and children's references follow
    their parent's copy; no order and no counter is needed. Which roots are hit shows in their keys, so a child of
    the root is asked by its own reference before it is joined: only what is hit is shuffled.
    """
    top = {t: tables[t].agg(F.coalesce(F.max(keys[t]), F.lit(0)).alias(f"top_{t}")) for t in (root, *links)}
    picked = lambda key: token(seed, F.lit(root), F.col(key)) < int(rate * 2**52)
    hit = {root: tables[root].where(picked(keys[root]))}
    out = {}
    for t in (root, *links):
        moved = {keys[t]: F.col(keys[t]) + F.col(f"top_{t}")}
        if t == root:
            copies = hit[t].crossJoin(F.broadcast(top[t]))
        else:
            fk, parent = links[t]
            rows = tables[t]
            # The hash is of the key as text: that of a reference of another type may be written otherwise.
            if parent == root and rows.schema[fk].dataType == tables[root].schema[keys[root]].dataType:
                rows = rows.where(picked(fk))
            # Only the keys that are hit are held; the child's rows pass by without being sorted.
            hit[t] = rows.join(hit[parent].select(F.col(keys[parent]).alias(fk)).hint("shuffle_hash"), fk, "left_semi")
            copies = hit[t].crossJoin(F.broadcast(top[t])).crossJoin(F.broadcast(top[parent]))
            moved[fk] = F.col(fk) + F.col(f"top_{parent}")
        out[t] = copies.withColumns(moved).select(tables[t].columns)
    return out


def with_duplicates(tables: Mapping[str, DataFrame], root: str, keys: Mapping[str, str], links: Mapping[str, tuple[str, str]], rate: float, seed: str) -> dict[str, DataFrame]:
    """The tables with the copies of ``family_copies``."""
    copies = family_copies(tables, root, keys, links, rate, seed)
    return dict(tables) | {t: tables[t].unionByName(rows) for t, rows in copies.items()}


def inject(rows: DataFrame, pk: str, rules: Mapping[str, str], rate: float | Mapping[str, float], seed: str, per_row: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tainted rows, manifest): ``rules`` name a kind of fault for each column, ``rate`` may have one for each.

    A cell is hit where its hash lies below the rate, so each cell is decided by itself, the
    same way in every run, without a sort or a count; about rate x rows cells of a column are
    hit. Null cells stay. The manifest has a row for each cell that changed.
    """
    out, cells, so_far = {}, [], F.lit(0)
    for column, kind in rules.items():
        if column == pk:
            raise ValueError("the key is protected")
        t = token(seed, F.lit(column), F.col(pk))
        hit = (t < int((rate[column] if isinstance(rate, Mapping) else rate) * 2**52)) & F.col(column).isNotNull()
        if per_row is not None:
            hit = hit & (so_far < per_row)
            so_far = so_far + hit.cast("int")
        new = KINDS[kind](F.col(column), t).cast(rows.schema[column].dataType)
        cells.append(F.when(hit & ~new.eqNullSafe(F.col(column)), F.struct(F.lit(column).alias("column_name"), F.lit(kind).alias("issue_type"), F.col(column).cast("string").alias("clean_value"), new.cast("string").alias("tainted_value"))))
        out[column] = F.when(hit, new).otherwise(F.col(column))  # all from the clean columns, whose nulls decide
    manifest = rows.select(F.col(pk), F.explode(F.array_compact(F.array(*cells))).alias("cell")).select(pk, "cell.*")
    return rows.withColumns(out), manifest


def plain_text(value: Column) -> Column:
    """Case, separators, & and dots do not count."""
    text = F.lower(F.trim(value))
    for old, new in (("_", " "), ("-", " "), ("&", "and"), (".", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, r"\s+", " ")


def looks_rounded(clean: Column, tainted: Column) -> Column:
    near = [(F.bround(clean, d) == tainted) | (F.bround(tainted, d) == clean) for d in (1, 2, 3)]
    return (clean != tainted) & reduce(lambda a, b: a | b, near)


def looks_outlying(clean: Column, tainted: Column) -> Column:
    return (clean != tainted) & ~looks_rounded(clean, tainted) & (F.abs(tainted - clean) >= F.greatest(F.lit(1.0), F.abs(clean) * 0.1))


def compare(clean: DataFrame, tainted: DataFrame, pk: str, numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """column_name, missing, text_variants, rounded, outliers, other: counts over rows of both."""
    both = clean.alias("c").join(tainted.alias("t"), pk)
    out = []
    for name in (*numbers, *texts):
        c, t = F.col(f"c.{name}"), F.col(f"t.{name}")
        gone = c.isNotNull() & t.isNull()
        none = F.lit(False)
        variant = ((c != t) & (plain_text(c) == plain_text(t))) if name in texts else none
        rounded = looks_rounded(c.cast("double"), t.cast("double")) if name in numbers else none
        far = looks_outlying(c.cast("double"), t.cast("double")) if name in numbers else none
        kinds = {"missing": gone, "text_variants": variant, "rounded": rounded, "outliers": far}
        known = reduce(lambda a, b: a | b, [F.coalesce(k, none) for k in kinds.values()])
        out.append(F.struct(F.lit(name).alias("column_name"), *[F.count_if(F.coalesce(k, none)).alias(x) for x, k in kinds.items()], F.count_if(~c.eqNullSafe(t) & ~known).alias("other")))
    return both.agg(F.array(*out).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def lost_and_added(clean: DataFrame, tainted: DataFrame, pk: str, texts: Sequence[str], others: Sequence[str]) -> DataFrame:
    """One row: keys lost, keys added, and added rows that repeat a clean row but for the key."""
    sign = F.sha2(F.concat_ws("|", *[F.coalesce(plain_text(F.col(x)), F.lit("~")) for x in texts], *[F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in others]), 256)
    added = tainted.join(clean.select(pk), pk, "left_anti").withColumn("sign", sign)
    lost = clean.join(tainted.select(pk), pk, "left_anti").agg(F.count("*").alias("lost"))
    copies = added.join(clean.select(sign.alias("sign")).distinct(), "sign", "left_semi").agg(F.count("*").alias("duplicate_like"))
    return lost.crossJoin(added.agg(F.count("*").alias("added"))).crossJoin(copies)
