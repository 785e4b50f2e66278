"""Structured Streaming forms: windowed counts, sessions, a stateful fold, monthly releases."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.operators.ratings import RatingRules


def windowed_counts(events: DataFrame, ts: str = "ts", every: str = "1 day", late: str = "1 day", *keys: str) -> DataFrame:
    """Counts by tumbling window and keys; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), *keys, "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """A row for each run of a key's events without a longer gap: the heartbeat's liveness."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("from_ts"), F.col("s.end").alias("to_ts"), "n")


def running_balance(events: DataFrame, key: str, order: str, change: str, low: float, high: float, start: float) -> DataFrame:
    """The clamped fold as events come, one row a key and micro-batch: key, balance, steps.

    Within a batch events are taken by ``order``; one that comes after a later one of an
    earlier batch is taken when it comes.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, steps = state.get if state.exists else (start, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for x in rows["change"].tolist():
            value = min(high, max(low, value + x))
        steps += len(rows)
        state.update((float(value), int(steps)))
        yield pd.DataFrame({"key": [keys[0]], "balance": [float(value)], "steps": [int(steps)]})

    rows = events.select(F.col(key).cast("long").alias("key"), F.col(order), F.col(change).cast("double").alias("change"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, balance double, steps long", "balance double, steps long", "update", GroupStateTimeout.NoTimeout)


def rating_updates(updates: DataFrame, states: DataFrame, rules: RatingRules = RatingRules()) -> DataFrame:
    """The rating fold as matches come: a row for each update, as the batch fold gives it.

    ``states`` is a static table of what players start from. Within a micro-batch a player's updates are
    taken by (match_date, match_id); one that comes late is taken when it comes. The state of a player is three numbers.
    """
    places = Decimal("0.001")
    three = lambda x: Decimal(str(x)).quantize(places, ROUND_HALF_UP)
    share = lambda x: Decimal(str(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["match_date", "match_id"])
        first = rows.iloc[0]
        rating, sure, n = state.get if state.exists else (str(first["rating"]), None if pd.isna(first["confidence"]) else str(first["confidence"]), int(first["match_count"]))
        rating, sure, out = three(rating), None if sure is None else three(sure), []
        for day, match, expected, actual in rows[["match_date", "match_id", "expected_score_share", "actual_score_share"]].itertuples(index=False):
            k = three(rules.k_elite if rating >= three(rules.elite_from) else rules.k_new if n < rules.new_below else rules.k_established)
            after = max(three(rules.low), min(three(rules.high), rating + three(k * (share(actual) - share(expected)))))
            then = None if sure is None else three(min(three(rules.confidence_max), sure + three(rules.confidence_step)))
            n += 1
            out.append((key[0], day, match, k, rating, after - rating, after, sure, then, n))
            rating, sure = after, then
        state.update((str(rating), None if sure is None else str(sure), n))
        yield pd.DataFrame(out, columns=names)

    d = "decimal(8,3)"
    shape = f"player_id long, match_date date, match_id long, k_factor {d}, rating_before {d}, rating_delta {d}, rating_after {d}, confidence_before {d}, confidence_after {d}, match_count long"
    names = [c.split()[0] for c in shape.split(", ")]
    rows = updates.join(states.select("player_id", "rating", "confidence", "match_count"), "player_id")
    return rows.groupBy("player_id").applyInPandasWithState(step, shape, "rating string, confidence string, n long", "append", GroupStateTimeout.NoTimeout)


def append_batches(stream: DataFrame, path: str, checkpoint: str, month: str):
    """Append what has come since the last run as ``month=`` partitions; each batch lands once.

    A batch's folder is named by its number and written over, so a repeat changes nothing.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").partitionBy(month).parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
