"""Versions of tables, releases on disk, databases, and streams that keep a look-back or land in two sinks."""

import hashlib
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import history, quality
from ledgerline.plans import domain, release_bindings, snapshots
from ledgerline.sources import inventory, jdbc, release, versions
from ledgerline.streaming import look_back, taint


def digests(path):
    return {os.path.relpath(os.path.join(d, f), path): hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


# --- versions ---------------------------------------------------------------------------


def test_a_rewrite_touches_only_files_that_hold_the_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select("id", (F.col("id") * 2).alias("v"), F.lit("a").alias("s"))
    assert versions.append(rows.repartitionByRange(8, "id"), path) == 1
    before, parts = digests(path), versions.files(spark, path)
    keys = spark.createDataFrame([(3,), (5,), (999,), (5000,)], "id long")
    number, replaced = versions.rewrite(spark, path, keys, lambda old: old.withColumn("v", F.when(F.col("id").isin(3, 5, 999), -1).otherwise(F.col("v")).cast("long")))
    assert number == 2 and len(replaced) == 2 and len(parts) == 8
    now = versions.files(spark, path)
    assert set(parts) - set(now) == set(replaced)
    assert all(digests(path)[n] == before[n] for n in parts)
    assert {r["id"]: r["v"] for r in versions.read(spark, path).collect()} == {i: -1 if i in (3, 5, 999) else 2 * i for i in range(1000)}
    assert versions.read(spark, path, 1).agg(F.sum("v")).first()[0] == 999_000
    assert versions.rewrite(spark, path, keys.where("id = 5000"), lambda old: old) == (2, [])
    assert sorted(versions.vacuum(spark, path)) == sorted(replaced) and versions.read(spark, path).count() == 1000 and versions.versions(spark, path) == [2]


def test_a_broken_run_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select("id", F.col("id").alias("v"))
    versions.append(rows, path)
    broken = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        versions.rewrite(spark, path, rows.select("id").limit(1), lambda old: old.withColumn("v", broken("v")))
    with pytest.raises(ValueError, match="columns"):
        versions.rewrite(spark, path, rows.select("id").limit(1), lambda old: old.drop("v"))
    with pytest.raises(ValueError, match="columns"):
        versions.append(spark.range(3), path)
    assert versions.versions(spark, path) == [1] and versions.read(spark, path).agg(F.sum("v")).first()[0] == 4950
    with pytest.raises(FileExistsError):
        versions._commit(spark, path, 1, [])
    assert versions.append(rows.select("v", "id"), path) == 2 and versions.read(spark, path).count() == 200
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, 9)


# --- releases on disk -------------------------------------------------------------------


@pytest.fixture
def released(spark, tmp_path):
    tables = {"people": spark.range(500).select("id", F.lit("x").alias("name")).repartition(3), "teams": spark.range(20).repartition(2), "empty": spark.range(0)}
    release.write(tables, str(tmp_path), "first", {"first_day": "2020-01-01", "last_day": "2020-01-31"})
    return tmp_path


def failed(spark, root, **more):
    return {(r["category"], r["name"]): r["failures"] for r in inventory.release_on_disk(spark, str(root), "first", **more).where("status = 'failed'").collect()}


def parquet(root, table):
    return sorted(p for p in (root / "first" / table).iterdir() if p.suffix == ".parquet")


def test_a_whole_release_passes(spark, released):
    assert failed(spark, released, digests=True) == {}
    said = {r["table_name"]: r for r in inventory.manifests(spark, str(released)).collect()}
    assert {t: r["row_count"] for t, r in said.items()} == {"people": 500, "teams": 20, "empty": 0} and said["people"]["columns"] == ["id", "name"] and said["people"]["first_day"] == "2020-01-01"
    assert {(r["table_name"], r["name"]) for r in inventory.listed(spark, str(released)).collect()} == {(t, p.name) for t in said for p in parquet(released, t)}


def test_a_file_that_is_cut_off(spark, released):
    p = parquet(released, "people")[0]
    p.write_bytes(p.read_bytes()[:-40])
    (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    found = failed(spark, released)
    assert found[("readable", "people")] == 1 and found[("file_size", "people")] == 1 and found[("row_count", "people")] > 0 and all(t == "people" for _, t in found)


def test_a_changed_byte_shows_in_the_digest_alone(spark, released):
    p = parquet(released, "people")[0]
    raw = bytearray(p.read_bytes())
    at = raw.index(b"x")
    raw[at : at + 1] = b"y"
    p.write_bytes(raw)
    (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    assert failed(spark, released) == {} and failed(spark, released, digests=True) == {("checksum", "people"): 1}


def test_a_missing_table_a_missing_file_and_a_strange_one(spark, released):
    for p in (released / "first" / "teams").iterdir():
        p.unlink()
    (released / "first" / "teams").rmdir()
    spark.range(7).coalesce(1).write.parquet(str(released / "first" / "other"))
    found = failed(spark, released)
    assert found[("file_exists", "teams")] == 2 and found[("columns", "teams")] == 1 and found[("row_count", "teams")] == 20 and found[("unexpected_file", "other")] == 1


def test_a_wrong_count_in_the_manifest(spark, released):
    p = released / "first" / "manifest.json"
    p.write_text(p.read_text().replace('"row_count": 500', '"row_count": 501'))
    (released / "first" / ".manifest.json.crc").unlink(missing_ok=True)
    assert failed(spark, released) == {("row_count", "people"): 1}


# --- databases --------------------------------------------------------------------------


def test_a_database_table_there_and_back(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, F.col("id") % 40 + 1_000_000).otherwise(F.col("id") * 1000).alias("k"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("s"), F.col("id").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, "none", 1)], "k long, s string, v long"))
    rows.write.jdbc(url, '"t"', properties={"createTableColumnTypes": "s VARCHAR(20)"})
    parts = jdbc.ranges(spark, url, "t", "k", 300)
    back = jdbc.read(spark, url, "t", "k", 300)
    assert back.rdd.getNumPartitions() == len(parts) and back.exceptAll(rows).count() == 0 and back.count() == 4001
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) <= 300 and len(parts) < 40  # a fortieth of 3,000 rows has one key
    assert jdbc.ranges(spark, url, "t", "k", 10**9) == ['"k" IS NULL', '"k" >= 1000000']

    new = rows.where("s = 'even'").withColumn("v", -F.col("v"))
    for _ in range(2):
        assert jdbc.replace_rows(new, url, "t", "\"s\" = 'even'") == 2000
    want = rows.where("s <> 'even'").unionByName(new)
    got = jdbc.read(spark, url, "t", "k", 1000)
    assert got.exceptAll(want).count() == 0 and got.count() == 4001
    with pytest.raises(Exception, match=r"(?i)nothere|column|syntax"):
        jdbc.replace_rows(new, url, "t", '"nothere" = 1')
    assert jdbc.read(spark, url, "t", "k", 1000).count() == 4001
    assert jdbc.replace_rows(new.limit(0), url, "t") == 0 and jdbc.ranges(spark, url, "t", "k", 10) == ["1 = 1"]


# --- streams ----------------------------------------------------------------------------

MATCHES = "player long, ts timestamp, n long"


def test_late_rows_correct_the_days_after_them(spark, tmp_path):
    at = lambda day, hour=12: datetime(2024, 1, day, hour)
    first = [(1, at(1), 1), (1, at(10), 2), (1, at(10), 3), (2, at(3), 1), (1, at(25), 1)]
    second = [(1, at(24, 3), 7), (1, at(11), 1), (2, at(26), 4)]  # the 24th is late but let in
    third = [(1, at(5), 100), (1, at(27), 1), (2, at(27), 1)]  # the 5th is too late by now
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, MATCHES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(MATCHES).option("maxFilesPerTrigger", 1).parquet(source)
        got = look_back.last_rows(look_back.look_back_updates(stream, "player", "ts", "n", 14, "15 days" if i < 2 else "15 days"), out, state, ["key", "day"])
    kept = first + second + [r for r in third if r[1] != at(5)]
    daily = spark.createDataFrame(kept, MATCHES).groupBy("player", F.col("ts").cast("date").alias("day")).agg(F.sum("n").alias("value"))
    want = {tuple(r) for r in history.look_back(daily, "player", "day", "value", 14, "recent").select("player", "day", "value", "recent").collect()}
    found = {tuple(r) for r in got.select("key", F.date_from_unix_date("day").alias("day"), "value", "recent").collect()}
    assert found == want
    assert (1, date(2024, 1, 25), 1, 7 + 1) in found


def test_a_keys_days_are_one_value_of_state(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 4).alias("player"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") / 4).cast("int"))).alias("ts"), F.lit(1).alias("n"))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows.coalesce(1).write.parquet(source)
    got = look_back.last_rows(look_back.look_back_updates(spark.readStream.schema(rows.schema).parquet(source), "player", "ts", "n"), out, state, ["key", "day"])
    assert {(r["key"], r["value"], r["recent"]) for r in got.collect()} == {(k, 1, n) for k in range(4) for n in range(15)} and got.count() == 200
    assert spark.read.format("statestore").load(state).count() == 4  # a row of state a key, not one a day


def test_faults_and_their_record_land_together(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.range(300).select("id", F.lit("AB").alias("kind"))
    rows.where("id < 200").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long, kind string").parquet(source)
    with pytest.raises(FileNotFoundError):
        taint.landed(spark, path)
    for sink in taint.SINKS:  # broken off after each sink: nothing has landed
        with pytest.raises(Exception, match="stopped after"):
            taint.taint_batches(stream(), path, state, "id", {"kind": "missing"}, 0.3, "s", fail_after=sink).awaitTermination()
        assert taint.marked(spark, path) == set()
    taint.taint_batches(stream(), path, state, "id", {"kind": "missing"}, 0.3, "s").awaitTermination()
    before = digests(path)
    rows.where("id >= 200").coalesce(1).write.mode("append").parquet(source)
    taint.taint_batches(stream(), path, state, "id", {"kind": "missing"}, 0.3, "s").awaitTermination()
    assert {k: v for k, v in digests(path).items() if k in before} == before
    tainted, record = taint.landed(spark, path)
    want, said = quality.inject(rows, "id", {"kind": "missing"}, 0.3, "s")
    assert tainted.drop("batch").exceptAll(want).count() == 0 and tainted.count() == 300
    assert record.drop("batch").exceptAll(said).count() == 0 and record.count() == said.count() > 50


def test_a_repeated_batch_changes_neither_sink(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(50).select("id", F.lit("AB").alias("kind")).coalesce(1).write.parquet(source)
    for state in ("one", "two"):  # a lost checkpoint: the batch comes again with its number
        taint.taint_batches(spark.readStream.schema("id long, kind string").parquet(source), path, str(tmp_path / state), "id", {"kind": "missing"}, 0.5, "s").awaitTermination()
        kept = digests(path) if state == "one" else kept
    assert digests(path) == kept and taint.landed(spark, path)[0].count() == 50


def test_rows_of_a_release_are_not_sorted_for_their_ids(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10).alias("k"), F.lit("x").alias("v"))
    got = snapshots._of(rows, spark.createDataFrame([(3,), (3,), (None,), (77,)], "other long"), "k")
    assert got.columns == rows.columns and got.count() == 100 and got.where("k <> 3").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan


def test_last_ratings_of_a_release_are_chosen_before_they_are_sorted(spark):
    rows = snapshots.player_master(domain.tables(spark, "/root/testdata/sf0.001"), release_bindings.UPDATE)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan[plan.index("Sort [") :]
