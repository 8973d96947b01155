import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wardline.operators import summaries
from wardline.plans import robustness_queries
from wardline.streaming import streams

START = datetime(2024, 3, 1)
EVENTS = "user long, kind string, at timestamp, id long"


def arrive(spark, folder, files):
    """Writes files one after another, so that they arrive in that order."""
    for rows in files:
        (rows if hasattr(rows, "write") else spark.createDataFrame(rows, EVENTS).coalesce(1)).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def worked_off(spark, stream, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


def folded(rows, ttl):
    """fresh by id, from one plain walk over all rows in order of time."""
    last, fresh = {}, {}
    for user, kind, at, i in sorted(rows, key=lambda r: (r[2], r[3])):
        before = last.get((user, kind))
        fresh[i] = before is None or (at - before).total_seconds() >= ttl
        if fresh[i]:
            last[user, kind] = at
    return fresh


def test_reuse_of_shuffled_files_is_that_of_the_whole_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 2, 2, None, 2**60 + 1]), rng.choice(["", "a", None]), START + timedelta(seconds=rng.randrange(4000), microseconds=rng.choice([0, 0, 1, 999_999])), i) for i in range(600)]
    table = spark.createDataFrame(rows, EVENTS)
    files = [rows[k::5] for k in range(5)] + [streams.closing_row(table, "at", "2 hours").coalesce(1)]
    stream = streams.ttl_stream(arrive(spark, str(tmp_path / "in"), files), ["user", "kind"], "at", "id", 300, "2 hours")
    got = worked_off(spark, stream, tmp_path)[0].collect()
    want = folded(rows, 300)
    assert {r["id"]: r["fresh"] for r in got} == want and len(got) == 600
    assert {(r["user"], r["kind"], r["at"], r["id"]) for r in got} == set(rows)
    known = table.where("user IS NOT NULL AND kind IS NOT NULL")
    batch = {r["id"]: r["fresh"] for r in summaries.ttl_reuse(known, ["user", "kind"], "at", "id", 300).collect()}
    assert batch == {r[3]: want[r[3]] for r in rows if r[0] is not None and r[1] is not None}


def test_state_is_let_go_and_late_rows_are_dropped(spark, tmp_path):
    def of(minutes, first):
        return [(1, "a", START + timedelta(minutes=m), first + k) for k, m in enumerate(minutes)]

    files = [of([0, 30, 20, 10], 0), of([60, 25], 10), of([120, 61], 20), of([5], 30), of([400], 40), of([401], 50)]
    stream = streams.ttl_stream(arrive(spark, str(tmp_path / "in"), files), ["user", "kind"], "at", "id", 15 * 60, "40 minutes")
    table, query = worked_off(spark, stream, tmp_path)
    got = {r["id"]: r["fresh"] for r in table.collect()}
    # 30 came after the watermark had passed its time; 40 and 50 wait for a later watermark.
    assert got == {0: True, 3: False, 2: True, 11: False, 1: False, 10: True, 21: False, 20: True}
    assert query.recentProgress[3].stateOperators[0].numRowsDroppedByWatermark == 1


def test_odd_rows_and_empty_streams(spark, tmp_path):
    odd = [(1, "a", None, 1), (1, "a", START, None), (1, "a", START, 2), (1, "a", START, 3), (1, "a", START, 3)]
    table = spark.createDataFrame(odd, EVENTS)
    stream = streams.ttl_stream(arrive(spark, str(tmp_path / "in"), [odd, streams.closing_row(table, "at", "1 minute").coalesce(1)]), ["user", "kind"], "at", "id", 60, "1 minute")
    got = sorted((r["id"], r["fresh"]) for r in worked_off(spark, stream, tmp_path)[0].collect())
    assert got == [(2, True), (3, False), (3, False)]
    none = table.limit(0)
    assert streams.closing_row(none, "at", "1 minute").first()["at"] is None
    (tmp_path / "none").mkdir()
    stream = streams.ttl_stream(arrive(spark, str(tmp_path / "none" / "in"), [streams.closing_row(none, "at", "1 minute")]), ["user", "kind"], "at", "id", 60, "1 minute")
    assert worked_off(spark, stream, tmp_path / "none")[0].where(F.lit(True)).count() == 0


def test_reuse_of_keys_that_share_a_state(spark, tmp_path):
    """All keys in one share and each in its own give the same answer, over several batches."""
    rng = random.Random(9)
    rows = [(i, f"u{rng.randrange(40)}", rng.choice("ab"), 1_700_000_000 + rng.randrange(7_000)) for i in range(1_500)]
    table = spark.createDataFrame(rows, "id int, user string, kind string, s long").select("id", "user", "kind", F.timestamp_seconds("s").alias("at"))
    want = {r["id"]: r["fresh"] for r in summaries.ttl_reuse(table, ["user", "kind"], "at", "id", 300).collect()}
    for shares in (1, 64):
        root = str(tmp_path / f"in{shares}")
        table.repartition(4, F.xxhash64("id")).write.parquet(root)
        streams.closing_row(table, "at", "3 hours").write.mode("append").parquet(root)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(root)
        got = robustness_queries.worked_off(spark, streams.ttl_stream(stream, ["user", "kind"], "at", "id", 300, "3 hours", shares))
        assert {r["id"]: r["fresh"] for r in got.collect()} == want
