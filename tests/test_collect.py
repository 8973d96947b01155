import os
import subprocess
import sys
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wardline.sources import pull
from wardline.streaming import collect, streams

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ROWS = "id long, url string, label string"

KILLED = """
import os, sys, tempfile
from pyspark.sql import SparkSession
from pyspark.sql.readwriter import DataFrameWriter
from wardline.sources import pull
from wardline.streaming import collect
root = sys.argv[1]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
write = DataFrameWriter.parquet
def die(self, path, *rest, **more):
    write(self, path, *rest, **more)
    if path.endswith("batch=1"):
        os._exit(9)
DataFrameWriter.parquet = die
for name in ("b", "c"):
    collect.collect_stream(pull.published_stream(spark, f"{root}/in", "id long, url string, label string"), f"{root}/staging", f"{root}/final", f"{root}/state", lambda _: pull.ended(spark, f"{root}/in"))
    spark.createDataFrame([(i, f"http://{i}", "x") for i in range(10, 25)], "id long, url string, label string").repartition(3).write.parquet(f"{root}/in/{name}")
"""


def publish(spark, root, name, rows):
    spark.createDataFrame(rows, ROWS).repartition(3).write.parquet(f"{root}/{name}")


def test_a_killed_run_goes_on_and_every_row_comes_once(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, f"{root}/in", "a", [(i, f"http://{i}", "x") for i in range(10)])
    done = subprocess.run([sys.executable, "-c", KILLED, root], env=os.environ | {"PYTHONPATH": ROOT}, timeout=300)
    assert done.returncode == 9
    # Batch 1 was written, its commit was not: the state names it as planned only.
    assert os.path.exists(f"{root}/state/offsets/1") and not os.path.exists(f"{root}/state/commits/1")
    left = f"{root}/staging/batch=1"
    pq.write_table(pa.table({"id": pa.array([999], pa.int64()), "url": ["half"], "label": ["x"]}), f"{left}/part-99999-left.parquet")

    def run():
        return collect.collect_stream(pull.published_stream(spark, f"{root}/in", ROWS), f"{root}/staging", f"{root}/final", f"{root}/state", lambda _: pull.ended(spark, f"{root}/in"))

    assert not run() and not os.path.exists(f"{root}/final")
    publish(spark, f"{root}/in", "c", [(i, f"http://{i}", "y") for i in range(25, 40)])
    pull.end(spark, f"{root}/in")
    assert run() and not os.path.exists(f"{root}/staging")
    assert sorted(r["id"] for r in collect.read_collected(spark, f"{root}/final").collect()) == list(range(40))
    publish(spark, f"{root}/in", "d", [(99, "", "y")])
    assert run() and collect.read_collected(spark, f"{root}/final").count() == 40


def test_targets_complete_a_table_over_runs(spark, tmp_path):
    root = str(tmp_path)
    targets = {"x": 5, "y": 4}

    def run():
        rows = pull.published_stream(spark, f"{root}/in", ROWS).where("label IS NOT NULL")
        rows = streams.quota_stream(streams.dedupe_stream(rows, F.lower(F.trim("url"))), "label", 5, "id")
        return collect.collect_stream(rows, f"{root}/staging", f"{root}/final", f"{root}/state", collect.reached("label", targets))

    publish(spark, f"{root}/in", "1", [(1, "http://a", "x"), (2, "HTTP://A ", "x"), (3, "http://b", "y"), (4, None, None)] + [(i, f"http://{i}", "x") for i in range(5, 12)])
    assert not run()
    publish(spark, f"{root}/in", "2", [(i, f"http://{i % 3}/y", "y") for i in range(20, 29)] + [(30, "http://b", "y"), (31, "http://5", "x")])
    assert run()
    got = collect.read_collected(spark, f"{root}/final").collect()
    assert Counter(r["label"] for r in got) == {"x": 5, "y": 4}
    assert len({r["url"].strip().lower() for r in got}) == 9


def test_publications_in_order_whole_and_in_pieces(spark, tmp_path):
    root = f"{tmp_path}/in"
    schema = spark.createDataFrame([], "id long, at timestamp, gone string").schema
    reader = pull.PublishedReader(schema, {"path": root, "bytesPerTask": "2000", "rowsPerBatch": "7"})
    assert reader.latestOffset() == {"after": ""} and reader.partitions({"after": ""}, {"after": ""}) == []
    for name, n in (("p1", 300), ("p2", 0), ("p3", 40)):
        os.makedirs(f"{root}/{name}")
        table = pa.table({"id": pa.array(range(n), pa.int64()), "at": pa.array([0] * n, pa.timestamp("us", "UTC")), "other": pa.array([name] * n)})
        pq.write_table(table, f"{root}/{name}/x.parquet", row_group_size=50)
    os.makedirs(f"{root}/_temporary")
    for name in ("p1", "p3"):
        open(f"{root}/{name}/_SUCCESS", "w").close()
    assert reader.latestOffset() == {"after": "p1"}  # p3 waits for p2
    open(f"{root}/p2/_SUCCESS", "w").close()
    assert reader.latestOffset() == {"after": "p3"}
    pieces = reader.partitions({"after": ""}, {"after": "p3"})
    rows = [r for p in pieces for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(pieces) > 2 and sorted(r["id"] for r in rows) == sorted([*range(300), *range(40)]) and all(r["gone"] is None for r in rows)
    assert [r["id"] for p in reader.partitions({"after": "p1"}, {"after": "p3"}) for b in reader.read(p) for r in b.to_pylist()] == list(range(40))
    assert pull.PublishedReader(schema, {"path": f"file:{root}"}).latestOffset() == {"after": "p3"}
    with pytest.raises(ValueError, match="is gone"):
        reader.partitions({"after": "p3"}, {"after": "p4"})


def test_a_source_without_publications_gives_an_empty_table(spark, tmp_path):
    root = str(tmp_path)

    def run(complete):
        return collect.collect_stream(pull.published_stream(spark, f"{root}/in", ROWS), f"{root}/staging", f"{root}/final", f"{root}/state", complete)

    assert not run(collect.reached("label", {"x": 1})) and not os.path.exists(f"{root}/final")
    assert run(None) and collect.read_collected(spark, f"{root}/final").collect() == []
