"""Token ids in binary containers with Elias-Fano coded document boundaries."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import documents, leaner, saved, worker_cache
from wardline.llm.tokens import Container, Encoder, write_container
from wardline.llm.wordhash import slices

END = 2
CONTAINER_IDS = 2_000_000
TEXT = 1 << 20  # bytes of text encoded at a time


def encoder(path: str | None) -> Encoder:
    """One encoder in each Python worker; it is kept from task to task."""
    return worker_cache(("encoder", path), lambda: Encoder(path))


def containers(docs: DataFrame, end: int = END, most_ids: int = CONTAINER_IDS, tokenizer: str | None = None) -> DataFrame:
    """part, seq, doc_ids, n_ids, data: the rows of docs in their partitions' order, some million ids a container.

    A container holds one document at least, whole, and ends with the first slice of rows (of TEXT bytes,
    or one longer text) that brings it to most_ids. part and seq give the order. Null texts are empty.
    """
    of = dict(docs.dtypes)["doc_id"]

    def run(batches):
        enc, part, seq, names, held, sizes, n = encoder(tokenizer), TaskContext.get().partitionId(), 0, [], [], [], 0

        def row():
            whole = pa.concat_arrays(names)
            listed = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            box = write_container(np.concatenate(held), np.append(0, np.cumsum(np.concatenate(sizes))))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), listed, pa.array([n], pa.int64()), pa.array([box], pa.binary())], ["part", "seq", "doc_ids", "n_ids", "data"])

        for batch in batches:
            done = 0
            for texts in slices(batch["text"], TEXT):
                ids, at = enc.encode_column(texts, end)
                names.append(batch["doc_id"].slice(done, len(texts)))
                held.append(ids)
                sizes.append(np.diff(at))
                done += len(texts)
                n += len(ids)
                if n >= most_ids:
                    yield row()
                    seq, names, held, sizes, n = seq + 1, [], [], [], 0
        if held:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(leaner(run), f"part int, seq int, doc_ids array<{of}>, n_ids long, data binary")


def encode_documents(docs: DataFrame, **how) -> DataFrame:
    """The containers of docs in ascending order of doc_id (null first), written in the shared folder and read again.

    Documents of one doc_id are in order of a hash of their text, and rows equal in both in that of the
    partitions they came from, so that neither a null nor a repeated doc_id needs one task. Empty tables
    give no container; other columns, whatever their names, are ignored.
    """
    keys = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.spark_partition_id().alias("origin"))
    by = ("doc_id", "text_hash", "origin")
    return saved(containers(keys.repartitionByRange(*by).sortWithinPartitions(*by, "text"), **how), "token-ids")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the containers by selects in their boundaries.

    No container gives no rows; every document has its row, also if it repeats another.
    """
    of = dict(files.dtypes)["doc_ids"][6:-1]
    # Sums over parts, one row each, and inside each part: no task numbers all containers.
    parts = files.groupBy(F.col("part").alias("q")).agg(F.sum("n_ids").alias("n"))
    parts = parts.select("q", F.coalesce(F.sum("n").over(W.orderBy("q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    before = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    bases = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("inner_start")).join(parts, F.col("part") == F.col("q"))
    bases = bases.select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("part_start") + F.col("inner_start")).alias("base"))

    def run(batches):
        for batch in batches:
            for part, seq, names, data in zip(*(batch[c] for c in ("part", "seq", "doc_ids", "data")), strict=True):
                box = Container(data.as_py())
                at = [box.start(i) for i in range(box.n + 1)]
                crc = [zlib.crc32(box.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
                k, at = box.n, np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), names.values, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "doc_ids", "data").mapInArrow(leaner(run), f"part int, seq int, doc_id {of}, inner long, n_tokens long, ids_crc32 long")
    joined = rows.join(bases, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    return joined.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_ids(spark, sf_dir):
    return read_documents(encode_documents(documents(spark, sf_dir)))
