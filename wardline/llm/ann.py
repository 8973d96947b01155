"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's code is the signs of its direction after a random rotation, one bit a dimension, with two
correction scalars: its length, and how far the code's own direction agrees with it. From these the
inner product with a query is estimated, with an error that stays below a bound except with small
probability. In each block the best guesses, scored exactly, set the bar; only vectors whose upper bound
reaches it are scored exactly too, in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import cut, embeddings, saved

BLOCK = 16_384
QUERY_BLOCK = 4_096
WIDTH = 3.2  # of the error bound, in its standard deviations
SEED = 29
CHUNK = 16  # query blocks that pass one after another by a block
MOST_TASKS = 20_000


def usable(v: Column) -> Column:
    """Neither null, empty, zero nor holding null or non-finite components."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(v, lambda x: x != 0)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and agreement of each code with its vector's direction."""
    length = np.linalg.norm(x, axis=1)
    turned = (x / length[:, None]) @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """dim, <name>, ids, vectors, codes, lengths, agreement: one row per block, as bytes."""
    n = vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("n_blocks"))
    dealt = vectors.join(n, "dim").withColumn(name, F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = np.array(group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(group), -1)
        codes, length, agree = encode(x)
        ids = group["id"].to_numpy()
        return pa.table({"dim": group["dim"][:1], name: group[name][:1], "n_blocks": group["n_blocks"][:1]} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("ids", ids), ("vectors", x), ("codes", codes), ("lengths", length), ("agreement", agree))})

    return dealt.groupBy("dim", name).applyInArrow(pack, f"dim int, {name} int, n_blocks int, ids binary, vectors binary, codes binary, lengths binary, agreement binary")


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, agree: np.ndarray, k: int, width: float = WIDTH):
    """(query id, id, score) of each query's k best in the block, its own row left out."""
    d = x.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    spread = length * np.sqrt(np.maximum(1 - agree**2, 0)) / agree * width / np.sqrt(max(d - 1, 1))
    turned = (q @ rotation(d).T).astype(np.float32)
    out = []
    for at in range(0, len(q), 128):
        guess = turned[at : at + 128] @ signs.T * (length / agree).astype(np.float32)
        error = np.linalg.norm(q[at : at + 128], axis=1)[:, None] * spread + 1e-5
        own = q_ids[at : at + 128, None] == ids
        guess[own] = -np.inf
        for i, (near, within) in enumerate(zip(guess, error, strict=True)):
            # The k-th best exact score among the best guesses is the bar that upper bounds must reach.
            m = min(4 * k, len(x))
            first = np.argpartition(-near, m - 1)[:m]
            exact = np.where(np.isneginf(near[first]), -np.inf, x[first] @ q[at + i])
            bar = np.partition(exact, -k)[-k] if k <= m else -np.inf
            chosen = np.flatnonzero((near + within >= bar - 1e-9) & ~np.isneginf(near))
            score = x[chosen] @ q[at + i]
            if len(chosen) > k:
                chosen = chosen[score >= np.partition(score, -k)[-k] - 1e-9]
            score = np.zeros(len(chosen))
            for j in range(d):  # one order of summing, whatever the block
                score += x[chosen, j] * q[at + i, j]
            best = np.lexsort((ids[chosen], -score))[:k]
            out.append((np.full(len(best), q_ids[at + i]), ids[chosen][best], score[best]))
    return out


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, width: float = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by inner product, ties to the smaller vec_id.

    Both take vec_id and embedding; other columns are ignored. Vectors that usable() refuses and rows
    with a null id take no part; vectors are compared with those of their own dimension. Rows repeated
    under one id are one candidate each; a query leaves out every row of its own id. A query with fewer than
    k candidates gets all; empty tables give no rows.
    """
    shape = lambda df: df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("vector"))
    held = saved(blocks(shape(candidates), block, "block"), "codes")
    asked = cut(blocks(shape(queries), query_block, "asked").select("dim", "asked", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    # Each block goes to a task for every CHUNK of the query blocks; these follow one by one.
    pairs = cut(asked.select("dim", "asked").join(held.select("dim", "block"), "dim").withColumn("chunk", F.floor(F.col("asked") / CHUNK).cast("int")))
    of_task = pairs.select("dim", "block", "chunk").distinct()
    none = {c: F.lit(None).cast("binary") for c in ("codes", "lengths", "agreement")}
    blocks_ = held.drop("n_blocks").join(of_task, ["dim", "block"]).withColumn("asked", F.lit(-1))
    queries_ = asked.withColumnsRenamed({"q_ids": "ids", "q_vectors": "vectors"}).join(pairs, ["dim", "asked"]).withColumns(none)
    by = ("dim", "block", "chunk")
    work = blocks_.unionByName(queries_).repartition(min(max(1, of_task.count()), MOST_TASKS), *by).sortWithinPartitions(*by, "asked")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                read = lambda c, t: np.frombuffer(batch[c][r].as_py(), t)  # noqa: B023, E731
                ids = read("ids", "<i8")
                x = read("vectors", "<f8").reshape(len(ids), -1)
                if batch["asked"][r].as_py() < 0:
                    kept = x, ids, read("codes", "u1").reshape(len(ids), -1), read("lengths", "<f8"), read("agreement", "<f8")
                    continue
                found = search_block(x, ids, *kept, k, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    best = work.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return nearest(rows, rows.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
