"""Near-duplicate embeddings by a navigable small-world graph for each shard.

Equal vectors of a label are one node. The nodes of a label are dealt to shards, each with its own
hierarchical graph; every node is searched for in every shard of its label. A search runs a best-first
beam and then follows the graph from what links until nothing new links, so families of any size are
found whole. Of each pair of shards some nodes are audited, by comparing them with all others: a fixed
number of random ones, whatever the search said of them, and as many that it linked. Audits are pooled
over all pairs of shards of a label, and a label whose mean recall is below the goal is searched again
with twice the beam; only where half a shard is not beam enough are all compared. Links are verified by
cosine in double precision; each pair of shards reports counts of links and a spanning forest, whose
union gives the components.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.ann import usable
from wardline.llm.common import cut, embeddings, saved
from wardline.llm.components import connected_components

THRESHOLD = 0.98
SHARD = 8_192
M = 12
EF_BUILD = 40
EF = 32
AUDIT = 48  # random nodes of a pair of shards, and as many with a link
BLOCK = 256
RECALL = 0.995
CHUNK = 16  # shards whose vectors pass one after another by a graph
MOST_TASKS = 20_000
ARROW = {c: pa.float64() if c == "recalls" else pa.int64() for c in ("gid", "node", "links", "root", "audited", "recalls", "compared", "pairs")}


class Graph:
    """A hierarchical navigable small-world graph over rows of unit vectors."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.layers, self.entry, self.both = x, layers if layers is not None else [], entry, None
        self.compared = 0  # nodes that searches compared with what they asked for

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 5) -> Graph:
        n = len(x)
        levels = (-np.log(np.random.default_rng(seed).random(n)) / math.log(M)).astype(int)
        g = cls(x, [np.full((n, 2 * M if level == 0 else M), -1, np.int32) for level in range(int(levels.max(initial=0)) + 1)])
        top = -1
        for i in range(n):
            if top < 0:
                g.entry, top = i, int(levels[i])
                continue
            at = g.descend(x[i], top, int(levels[i]))
            for level in range(min(top, int(levels[i])), -1, -1):
                near = g.beam(x[i], [at], EF_BUILD, level)
                chosen = g.choose(near, M)
                g.layers[level][i, : len(chosen)] = chosen
                for j in chosen:
                    g.link(level, j, i)
                at = near[0][1]
            if levels[i] > top:
                g.entry, top = i, int(levels[i])
        return g

    def descend(self, q: np.ndarray, top: int, level: int) -> int:
        at = self.entry
        best = float(self.x[at] @ q)
        for layer in range(top, level, -1):
            while True:
                near = self.layers[layer][at]
                near = near[near >= 0]
                if not len(near):
                    break
                sims = self.x[near] @ q
                self.compared += len(near)
                k = int(sims.argmax())
                if sims[k] <= best:
                    break
                at, best = int(near[k]), float(sims[k])
        return at

    def beam(self, q: np.ndarray, start: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        """(similarity, node) of about the ef nearest, best first."""
        seen = set(start)
        open_, kept = [], []
        for i in start:
            s = float(self.x[i] @ q)
            open_.append((-s, i))
            kept.append((s, i))
        heapq.heapify(open_)
        heapq.heapify(kept)
        links = self.layers[level]
        while open_:
            s, i = heapq.heappop(open_)
            if -s < kept[0][0] and len(kept) >= ef:
                break
            new = [j for j in links[i].tolist() if j >= 0 and j not in seen]
            if not new:
                continue
            seen.update(new)
            self.compared += len(new)
            for t, j in zip((self.x[new] @ q).tolist(), new, strict=True):
                if len(kept) < ef:
                    heapq.heappush(kept, (t, j))
                    heapq.heappush(open_, (-t, j))
                elif t > kept[0][0]:
                    heapq.heapreplace(kept, (t, j))
                    heapq.heappush(open_, (-t, j))
        return sorted(kept, reverse=True)

    def choose(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions first; what is nearer to a chosen one fills up the rest."""
        ids = [i for _, i in near]
        between = self.x[ids] @ self.x[ids].T
        chosen: list[int] = []
        for k, (s, _) in enumerate(near):
            if len(chosen) < most and all(between[k, c] < s for c in chosen):
                chosen.append(k)
        rest = [k for k in range(len(near)) if k not in chosen]
        return [ids[k] for k in chosen + rest[: most - len(chosen)]]

    def link(self, level: int, j: int, i: int) -> None:
        own = self.layers[level][j]
        used = int((own >= 0).sum())
        if used < len(own):
            own[used] = i
            return
        ids = np.append(own, i)
        sims = self.x[ids] @ self.x[j]
        order = np.lexsort((ids, -sims))
        own[:] = self.choose([(float(sims[k]), int(ids[k])) for k in order], len(own))

    def within(self, q: np.ndarray, threshold: float, ef: int, start: int | None = None) -> np.ndarray:
        """Nodes at least threshold similar to q: those of the beam, and all that links reach from them."""
        at = self.descend(q, len(self.layers) - 1, 0) if start is None else start
        found = [i for s, i in self.beam(q, [at], ef, 0) if s >= threshold]
        if not found:
            return np.zeros(0, np.int64)
        inside = np.zeros(len(self.x), bool)
        tried = np.zeros(len(self.x), bool)
        inside[found] = tried[found] = True
        edge = np.array(found)
        while len(edge):
            near = self.around(edge)
            near = near[~tried[near]]
            tried[near] = True
            near = np.flatnonzero(np.bincount(near, minlength=1)) if len(near) else near
            self.compared += len(near)
            edge = near[self.x[near] @ q >= threshold]
            inside[edge] = True
        return np.flatnonzero(inside)

    def around(self, nodes: np.ndarray) -> np.ndarray:
        """All that the nodes link to or are linked from at the lowest layer, with repeats."""
        if self.both is None:
            links = self.layers[0]
            of, to = np.repeat(np.arange(len(links)), links.shape[1]), links.ravel()
            of, to = of[to >= 0], to[to >= 0]
            a, b = np.concatenate([of, to]), np.concatenate([to, of])
            order = np.argsort(a, kind="stable")
            self.both = np.searchsorted(a[order], np.arange(len(links) + 1)), b[order]
        first, to = self.both
        n = first[nodes + 1] - first[nodes]
        return to[np.repeat(first[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def search_pair(q: np.ndarray, graph: Graph, same: bool, threshold: float = THRESHOLD, ef: int = EF, audit: int = AUDIT) -> tuple[np.ndarray, list[float]]:
    """Which rows of the graph link with which row of q, as a matrix, and the search's recall for each audited row that links.

    What the audit finds is in the matrix too. With a beam of over half the graph rows are compared with all.
    """
    hit = np.zeros((len(q), len(graph.x)), bool)
    if 2 * ef > len(graph.x):
        for at in range(0, len(q), BLOCK):
            hit[at : at + BLOCK] = q[at : at + BLOCK] @ graph.x.T >= threshold
        graph.compared += hit.size
        return hit, [1.0] * int((hit.sum(1) > same).sum())
    for i in range(len(q)):
        hit[i, graph.within(q[i], threshold, ef, i if same else None)] = True
    order = np.random.default_rng(len(q)).permutation(len(q))
    linked = order[hit[order].sum(1) > same]
    recalls = []
    for i in np.union1d(order[:audit], linked[:audit]).tolist():
        exact = graph.x @ q[i] >= threshold
        graph.compared += len(exact)
        if int(exact.sum()) > same:
            recalls.append((int((hit[i] & exact).sum()) - same) / (int(exact.sum()) - same))
        hit[i] |= exact
    return hit, recalls


def verify(hit: np.ndarray, q: np.ndarray, x: np.ndarray, lq: np.ndarray, lx: np.ndarray, threshold: float) -> None:
    """Keeps in hit the pairs whose cosine is at least the threshold, in double precision on the original vectors."""
    for i in range(len(hit)):
        js = np.flatnonzero(hit[i])
        hit[i, js] = (x[js] @ q[i]) / (lx[js] * lq[i]) >= threshold


def forest(hit: np.ndarray) -> np.ndarray:
    """The smallest place in each place's component, rows first, then columns. Of one set with itself the diagonal must be set."""
    n, m = hit.shape
    root = np.arange(n + m)
    left_rows, left_columns = np.ones(n, bool), np.ones(m, bool)
    for i in range(n):
        if not left_rows[i]:
            continue
        left_rows[i], edge = False, np.array([i])
        while len(edge):
            columns = np.flatnonzero(hit[edge].any(0) & left_columns)
            left_columns[columns] = False
            root[n + columns] = i
            rows = np.zeros(n, bool)
            for at in range(0, len(columns), BLOCK):
                rows |= hit[:, columns[at : at + BLOCK]].any(1)
            edge = np.flatnonzero(rows & left_rows)
            left_rows[edge] = False
            root[edge] = i
    return root


def usable_rows(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and the nodes: distinct vectors of a label that can link, each under its smallest id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    part = rows.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    nodes = part.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    return rows, cut(nodes.withColumn("dim", F.size("vector")))


def searched(nodes: DataFrame, threshold: float, shard: int, ef: int, goal: float) -> tuple[DataFrame, DataFrame]:
    """What the shards of each label found (node, links, root), and the audits of each label and beam.

    Audits: gid (of a label and dimension), beam, audited (rows with a link), recall (null without any),
    compared (pairs), pairs (in all).
    """
    many = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = nodes.join(many, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    label = dict(nodes.dtypes)["label"]

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        x = np.array(group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(group), -1)
        g = Graph.build(x / np.linalg.norm(x, axis=1)[:, None])
        cols = {"nodes": group["node"].to_numpy(), "copies": group["copies"].to_numpy(), "vectors": x}
        return pa.table({c: group[c][:1] for c in ("label", "dim", "shard")} | {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in cols.items()} | {"layers": pa.array([[a.tobytes() for a in g.layers]], pa.list_(pa.binary())), "entry": pa.array([g.entry], pa.int32())})

    graphs = saved(dealt.groupBy("label", "dim", "shard").applyInArrow(build, f"label {label}, dim int, shard int, nodes binary, copies binary, vectors binary, layers array<binary>, entry int"), "graphs")
    # Each graph goes to a task for every CHUNK of the shards that ask it; their vectors follow one by one.
    keys = graphs.select("label", "dim", "shard")
    tasks = cut(keys.withColumnRenamed("shard", "from_shard").join(keys, ["label", "dim"]).where("from_shard <= shard").withColumn("chunk", F.floor(F.col("from_shard") / CHUNK).cast("int")))
    by = ("label", "dim", "shard", "chunk")

    def pairs_of(tasks: DataFrame) -> DataFrame:
        of_task = tasks.select(*by).distinct()
        asked = graphs.join(of_task, ["label", "dim", "shard"]).withColumn("from_shard", F.lit(-1))
        asking = graphs.withColumnRenamed("shard", "from_shard").join(tasks, ["label", "dim", "from_shard"]).withColumns({"layers": F.lit(None).cast("array<binary>"), "entry": F.lit(None).cast("int")})
        spread = asked.unionByName(asking).repartition(min(max(1, of_task.count()), MOST_TASKS), *by).sortWithinPartitions(*by, "from_shard")
        return spread.withColumn("gid", F.xxhash64("label", "dim")).drop("label")

    def search(batches, beam):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                ids, copies = np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["copies"], "<i8")
                qx = np.frombuffer(r["vectors"], "<f8").reshape(len(ids), -1)
                lq = np.linalg.norm(qx, axis=1)
                if r["from_shard"] < 0:
                    b, nb, x, lx = ids, copies, qx, lq
                    graph = Graph(x / lx[:, None], [np.frombuffer(v, np.int32).reshape(len(b), -1) for v in r["layers"]], r["entry"])
                    continue
                same = r["from_shard"] == r["shard"]
                graph.compared = 0
                hit, recalls = search_pair(qx / lq[:, None], graph, same, threshold - 1e-9, beam)
                verify(hit, qx, x, lq, lx, threshold)
                if same:  # a link that one end found and the other missed counts for both
                    hit |= hit.T
                    np.fill_diagonal(hit, False)
                links = np.array([nb[row].sum() for row in hit], np.int64)
                if same:
                    np.fill_diagonal(hit, True)
                root = forest(hit)
                if same:
                    root = root[: len(ids)]
                else:
                    ids = np.concatenate([ids, b])
                    links = np.concatenate([links, np.array([copies[hit[:, j]].sum() for j in range(len(b))], np.int64)])
                keep = links > 0
                n = int(keep.sum())
                audit = [r["gid"], None, None, None, len(recalls), float(sum(recalls)), graph.compared, hit.size]
                cols = [[r["gid"]] * n, ids[keep], links[keep], ids[root][keep], *[[None] * n] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([*c, last], kind) for c, last, kind in zip(cols, audit, ARROW.values(), strict=True)], list(ARROW))

    kinds = ", ".join(f"{c} {'double' if kind == pa.float64() else 'long'}" for c, kind in ARROW.items())
    tasks, beam, parts, audits = tasks.withColumn("gid", F.xxhash64("label", "dim")), ef, [], []
    while True:
        answers = cut(pairs_of(tasks.drop("gid")).mapInArrow(functools.partial(search, beam=beam), kinds))
        pooled = answers.where("node IS NULL").groupBy("gid").agg(*(F.sum(c).alias(c) for c in ("audited", "recalls", "compared", "pairs")))
        audits.append(cut(pooled.select("gid", F.lit(beam).alias("beam"), "audited", F.when(F.col("audited") > 0, F.col("recalls") / F.col("audited")).alias("recall"), "compared", "pairs")))
        failed = audits[-1].where(F.col("recall") < goal).select("gid")
        parts.append(answers.where("node IS NOT NULL").join(failed, "gid", "left_anti").select("node", "links", "root"))
        if failed.isEmpty():
            break
        tasks, beam = tasks.join(failed, "gid", "left_semi"), 2 * beam
    return functools.reduce(DataFrame.unionByName, parts), functools.reduce(DataFrame.unionByName, audits)


def search_audits(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, ef: int = EF, goal: float = RECALL) -> DataFrame:
    """label, dim, beam, audited, recall, compared, pairs for each label and each beam it was searched with.

    The last beam of a label is the one whose links count. Labels without a vector that can link give no row.
    """
    nodes = usable_rows(vectors)[1]
    audits = searched(nodes, threshold, shard, ef, goal)[1]
    named = nodes.select("label", "dim").distinct().withColumn("gid", F.xxhash64("label", "dim"))
    return named.join(audits, "gid").drop("gid")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, ef: int = EF, goal: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors that usable() refuses, or whose label or vec_id is null, link with nothing: they have 0 links
    and their own component, and are kept. Repeated rows and equal vectors link with each other. Vectors
    are compared within their label and dimension. Empty tables give no rows; other columns are ignored.
    """
    rows, nodes = usable_rows(vectors)
    found = searched(nodes, threshold, shard, ef, goal)[0]
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    info = nodes.join(counts, "node", "left").join(parts, "node", "left").select(F.col("label").alias("of"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"), F.xxhash64("vector").alias("h"))
    alone = ~(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    joined = rows.join(info, (F.xxhash64("vector") == F.col("h")) & (F.col("label") == F.col("of")) & (F.col("vector") == F.col("v")) & F.col("vec_id").isNotNull(), "left")
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_embedding_neardup(spark, sf_dir):
    return near_duplicate_vectors(embeddings(spark, sf_dir))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.a AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)
"""
