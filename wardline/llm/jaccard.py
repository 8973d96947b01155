"""N-gram Jaccard join, heavy-light by set size.

Documents with equal shingle sets are one class; only classes are compared. Pairs whose smaller set has
at most `boundary` shingles are found by enumerating subsets: two sets of n and m elements link exactly
if they share ceil(p (n + m) / (100 + p)) of them, so both list their subsets of that size under the key
(n, m, subset). Larger sets are put into inverted lists. A list of one class links nothing, so a set of n
whose shingles in longer lists number less than p n / 100 is done with; the others keep those shingles,
from the shortest list to the longest. Of two that link the first n - ceil(p n / 100) + 1 places share a
list (places before them are the shingles of no other set). In each list every member is first tested
against the most central ones, which joins families of near copies without comparing all their pairs;
then members that are still in different components are tested where bounds allow a link. The boundary is
where the sum of both costs, from the size histogram and the mean list length, is least.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import WORD, as_int, cut, documents, forget_caches, leaner, let_go, saved
from wardline.llm.components import connected_components
from wardline.llm.wordhash import U, mixed, slices, word_hashes

WORDS = 5
PERCENT = 75
BUCKET = 1_000_000  # shingles a bucket
LARGEST_LIGHT = 12
CENTRAL = 16  # members of a list that all others are tested against before any pair of others
CHUNK = 700_000  # shingles that a task holds
TEXT = 2 << 20  # bytes hashed at a time; a longer text is hashed alone
#: Lists that a sample of classes shows to be long skip the shuffle by shingle: their place in the order is their
#: count in the sample. The sample sets where work is done, not what is found; it bounds what the driver gathers.
SAMPLE = 8_000_000  # shingles
OFTEN = 12  # sampled classes that make a list long: at most SAMPLE / OFTEN lists
LONG = 1 << 31  # what is added to their places


def shingles_in_order(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word n-grams (of a shorter text, of all its words together), and where each row's begin."""
    w, at = word_hashes(column)
    n = np.diff(at)
    at_sets = np.append(0, np.cumsum(np.where(n >= words, n - words + 1, n > 0)))
    out = np.empty(at_sets[-1], np.uint64)
    short = np.flatnonzero((n > 0) & (n < words))
    whole = np.ones(len(out), bool)
    whole[at_sets[short]] = False
    windows = max(len(w) - words + 1, 0)
    h = np.full(windows, words, np.uint64)
    for i in range(words):
        h = h * U(0x9E3779B97F4A7C15) + w[i : windows + i]
    inside = np.ones(len(w), bool)  # a window from here ends in its own row
    for i in range(1, words):
        inside[(at[1:] - i)[n >= i]] = False
    out[whole] = h[inside[:windows]]
    for r in short.tolist():
        x = int(n[r])
        for v in w[at[r] : at[r + 1]].tolist():
            x = (x * 0x9E3779B97F4A7C15 + v) & 0xFFFFFFFFFFFFFFFF
        out[at_sets[r]] = x
    return mixed(out), at_sets


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams, and where each row's begin."""
    out, at_sets = shingles_in_order(column, words)
    if not len(out):
        return out, at_sets
    ends = at_sets.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at_sets[:-1][at_sets[:-1] < at_sets[1:]]] = True
    return out[keep], np.append(0, np.cumsum(keep))[at_sets]


def class_numbers(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for equal sets."""
    raw, ends = memoryview(sets).cast("B"), (at * 8).tolist()
    return np.array([xxhash.xxh64_intdigest(raw[a:b], 3) for a, b in zip(ends, ends[1:], strict=False)], np.uint64).view(np.int64)


def least_shared(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, boundary: int, percent: int):
    """(partner size, subset size) of the subsets that a set of n lists for pairs with a side within the boundary."""
    return [(m, least_shared(n, m, percent)) for m in partners(n, percent) if min(n, m) <= boundary and least_shared(n, m, percent) <= min(n, m)]


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int, largest: int = LARGEST_LIGHT) -> int:
    """The boundary with the least cost: subsets listed, and inverted lists scanned, per class."""

    def cost(x: int) -> float:
        listed = sum(c * sum(math.comb(n, k) for _, k in subset_sizes(n, x, percent)) for n, c in sizes.items())
        return listed + sum(c * prefix_length(n, percent) * (1 + list_length) for n, c in sizes.items() if n > x)

    return min(range(largest + 1), key=cost)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one value; the numbers' first bytes lie together, then their second ones, and so on."""
    lengths = np.array([len(columns), *(len(c) * c.itemsize for c in columns)], "<u8").tobytes()
    return zstandard.compress(b"".join([lengths, *(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)]), 1)


def unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, "<u8", len(kinds) + 1)[1:].astype(int)
    out, at = [], 8 * (len(kinds) + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(width, size // width).T).view(kind).ravel())
        at += size
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each number, rising with it."""
    return (h.view(np.uint64) >> U(32)) * U(buckets) >> U(32)


def runs(bucket: np.ndarray):
    """(bucket, slice) of each bucket in sorted buckets."""
    if not len(bucket):
        return []
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return [(int(bucket[i]), slice(int(i), int(j))) for i, j in zip(first, [*first[1:], len(bucket)], strict=True)]


def chunks(batches, words: int):
    """Classes of a task's texts, each once a chunk: numbers, sizes, and their sets one after another."""
    forget_caches()
    ids, sizes, sets, seen, n = [], [], [], set(), 0
    for batch in batches:
        for part in slices(batch["text"], TEXT):
            flat, at = shingle_sets(part, words)
            size, own = np.diff(at), class_numbers(flat, at)
            new = np.zeros(len(own), bool)
            for k, c in enumerate(own.tolist()):
                if size[k] and c not in seen:
                    seen.add(c)
                    new[k] = True
            ids.append(own[new])
            sizes.append(size[new])
            sets.append(flat[np.repeat(new, size)])
            n += len(sets[-1])
            if n >= CHUNK:
                yield np.concatenate(ids), np.concatenate(sizes), np.concatenate(sets)
                ids, sizes, sets, seen, n = [], [], [], set(), 0
    if n:
        yield np.concatenate(ids), np.concatenate(sizes), np.concatenate(sets)


def classes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, class of every row."""

    def run(batches):
        forget_caches()
        for batch in batches:
            done = 0
            for part in slices(batch["text"], TEXT):
                flat, at = shingle_sets(part, words)
                names = batch["doc_id"].slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(at)), pa.array(class_numbers(flat, at))], ["doc_id", "n_shingles", "class"])

    return docs.select("doc_id", "text").mapInArrow(leaner(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, class long")


def long_lists(docs: DataFrame, words: int, total: int) -> DataFrame:
    """h, n of the shingles in at least OFTEN classes of a sample; and with h null sums of n and of n (n - 1) of the others."""
    share = min(1.0, SAMPLE / max(total, 1))
    buckets = max(1, -(-min(total, SAMPLE) // BUCKET))

    def draw(batches):
        for ids, sizes, sets in chunks(batches, words):
            drawn = mixed(ids.view(np.uint64)) < U(min(int(share * 2.0**64), 2**64 - 1))
            h = np.sort(sets[np.repeat(drawn, sizes)])
            parts = runs(bucket_of(h, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int64()), pa.array([squeeze(np.diff(h[s], prepend=U(0))) for _, s in parts], pa.binary())], ["bucket", "data"])

    def count(group: pa.Table) -> pa.Table:
        h, n = np.unique(np.concatenate([np.cumsum(unsqueeze(x.as_py(), "<u8")[0], dtype=np.uint64) for x in group["data"]]), return_counts=True)
        often = n >= OFTEN
        rest = n[~often].astype(np.int64)
        return pa.table({"h": pa.array([*h[often].view(np.int64).tolist(), None], pa.int64()), "n": pa.array([*n[often].tolist(), int(rest.sum())], pa.int64()), "pairs": pa.array([*[0] * int(often.sum()), int((rest * (rest - 1)).sum())], pa.int64())})

    return docs.select("text").mapInArrow(leaner(draw), "bucket long, data binary").groupBy("bucket").applyInArrow(leaner(count), "h long, n long, pairs long")


class Lists:
    """What postings() sends to a bucket: classes with their sizes, and which shingle is in which of them."""

    KINDS = ("<i8", "<u4", "<u8", "<u4", "<u4")

    @classmethod
    def pack(cls, ids: np.ndarray, sizes: np.ndarray, h: np.ndarray, of: np.ndarray, order: np.ndarray) -> bytes:
        """h must rise."""
        used, place = np.unique(of, return_inverse=True)
        return squeeze(ids[used], sizes[used].astype(np.uint32), np.diff(h, prepend=U(0)), place.astype(np.uint32), order.astype(np.uint32))

    @classmethod
    def read(cls, parts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Distinct classes, their sizes; shingle, place of its class, and its list's place in the order."""
        found, base = [], 0
        for data in parts:
            c, n, h, of, order = unsqueeze(data, *cls.KINDS)
            found.append((c, n.astype(np.int64), np.cumsum(h, dtype=np.uint64), of.astype(np.int64) + base, order))
            base += len(c)
        c, n, h, of, order = (np.concatenate(x) for x in zip(*found, strict=True))
        c, first, back = np.unique(c, return_index=True, return_inverse=True)
        return c, n[first], h, back[of], order


def postings(docs: DataFrame, words: int, buckets: int, groups: int, long_ones, boundary: int) -> DataFrame:
    """bucket, data: the shingles of classes above the boundary by ranges of shingles; those of long lists, from bucket `buckets` on, by ranges of classes."""

    def run(batches):
        keys, places = long_ones.value
        likely = np.zeros(1 << 24, bool)
        likely[keys >> U(40)] = True
        for ids, sizes, sets in chunks(batches, words):
            of = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
            heavy = (sizes > boundary)[of]
            h, of = sets[heavy], of[heavy]
            hot = likely[h >> U(40)]
            at = np.searchsorted(keys, h[hot])
            at[at == len(keys)] = 0
            known = keys[at] == h[hot] if len(keys) else np.zeros(len(at), bool)
            hot[hot] = known
            rows = []
            order = np.argsort(h[~hot])
            x, k = h[~hot][order], of[~hot][order]
            for b, part in runs(bucket_of(x, buckets)):
                rows.append((b, Lists.pack(ids, sizes, x[part], k[part], np.zeros(part.stop - part.start))))
            x, k, place = h[hot], of[hot], places[at[known]] if len(keys) else at
            group = bucket_of(ids, groups)[k]
            order = np.lexsort((x, group))
            x, k, place, group = x[order], k[order], place[order], group[order]
            for b, part in runs(group):
                rows.append((buckets + b, Lists.pack(ids, sizes, x[part], k[part], LONG + place[part])))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 64]], pa.int64()), pa.array([r[1] for r in rows[i : i + 64]], pa.binary())], ["bucket", "data"])

    return docs.select("text").mapInArrow(leaner(run), "bucket long, data binary")


def shared_only(parts: DataFrame, buckets: int, groups: int) -> DataFrame:
    """group, data: the postings of lists of two classes or more, by ranges of classes; a list's place is its length."""

    def run(group: pa.Table) -> pa.Table:
        bucket, data = group["bucket"][0].as_py(), [x.as_py() for x in group["data"]]
        if bucket >= buckets:
            return pa.table({"group": pa.array([bucket - buckets] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})
        ids, sizes, h, of, _ = Lists.read(data)
        order = np.argsort(h)
        h, of = h[order], of[order]
        same = h[1:] == h[:-1]
        more = np.append(False, same) | np.append(same, False)
        h, of = h[more], of[more]
        order = np.lexsort((of, h))
        h, of = h[order], of[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[first], of[first]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        length = np.diff(np.append(at, len(h)))
        length = np.repeat(length, length)
        h, of, length = h[length > 1], of[length > 1], length[length > 1]
        to = bucket_of(ids, groups)[of]
        order = np.argsort(to, kind="stable")
        h, of, length, to = h[order], of[order], length[order], to[order]
        rows = [(b, Lists.pack(ids, sizes, h[p], of[p], np.minimum(length[p], LONG - 1))) for b, p in runs(to)]
        return pa.table({"group": pa.array([r[0] for r in rows], pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return parts.groupBy("bucket").applyInArrow(leaner(run), "group long, data binary")


def linkable(shared: DataFrame, percent: int) -> DataFrame:
    """class, n, s, held, prefix of classes with s >= percent n / 100 shingles in longer lists: held has these, prefix those of its places that may hold the first of a link."""

    def run(group: pa.Table) -> pa.Table:
        ids, sizes, h, of, order = Lists.read([x.as_py() for x in group["data"]])
        sort = np.lexsort((h, of))
        h, of, order = h[sort], of[sort], order[sort]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of, order = h[first], of[first], order[first]
        at = np.searchsorted(of, np.arange(len(ids) + 1))
        s = np.diff(at)
        rows = np.flatnonzero(100 * s >= percent * sizes)
        held, prefix = [], []
        for r in rows.tolist():
            own, place, n = h[at[r] : at[r + 1]], order[at[r] : at[r + 1]], int(sizes[r])
            held.append(squeeze(np.diff(own, prepend=U(0))))
            prefix.append(own[np.lexsort((own, place))][: prefix_length(n, percent) - (n - len(own))].view(np.int64))
        return pa.table({"class": ids[rows], "n": sizes[rows], "s": s[rows], "held": pa.array(held, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64()))})

    return shared.groupBy("group").applyInArrow(leaner(run), "class long, n long, s long, held binary, prefix array<long>")


def light_links(docs: DataFrame, words: int, boundary: int, percent: int) -> DataFrame:
    """a, b: links that join all classes which link by a subset that both list."""

    def run(batches):
        for ids, sizes, sets in chunks(batches, words):
            at = np.append(0, np.cumsum(sizes))
            found = []
            for k in np.flatnonzero(sizes <= 100 * boundary // percent).tolist():
                n = int(sizes[k])
                for m, size in subset_sizes(n, boundary, percent):
                    subsets = np.array(list(combinations(sets[at[k] : at[k + 1]].tolist(), size)), np.uint64)
                    h = np.full(len(subsets), min(n, m) << 32 | max(n, m), np.uint64)
                    for col in subsets.T:
                        h = mixed(h * U(0x9E3779B97F4A7C15) + col)
                    found.append((h, np.full(len(h), n <= m), np.full(len(h), ids[k])))
            if found:
                h, small, of = (np.concatenate(x) for x in zip(*found, strict=True))
                for i in range(0, len(h), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 65_536].view(np.int64)), pa.array(small[i : i + 65_536]), pa.array(of[i : i + 65_536])], ["subset", "small", "class"])

    listed = docs.select("text").mapInArrow(leaner(run), "subset long, small boolean, class long")
    # The smaller sets of a list link with one another and with all larger ones, so one of them stands for all.
    heads = listed.where("small").groupBy("subset").agg(F.min("class").alias("head"))
    return listed.join(heads, "subset").where("class <> head").select(F.least("class", "head").alias("a"), F.greatest("class", "head").alias("b")).distinct()


def enough(a: str, b: str, percent: int):
    """Whether two sets may link by their sizes and by how many shingles each has in longer lists."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(f"{a}.s", f"{b}.s") * (100 + percent) >= percent * (n_a + n_b)) & (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of classes that link, by the shingles that each has in longer lists: all that they can share."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("held").alias(f"held_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        last, kept = None, None
        for batch in batches:
            links = []
            for b, n_a, n_b, held_a, held_b in zip(*(batch[c].to_pylist() for c in ("b", "n_a", "n_b", "held_a", "held_b")), strict=True):
                if last != b:
                    last, kept = b, np.cumsum(unsqueeze(held_b, "<u8")[0], dtype=np.uint64)
                shared = len(np.intersect1d(np.cumsum(unsqueeze(held_a, "<u8")[0], dtype=np.uint64), kept, assume_unique=True))
                links.append(100 * shared >= percent * (n_a + n_b - shared))
            hit = batch.filter(pa.array(links, pa.bool_()))
            yield pa.RecordBatch.from_arrays([hit["a"], hit["b"]], ["a", "b"])

    return both.mapInArrow(leaner(run), "a long, b long")


def ordered_pair(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def class_components(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """node, component of every class with links; sets has doc_id, n_shingles, class of every row."""
    spark = docs.sparkSession
    named = docs.where("doc_id IS NOT NULL")
    distinct = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.max("n_shingles").alias("n"))
    sizes = distinct.groupBy(F.least("n", F.lit(100 * LARGEST_LIGHT // percent + 1)).alias("n")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t")).collect()
    total = sum(r["t"] for r in sizes)
    buckets = max(1, -(-total // BUCKET))
    groups = -(-buckets // 4)
    sampled = cut(long_lists(named, words, total))
    rest = sampled.where("h IS NULL").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).first()
    share = min(1.0, SAMPLE / max(total, 1))
    boundary = choose_boundary({r["n"]: r["c"] for r in sizes}, as_int(rest, "pairs") / share / max(as_int(rest, "n"), 1), percent)
    lists = sampled.where("h IS NOT NULL").select("h", "n").toPandas().sort_values(["n", "h"])  # at most SAMPLE / OFTEN
    keys = lists["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    long_ones = spark.sparkContext.broadcast((keys[order], order.astype(np.int64)))

    shared = shared_only(postings(named, words, buckets, groups, long_ones, boundary), buckets, groups)
    held = saved(linkable(shared, percent), "shared-shingles")
    rows = cut(held.select("class", "n", "s", F.size("prefix").alias("lists"), F.posexplode("prefix").alias("rank", "h")))
    sure = light_links(named, words, boundary, percent) if boundary else spark.createDataFrame([], "a long, b long")

    # Every class against the two heads that it meets in most lists: those with least shingles of their own, then of smallest number.
    head = F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "class", "n", "s")).alias("y")
    met = rows.join(rows.groupBy("h").agg(head), "h").alias("u").where(F.col("u.class") != F.col("u.y.class")).select("class", "n", "s", "y")
    met = met.groupBy("class", "n", "s", "y").agg(F.count(F.lit(1)).alias("times")).select(F.struct("class", "n", "s").alias("u"), "y", "times").where(enough("u", "y", percent))
    best = F.row_number().over(W.partitionBy("u.class").orderBy(F.desc("times"), "y.class"))
    first = met.withColumn("place", best).where("place <= 2").select(*ordered_pair("u.class", "y.class")).distinct()
    tested = cut(first)
    links = cut(verified(tested, held, percent).union(sure).distinct())
    let_go(spark)

    def apart(found: DataFrame) -> DataFrame:
        """Rows of the lists with members of more than one component."""
        placed = rows.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        mixed_ = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
        return cut(placed.join(mixed_, "h"))

    def crossing(u: DataFrame, y: DataFrame) -> DataFrame:
        """Pairs in different components whose first shared list this may be: of the lists that a linked pair shares, the first comes early in both."""
        rest_ = F.greatest(*(F.ceil(F.col(f"{x}.n") * percent / 100) - 1 for x in "uy"))
        common = F.greatest(F.lit(1), F.ceil(percent * (F.col("u.n") + F.col("y.n")) / (100 + percent)) - rest_)
        early = (F.col("u.rank") + common <= F.col("u.lists")) & (F.col("y.rank") + common <= F.col("y.lists"))
        found = u.alias("u").join(y.alias("y"), (F.col("u.h") == F.col("y.h")) & (F.col("u.component") != F.col("y.component")) & early & enough("u", "y", percent))
        return found.select(*ordered_pair("u.class", "y.class")).distinct().join(tested, ["a", "b"], "left_anti")

    found, left = cut(connected_components(links)), None
    for central in (CENTRAL, None):
        left = left or apart(found)
        if left.isEmpty():
            break
        inner = left
        if central:
            place = F.row_number().over(W.partitionBy("h").orderBy(F.col("n") - F.col("s"), "class"))
            inner = left.withColumn("place", place).where(F.col("place") <= central)
        pairs = cut(crossing(left, inner))
        tested = tested.union(pairs)
        more = cut(verified(pairs, held, percent))
        let_go(spark)
        if not more.isEmpty():
            links = links.union(more)
            found, left = cut(connected_components(links)), None
    return found


def with_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, class, component_id of every row."""
    sets = saved(classes(docs, words), "shingle-classes")
    found = class_components(docs, sets, words, percent)
    reps = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"))
    reps = reps.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = reps.groupBy("component").agg(F.min("rep").alias("least"))
    node = reps.join(least, "component").select("class", "least")
    placed = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").join(node, "class").select("doc_id", "n_shingles", "class", F.col("least").alias("component_id"))
    alone = sets.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", "class", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    component_id is the smallest doc_id reachable by links. Texts that are null or have no word have no
    shingles and stay alone. Rows whose doc_id is null keep their row, link with nothing and have a null
    component. Rows that repeat a doc_id are texts of their own. Empty tables give no rows; other columns,
    whatever their names, are ignored.
    """
    return with_components(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, with all their columns, whatever their names: of each component only a row of its smallest doc_id.

    Rows without words or without doc_id all stay. Where several rows of a component have its smallest
    doc_id, the one with the smallest class number stays, of these the longest text, and of these the row
    whose JSON has the smallest hash; equal rows are one. Empty tables give no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    wordless = F.coalesce(~F.col("text").rlike(WORD), F.lit(True)) | F.col("doc_id").isNull()
    rows = docs.where(~wordless).select("doc_id", F.struct(*columns).alias("row"))
    text = next(c for c in docs.columns if c.lower() == "text")
    kept = with_components(docs, words, percent).where("n_shingles > 0 AND doc_id = component_id")
    kept = kept.groupBy("doc_id").agg(F.min("class").alias("kept_class")).withColumnRenamed("doc_id", "kept_id")

    def run(batches):
        forget_caches()
        for batch in batches:
            done = 0
            for part in slices(batch["row"].field(text), TEXT):
                own = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["row"], pa.array(class_numbers(*shingle_sets(part, words)))], ["doc_id", "row", "class"])

    schema = rows.select("*").schema.add("class", "long")
    named = rows.mapInArrow(leaner(run), schema).join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("class") == F.col("kept_class")), "left_semi")
    order = F.struct(-F.length("row.text"), F.sha2(F.to_json("row"), 256))
    one = named.groupBy("doc_id", "class").agg(F.min_by("row", order).alias("row")).select("row.*")
    return one.unionByName(docs.where(wordless))


def op3_jaccard_join(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM words, LATERAL unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
