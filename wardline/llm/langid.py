"""Language ID by words first, then by ever shorter character n-grams.

A word of the vocabulary is scored by its log frequency in each language. Any other word is scored by
the n-grams of the longest length of which one at least is known, from longest to shortest.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, documents, hash52, leaner, worker_cache
from wardline.llm.wordhash import Known, bytes_of, hash_words, slices

#: Bound on the labelled rows that the model is fitted on, and so on what the driver gathers and sends out.
FIT_DOCUMENTS = 20_000
TEXT = 2 << 20  # bytes scored at a time
ORDERS = (4, 3, 2, 1)
LETTERS = re.compile(r"[^\W\d_]+")
JVM_LETTERS = r"[\p{L}\p{Nl}\p{No}]+"  # the same signs
#: Below this confidence a text counts as rejected in a pipeline.
LEAST_SCORE = 0.35
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def fit_language_model(docs: DataFrame, sample: int = FIT_DOCUMENTS, vocabulary: int | None = None, ngrams: int | None = None) -> dict:
    """Word and n-gram log frequencies by language from about `sample` labelled rows (all, if there are fewer).

    Rows are drawn by a hash of doc_id and text, so reruns and any partitioning draw the same, and rows that
    share an id are drawn apart. All their words and n-grams are kept, or the most frequent ones under a
    bound. Words are counted first, and n-grams taken from the different words alone. Texts or languages
    that are null don't count; from an empty table nothing is learned, and every text is und.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.count()
    if n > sample:
        labelled = labelled.where(hash52(F.lit("fit"), F.col("doc_id"), F.md5("text")) < int((1 << 52) * sample / n))

    def inner(batches):
        tally: Counter = Counter()
        for batch in batches:
            for lang, word, k in zip(*(batch[c].to_pylist() for c in ("lang", "item", "n")), strict=True):
                for order in ORDERS:
                    for g in grams(word, order):
                        tally[lang, g] += k
        rows = [(lang, g, k) for (lang, g), k in tally.items()]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 50_000], strict=True)], ["lang", "item", "n"])

    counted = "lang string, item string, n long"
    summed = lambda df: df.groupBy("lang", "item").agg(F.sum("n").alias("n"))
    tokens = labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(JVM_LETTERS), F.lit(0))).alias("item"), F.lit(1).cast("long").alias("n"))
    different = cut(summed(tokens))
    parts = summed(different.mapInArrow(leaner(inner), counted))
    counts = cut(different.select(F.lit(0).alias("kind"), "*").unionByName(parts.select(F.lit(1).alias("kind"), "*")))
    found = counts.toArrow()  # of the sample's words and n-grams, as columns
    langs = sorted(set(found["lang"].unique().to_pylist()))
    lang_of = pc.index_in(found["lang"], pa.array(langs, pa.string())).to_numpy()
    totals, index, rows = {}, ({}, {}), [np.zeros((0, len(langs)))]
    for kind, most in ((0, vocabulary), (1, ngrams)):
        own = pc.equal(found["kind"], kind).to_numpy()
        items, n_of = found["item"].filter(pa.array(own)), found["n"].to_numpy()[own]
        coded = items.combine_chunks().dictionary_encode() if len(items) else pa.array([], pa.string()).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        names = coded.dictionary.to_pylist()
        n = np.zeros((len(names), len(langs)))
        np.add.at(n, (coded.indices.to_numpy(), lang_of[own]), n_of)
        totals |= {(kind, x): t for x, t in zip(langs, n.sum(axis=0).tolist(), strict=True)}
        order = sorted(range(len(names)), key=lambda i: (-n[i].sum(), names[i])) if most is not None else range(len(names))
        top = np.array(list(order)[:most], int)
        done = sum(map(len, rows))
        index[kind].update((names[i], done + at) for at, i in enumerate(top.tolist()))
        rows.append(np.log((n[top] + 0.5) / (n.sum(axis=0) + 0.5 * (len(top) + 1))))
    usual = max(range(len(langs)), key=lambda i: totals.get((0, langs[i]), 0), default=-1)
    return {"fit": uuid.uuid4().hex, "langs": langs, "usual": usual, "words": index[0], "grams": index[1], "scores": np.concatenate(rows)}


def word_scores(word: str, model: dict) -> np.ndarray | None:
    """Log frequency by language; None if neither the word nor any of its n-grams is known."""
    if (found := model["words"].get(word)) is not None:
        return model["scores"][found]
    for order in ORDERS:
        if known := [i for g in grams(word, order) if (i := model["grams"].get(g)) is not None]:
            return model["scores"][known].mean(axis=0)
    return None


class Scores:
    """Summed scores of whole texts; a token is worked out once in a Python worker, and found again by its hash."""

    def __init__(self, model: dict, most: int = 700_000):
        self.model, self.most = model, most
        self.width = len(model["langs"]) + 2  # scores by language, words with a score, words
        self.forget()

    def forget(self) -> None:
        self.rows, self.used, self.known = np.zeros((4096, self.width)), 1, Known(1 << 20)

    def learn(self, tokens: list[bytes]) -> np.ndarray:
        while self.used + len(tokens) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for i, token in enumerate(tokens, self.used):
            for w in LETTERS.findall(token.decode("utf-8", "surrogatepass")):
                self.rows[i, -1] += 1
                if (s := word_scores(w, self.model)) is not None:
                    self.rows[i, :-2] += s
                    self.rows[i, -2] += 1
        self.used += len(tokens)
        return np.arange(self.used - len(tokens), self.used)

    def totals(self, texts: pa.Array) -> np.ndarray:
        """One row for each text: the sums of its tokens' rows."""
        if self.used > self.most:
            self.forget()
        raw, at = bytes_of(pc.utf8_lower(texts))
        h, ends, begins = hash_words(raw, at)
        row = self.known.find(h)
        missing = np.flatnonzero(row == 0)
        if len(missing):
            different, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            where = missing[one]
            stops = np.append(begins[1:], len(raw))[where]
            stops = np.minimum(stops, at[np.searchsorted(at, begins[where], "right")])
            number = self.learn([raw[a:b].tobytes() for a, b in zip(begins[where].tolist(), stops.tolist(), strict=True)])
            self.known.add(different, number)
            row[missing] = number[back]
        out = np.zeros((len(texts), self.width))
        full = np.flatnonzero(ends[:-1] < ends[1:])
        if len(full):
            out[full] = np.add.reduceat(self.rows[row], ends[:-1][full], axis=0)
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the number of its best language and that one's share of belief; -1 and 0 without letters, or where nothing was learned; the language of most words and 0 where no word and none of its n-grams is known."""
        total = np.concatenate([np.zeros((0, self.width)), *(self.totals(part) for part in slices(column, TEXT))])
        langs = len(self.model["langs"])
        if not langs:
            return np.full(len(total), -1), np.zeros(len(total))
        known = total[:, -2]
        mean = total[:, :langs] / np.maximum(known, 1)[:, None] * np.minimum(known, 10.0)[:, None]  # belief grows with up to ten words
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        best = share.argmax(axis=1)
        score = share[np.arange(len(best)), best] / share.sum(axis=1)
        best, score = np.where(known > 0, best, self.model["usual"]), np.where(known > 0, score, 0.0)
        letters = total[:, -1] > 0
        return np.where(letters, best, -1), np.where(letters, score, 0.0)


def identify_language(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from the whole text alone.

    und with score 0 for null, empty or letterless texts; a text of which nothing is known gets the
    language of most learned words with score 0. Ties go to the first language in order of name. Repeated
    rows are answered each; empty tables give no rows; other columns, whatever their names, are ignored.
    """
    sent, fit = docs.sparkSession.sparkContext.broadcast(model), model["fit"]

    def run(batches):
        scores = worker_cache(("scores", fit), lambda: Scores(sent.value))
        names = np.array([*sent.value["langs"], UNKNOWN], object)
        for batch in batches:
            best, score = scores.predict(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(leaner(run), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def keep_known_language(docs: DataFrame, model: dict, least: float = LEAST_SCORE) -> DataFrame:
    """docs, with all their columns, whatever their names, without texts that have no language or none with confidence.

    Null, empty and letterless texts go, and texts of which nothing is known. Repeated rows are judged
    each; empty tables give no rows.
    """
    sent, fit = docs.sparkSession.sparkContext.broadcast(model), model["fit"]

    def run(batches):
        scores = worker_cache(("scores", fit), lambda: Scores(sent.value))
        for batch in batches:
            best, score = scores.predict(batch["text"])
            yield batch.filter(pa.array((best >= 0) & (score >= least)))

    return docs.mapInArrow(leaner(run), docs.schema)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op7_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit_language_model(docs.where(~held_out()))
    return identify_language(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
