"""Sharding, mixing, tokens, packing, language ID and joins: edge cases and brute force."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from wardline.llm import ann, components, jaccard, langid, mixing, neardup, packing, sharding, tokenids, wordhash
from wardline.llm.common import saved
from wardline.llm.tokens import Container, Encoder, write_container

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, h double"
WORDS = ["the", "and", "der", "und", "les", "que", "house", "maison", "haus", "été", "Straße"]


def docs_of(spark, texts, sources=("a",)):
    rows = [(i, t, "en" if i % 2 else "de", sources[i % len(sources)], len(t or ""), 1, "s", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, 1, "x", 0.1)] * 2 + [(None,) * 8, (2, None, None, None, None, None, None, None), (3, "", "de", "b", 0, 0, "", 0.0), (4, "x " * 30_000, "de", "b", 1, 1, "y", 1.0), (None, "one two", "en", None, 1, 1, "z", 2.0), (5, "\t\n\x0b", "en", "a", 3, 1, "w", 0.0), (6, "<|endoftext|> tail", "fr", "c", 1, 1, "", 0.0)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_shards_are_even_gapless_and_hot_texts_split(spark):
    rng = random.Random(1)
    texts = ["same words in every copy " * 4] * 300 + ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 400))) for _ in range(600)]
    got = sharding.shard_by_bytes(docs_of(spark, texts), range_bytes=2_000).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(got) == 900 and len(total) == 8 and total.max() - total.min() <= 2 * got["size"].max()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert dict(zip(got.doc_id, got.text_crc32, strict=True)) == {i: zlib.crc32(t.encode()) for i, t in enumerate(texts)}
    again = sharding.shard_by_bytes(docs_of(spark, texts).repartition(5), range_bytes=2_000).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_shards_are_those_of_one_sorted_list(spark):
    rng = random.Random(9)
    texts = [f"text {rng.randint(0, 60)} " * rng.randint(1, 30) for _ in range(400)] + ["hot"] * 300 + [None, ""]
    docs = docs_of(spark, texts)
    got = sharding.shard_by_bytes(docs, range_bytes=500).toPandas().set_index("doc_id")
    keys = docs.select("doc_id", sharding.hash52(F.coalesce("text", F.lit(""))).alias("k"), sharding.hash52(F.col("doc_id")).alias("c")).toPandas()
    rows = sorted((r.k, r.c, r.doc_id, len((texts[r.doc_id] or "").encode()) + 1) for r in keys.itertuples())
    total, place, seen = sum(r[3] for r in rows), 0, {}
    for _, _, doc, size in rows:
        shard = min(7, place * 8 // total)
        assert (got["shard"][doc], got["slot"][doc], got["size"][doc]) == (shard, seen.get(shard, 0), size)
        seen[shard] = seen.get(shard, 0) + 1
        place += size


def test_sharding_edges(spark):
    got = sharding.shard_by_bytes(odd_docs(spark)).toPandas()
    assert len(got) == 9 and got[got.doc_id == 2]["size"].tolist() == [1] and got[got.doc_id == 3].text_crc32.tolist() == [0]
    assert sharding.shard_by_bytes(empty_docs(spark)).count() == 0


def test_rows_repeated_without_end_are_parted(spark):
    rows = [(1, "a b c d", "en", "s")] * 400 + [(i, "x " * (i % 9), "en", "s") for i in range(50)] + [(None, None, None, None)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    got = mixing.mix_sources(docs, rows_per_range=20).toPandas()
    assert len(got) == 510 and (got.taken <= 2 * got["size"]).all()
    for _, part in got.groupby("source", dropna=False):
        assert part.taken.sum() == int(part.target.iloc[0])


def test_mix_meets_targets(spark):
    texts = ["w " * (1 + i % 37) for i in range(900)]
    docs = docs_of(spark, texts, ("a", "a", "a", "a", "b", "c"))
    got = mixing.mix_sources(docs, rows_per_range=50).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and got.target.groupby(got.source).first().sum() == pytest.approx(1.5 * got["size"].sum())
    for _, part in got.groupby("source"):
        assert part.taken.sum() == int(part.target.iloc[0]) <= 2 * part["size"].sum()
    mixed = mixing.take_words(docs, rows_per_range=50)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit("w")))).first()[0] == got.taken.sum()
    assert mixed.where("n_chars <> length(text)").count() == 0


def test_mixing_edges(spark):
    assert mixing.mix_sources(odd_docs(spark)).count() == 9
    assert mixing.mix_sources(empty_docs(spark)).count() == 0
    assert mixing.mix_sources(docs_of(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.take_words(odd_docs(spark)).columns == odd_docs(spark).columns


def test_encoder_equals_the_library():
    enc, rng = Encoder(most=500), random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "1", ",", ".", "'s", "word", " word", "<|endoftext|>", "\x85", "\0", "   ", "漢", "　", "\xa0", "\r\n", "!", "²", "|"]
    for _ in range(300):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(20)]
        want = [np.array([*x.ids, 2], "<u2").tobytes() for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert enc.encode(texts, 2) == want


@pytest.mark.parametrize("sizes", [[1], [5, 1, 1, 900, 3], [1] * 1000, [70_000, 2]])
def test_container_round_trip(sizes):
    rng = np.random.default_rng(0)
    ids, ends = rng.integers(0, 50_000, sum(sizes)).astype("<u2"), np.cumsum([0, *sizes])
    box = Container(write_container(ids, ends))
    assert [box.start(i) for i in range(len(sizes) + 1)] == box.starts().tolist() == ends.tolist()
    assert np.concatenate([box.document(i) for i in range(len(sizes))]).tolist() == ids.tolist()
    small = write_container(np.zeros(1000, "<u2"), np.arange(1001))
    assert len(small) - 2000 < 600  # far below eight bytes a document


def test_token_files_round_trip(spark):
    docs = odd_docs(spark)
    got = tokenids.read_documents(tokenids.encode_documents(docs, most_ids=50)).toPandas()
    enc = Encoder()
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], set()).add(zlib.crc32(np.array([*enc.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()))
    for r in got.itertuples():
        assert r.ids_crc32 in want[None if np.isnan(r.doc_id) else int(r.doc_id)]
    placed = got.sort_values("start")
    assert len(got) == 9 and (placed.start.diff().dropna().to_numpy() == placed.n_tokens.to_numpy()[:-1]).all() and placed.doc_id.dropna().is_monotonic_increasing
    assert tokenids.read_documents(tokenids.encode_documents(empty_docs(spark))).count() == 0


def check_packed(got, n_docs, window=2048):
    in_order = got.sort_values(["sequence_id", "offset"])
    assert ((in_order.groupby("sequence_id").length.cumsum() - in_order.length) == in_order.offset).all()
    sums = got.groupby("sequence_id").length.sum()
    assert (sums <= window).all() and all(n & (n - 1) == 0 for n in sums)
    assert got.groupby("doc_id", dropna=False).length.sum().sum() == got[got.start == 0].doc_tokens.sum() and (got.start == 0).sum() == n_docs


def test_packing(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 900))) for _ in range(120)]
    got = packing.pack_documents(docs_of(spark, texts), range_docs=25, with_ids=True).toPandas()
    check_packed(got, 120)
    enc = Encoder()
    for doc, part in got.groupby("doc_id"):
        ids = np.array([*enc.tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        for r in part.itertuples():
            assert ids[r.start : r.start + r.length].tobytes() == r.ids and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(ids)
    check_packed(packing.pack_documents(odd_docs(spark)).toPandas(), 9)
    assert packing.pack_documents(empty_docs(spark)).count() == 0


def test_packing_retrieves_over_all_documents(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(4_000)]
    texts = []
    for _ in range(60):
        lines = [" ".join(rng.choices(words, k=8)) for _ in range(25)]
        texts += [" ".join(rng.sample(lines, 22)) for _ in range(2)]
    docs = docs_of(spark, texts).repartition(8)  # texts 2n and 2n + 1 are of one topic and lie anywhere
    got = packing.pack_documents(docs, window=1024, range_docs=30, most_ids=2_000).toPandas()
    check_packed(got, 120, 1024)
    at = got.groupby("doc_id").sequence_id.agg(set)
    touching = sum(any(abs(x - y) <= 1 for x in at[2 * i] for y in at[2 * i + 1]) for i in range(60))
    assert touching >= 54


def test_scores_are_bm25_over_the_whole_corpus(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(90)]
    docs, n_bytes = docs_of(spark, texts).repartition(6), sum(len(t.encode()) for t in texts)
    held = saved(packing.indexed_containers(docs, 1, 300, None, 3, n_bytes / 90, 2, 1.0), "test-index")
    names = {packing.named(r["part"], r["seq"]) + i: d for r in held.where("kind = 0").collect() for i, d in enumerate(r["doc_ids"])}
    got = packing.nearest(packing.scored_pairs(held.where("kind = 1"), 90, 90, 90), 6).toPandas().sort_values(["id", "place"])
    assert held.where("kind = 0").count() == 6 and held.where("kind = 1").select("bucket").distinct().count() == 3
    tf = []
    for t in texts:
        w, own = t.lower().split(), {}
        for g in zip(w, w[1:]) if len(w) > 1 else [tuple(w)] if w else []:
            own[g] = own.get(g, 0) + 1
        tf.append(own)
    df = {}
    for own in tf:
        for g in own:
            df[g] = df.get(g, 0) + 1
    idf = {g: np.log1p((90 - n + 0.5) / (n + 0.5)) for g, n in df.items()}
    weight = [{g: idf[g] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(texts[i].encode()) / (n_bytes / 90))) for g, n in own.items()} for i, own in enumerate(tf)]
    found = got.groupby("id").score.agg(list)
    for name, d in names.items():
        want = sorted((s for j in range(90) if j != d and (s := sum(w for g, w in weight[j].items() if g in tf[d]))), reverse=True)[:6]
        assert np.allclose(found.get(name, []), want, rtol=1e-3)


def test_any_shared_term_finds_a_partner(spark):
    """Two texts that share a single run of four words are scored against each other, whichever run it is."""
    texts = [f"{' '.join(f'a{i}x{k}' for k in range(9))} one{i} two{i} three{i} four{i} {' '.join(f'{s}{i}y{k}' for k in range(9))}" for i in range(60) for s in "bc"]
    texts = [t if i % 2 else t.replace("a", "z", 9) for i, t in enumerate(texts)]
    held = saved(packing.indexed_containers(docs_of(spark, texts), 1, 300, None, 3, 120.0, packing.TERM_WORDS, packing.SHARE), "test-index")
    names = {packing.named(r["part"], r["seq"]) + i: d for r in held.where("kind = 0").collect() for i, d in enumerate(r["doc_ids"])}
    got = packing.nearest(packing.scored_pairs(held.where("kind = 1"), len(texts))).collect()
    assert {(names[r["id"]], names[r["near"]]) for r in got} == {(i, i ^ 1) for i in range(len(texts))}


def test_no_table_holds_the_index(spark, monkeypatch):
    """Postings go from their documents straight to their shards, named as the containers of the other pass name them."""
    kept = []
    monkeypatch.setattr(packing, "saved", lambda df, name: kept.append(saved(df, name)) or kept[-1])
    docs = docs_of(spark, [f"these four words stand in each text {i}" for i in range(40)]).repartition(3)
    check_packed(packing.pack_documents(docs, most_ids=100).toPandas(), 40)
    boxes = [df for df in kept if "kind" in df.columns]
    assert len(boxes) == 1 and boxes[0].where("kind = 1").count() == 0
    posts = packing.indexed_containers(docs, 1, 100, None, 1, 40.0, 4, 1.0, kinds=(1,))
    assert {(r["part"], r["seq"]) for r in posts.collect()} == {(r["part"], r["seq"]) for r in boxes[0].collect()}


@pytest.mark.parametrize("cheap", [16, 40, packing.CHEAP])
def test_nearest_are_exact_over_lists_of_any_length(spark, cheap):
    """A line in most texts, passages in many, copies and near copies: the best six of every text, as brute force over all lists has them."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3_000)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    line, passages, base = some(12), [some(rng.randint(5, 20)) for _ in range(6)], some(60).split()
    texts = [" ".join([some(rng.randint(0, 30)), *rng.sample(passages, rng.randint(0, 3)), *[line] * (rng.random() < 0.7) * rng.choice([1, 1, 2]), some(rng.randint(0, 30))]) for _ in range(200)]
    for _ in range(60):
        near = list(base)
        near[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(near) + f" {line}" * (rng.random() < 0.5))
    texts += [f"{some(40)} {line}"] * 25 + [line] * 20 + [some(9)] * 7 + [some(30) for _ in range(10)]
    rng.shuffle(texts)
    n, n_bytes = len(texts), sum(len(t) for t in texts)
    held = saved(packing.indexed_containers(docs_of(spark, texts).repartition(5), 1, 2_000, None, 4, n_bytes / n, 4, 1.0), "test-index")
    names = {packing.named(r["part"], r["seq"]) + i: d for r in held.where("kind = 0").collect() for i, d in enumerate(r["doc_ids"])}
    pairs = saved(packing.scored_pairs(held.where("kind = 1"), n, shares=3, cheap=cheap), "test-pairs")
    got = packing.nearest(pairs, shares=3, clusters=4, cheap=cheap).toPandas().sort_values(["id", "place"])
    grams = [collections.Counter(tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))) for w in (t.split() for t in texts)]
    df = collections.Counter(g for own in grams for g in own)
    assert max(df.values()) > 150
    weight = [{g: np.log1p((n - df[g] + 0.5) / (df[g] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(t) * n / n_bytes)) for g, k in own.items()} for own, t in zip(grams, texts, strict=True)]
    score = lambda a, b: sum(weight[b].get(g, 0) for g in grams[a])
    found = {names[name]: own for name, own in got.groupby("id")}
    for d in range(n):
        want = sorted((s for j in range(n) if j != d and (s := score(d, j)) > 0), reverse=True)[:6]
        own = found[d] if d in found else got.iloc[:0]
        assert np.allclose(own.score, want, rtol=1e-4) and np.allclose([score(d, names[x]) for x in own.near], want, rtol=1e-4)


def test_long_lists_leave_no_document_out(spark):
    texts = [f"one line that all of them have {i} {i * 7} {i * 11}" for i in range(100)]
    held = saved(packing.indexed_containers(docs_of(spark, texts), 1, 300, None, 1, 30.0, 2, 1.0), "test-index")
    got = packing.nearest(packing.scored_pairs(held.where("kind = 1"), 100, 8, 8)).toPandas()
    assert got.id.nunique() == 100 and got.groupby("id").near.nunique().min() >= 3


def test_language_by_words_then_grams(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_language_model(docs.where(~langid.held_out()))
    got = langid.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    bare = langid.identify_language(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"), model).toPandas().set_index("doc_id")
    assert (bare.lang_pred.loc[got.doc_id + 1000].to_numpy() == got.lang_pred.to_numpy()).all()
    odd = {r["doc_id"]: r for r in langid.identify_language(odd_docs(spark).where("doc_id IS NOT NULL"), model).collect()}
    assert odd[2]["lang_pred"] == odd[3]["lang_pred"] == odd[5]["lang_pred"] == "und" and odd[2]["score"] == 0
    assert langid.keep_known_language(odd_docs(spark), model).columns == odd_docs(spark).columns
    nothing = langid.fit_language_model(empty_docs(spark))
    assert {r["lang_pred"] for r in langid.identify_language(docs, nothing).collect()} == {"und"}


def plain_prediction(text, model):
    """The rule word by word."""
    words = langid.LETTERS.findall(pc.utf8_lower(text or "").as_py())
    if not words:
        return "und", 0.0
    found = [x for w in words if (x := langid.word_scores(w, model)) is not None]
    if not found:
        return model["langs"][model["usual"]], 0.0
    mean = sum(found) / len(found) * min(len(found), 10)
    share = np.exp(mean - mean.max())
    return model["langs"][int(share.argmax())], float(share.max() / share.sum())


def test_language_of_every_text_is_that_of_the_plain_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_language_model(docs, vocabulary=500, ngrams=None)
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["漢字 漢字", "ÉTÉ  été\x0bÜber", "12 34", "x", None, "", "İstanbul ſecret"])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in langid.identify_language(both, model).collect():
        lang, score = plain_prediction(texts[r["doc_id"]], model)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-9), texts[r["doc_id"]]
    kept = {r["doc_id"] for r in langid.keep_known_language(both, model).collect()}
    assert kept == {d for d, t in texts.items() if plain_prediction(t, model)[1] >= langid.LEAST_SCORE}


def test_backoff_prefers_longer_grams():
    scores = np.log(np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]]))
    model = {"words": {"haus": 0}, "grams": {"^mai": 1, "a": 2}, "scores": scores}
    assert (langid.word_scores("haus", model) == scores[0]).all() and (langid.word_scores("mai", model) == scores[1]).all()
    assert (langid.word_scores("a", model) == scores[2]).all() and langid.word_scores("zzz", model) is None


def brute_components(n, linked):
    root = list(range(n))
    for _ in range(n):
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return root


def brute_jaccard(texts, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], brute_components(len(sets), pairs)


def near_copies(seed, families, copies, low, high, edits):
    rng, out = random.Random(seed), []
    for _ in range(families):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(low, high))]
        for _ in range(rng.randint(1, copies)):
            own = list(words)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = [f"e{rng.randint(0, 10**6)}"]
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("often", [3, 12])
@pytest.mark.parametrize("case", ["small", "medium", "family", "passages"])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, case, often):
    texts = {
        "small": lambda: near_copies(1, 60, 6, 1, 14, 2), "medium": lambda: near_copies(2, 25, 8, 40, 90, 3), "family": lambda: near_copies(3, 2, 90, 60, 80, 4) + near_copies(7, 1, 70, 30, 30, 2),
        "passages": lambda: [" ".join(["shared passage of many plain words that all of them repeat again"] * 1 + [f"x{i}_{k}" for k in range(i % 9)]) for i in range(80)],
    }[case]()
    for name, value in {"OFTEN": often, "CENTRAL": 1, "BUCKET": 900, "CHUNK": 400}.items():
        monkeypatch.setattr(jaccard, name, value)
    want_n, want = brute_jaccard(texts)
    got = jaccard.near_duplicates(docs_of(spark, texts).repartition(3)).orderBy("doc_id").toPandas()
    assert got.n_shingles.tolist() == want_n and got.component_id.tolist() == want


def test_jaccard_edges(spark):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(odd_docs(spark)).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("5", 0, "5"), ("6", 1, "6"), ("None", 0, "None"), ("None", 1, "None")]
    assert jaccard.near_duplicates(empty_docs(spark)).count() == 0
    kept = jaccard.keep_one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == 8
    assert jaccard.keep_one_of_each(empty_docs(spark)).count() == 0


def test_one_of_each_is_told_by_text_whatever_the_columns(spark):
    a, b, other = "one two three four five six seven eight nine ten", "one two three four five  six seven eight nine ten", "quite another text of some words"
    rows = [(7, a, "p"), (7, b, "q"), (7, other, "r"), (8, a, "s"), (9, other, "t"), (7, b, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string").select("*", *(F.lit(1).alias(c) for c in ("class", "row", "component", "kept_class", "n", "s", "a", "b")))
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    # Two components have 7 as their smallest doc_id; of both, the one with the smaller class number stays.
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert got in ([(7, b)], [(7, other)])
    want = sorted((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert want == [(7, 7)] * 4 + [(8, 7), (9, 7)]


def test_word_hashes_cut_where_words_end():
    column = pa.array([None, "", " ", "Ab c", "\tx\u00a0y\r\nÉ", "q" * 400_000 + " ab", "C"])
    h, at = wordhash.word_hashes(column)
    words = [(t or "").encode().lower().split() for t in column.to_pylist()]
    flat = [w for x in words for w in x]
    assert np.diff(at).tolist() == [len(x) for x in words]
    assert len({(w, int(x)) for w, x in zip(flat, h, strict=True)}) == len(set(flat)) == len(set(h.tolist()))
    assert wordhash.word_hashes(column.slice(3, 2))[0].tolist() == h[:4].tolist()
    assert [len(x) for x in wordhash.slices(column, 10)] == [4, 1, 1, 1] or sum(len(x) for x in wordhash.slices(column, 10)) == 7


def test_boundary_follows_cost():
    assert jaccard.choose_boundary({3: 100}, 1_000, 75) >= 3 and jaccard.choose_boundary({12: 100}, 0, 75) == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(141, [(a, b) for a, b in edges])
    assert got == {n: want[n] for e in edges for n in e if e[0] != e[1]}


VECTORS = "vec_id long, embedding array<float>, label int, dim int, id string"


def vectors_of(spark, x, labels):
    return spark.createDataFrame([(i, [float(v) for v in r], int(y), 1, "a") for i, (r, y) in enumerate(zip(x, labels, strict=True))], VECTORS)


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [(100, None, 1, 0, ""), (101, [0.0] * 8, 1, 0, ""), (102, [nan] + [1.0] * 7, 1, 0, ""), (103, [inf] + [1.0] * 7, 1, 0, ""), (104, [None] + [1.0] * 7, 1, 0, ""), (105, [], 1, 0, ""), (106, [1.0] * 8, None, 0, ""), (107, [1.0] * 5, 1, 0, ""), (None, [1.0] * 8, 1, None, None)]


def test_vector_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 16)).astype(np.float32)
    got = ann.nearest(vectors_of(spark, x, [0] * 500), vectors_of(spark, x, [0] * 500).where("vec_id % 20 = 0"), block=128, query_block=16).toPandas()  # 4 blocks, 2 query blocks
    again = ann.nearest(vectors_of(spark, x, [0] * 500), vectors_of(spark, x, [0] * 500).where("vec_id % 20 = 0"), block=64, query_block=1).toPandas()
    assert again.sort_values(["query_id", "rank"]).reset_index(drop=True).equals(got.sort_values(["query_id", "rank"]).reset_index(drop=True))
    truth = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(truth, -np.inf)
    hits = sum(len(set(np.argsort(-truth[q])[:20]) & set(part.vec_id)) for q, part in got.groupby("query_id"))
    assert hits / (25 * 20) >= 0.99 and (got.groupby("query_id").size() == 20).all()
    assert np.allclose(got.score, truth[got.query_id, got.vec_id])


def test_vector_edges(spark):
    df = spark.createDataFrame([(i, [float(i + 1)] * 8, 1, 0, "") for i in range(3)] + [(0, [1.0] * 8, 1, 0, "")] + odd_vectors(), VECTORS)
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0][:3] and {r["vec_id"] for r in got} == {1, 2, 106}
    none = spark.createDataFrame([], VECTORS)
    assert ann.nearest(none, none).count() == 0 and neardup.near_duplicate_vectors(none).count() == 0


@pytest.mark.parametrize("shard", [4096, 60])
def test_embedding_duplicates_equal_brute_force(spark, shard):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 24))
    x = np.concatenate([base, base[:30] + rng.standard_normal((30, 24)) * 0.08, base[:20], np.repeat(base[:1], 80, 0) + rng.standard_normal((80, 24)) * 0.05]).astype(np.float32)
    labels = np.concatenate([np.arange(60) % 3, np.arange(30) % 3, np.arange(20) % 3, np.zeros(80)]).astype(int)
    v = x.astype(float)
    cos = (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    link = (cos >= 0.98) & (labels[:, None] == labels) & ~np.eye(len(x), dtype=bool)
    got = neardup.near_duplicate_vectors(vectors_of(spark, x, labels), shard=shard).orderBy("vec_id").toPandas()
    assert got.n_links.tolist() == link.sum(1).tolist()
    assert got.component_id.tolist() == brute_components(len(x), list(zip(*np.nonzero(link), strict=True)))
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_embedding_edges(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, 1, 0, "")] * 2 + [(2, [2.0] * 8, 1, 0, "")] + odd_vectors(), VECTORS)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in neardup.near_duplicate_vectors(df).collect())
    assert got[:3] == [("1", 2, "1", True), ("1", 2, "1", True), ("100", 0, "100", True)] and ("2", 2, "1", False) in got and ("None", 0, "None", True) in got and len(got) == 12


@pytest.mark.parametrize("family", [0, 1500])
def test_audits_see_what_narrow_beams_miss(family):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x[:family] = x[0] + 1e-3 * rng.normal(size=(family, 32))
    for i in range(2000, 3000, 2):
        x[i + 1] = x[i] + 1e-3
    x /= np.linalg.norm(x, axis=1)[:, None]
    exact = x @ x.T >= 0.98

    class Narrow(neardup.Graph):
        """Finds pairs outside the family with a wide beam only."""

        def within(self, q, threshold, ef, start=None):
            near = np.flatnonzero(self.x @ q >= threshold)
            return near if ef >= 128 else near[(near < family) | (near == start)]

    for ef, passes in ((32, False), (64, False), (128, True), (1501, True)):
        hit, recalls = neardup.search_pair(x, Narrow(x), True, 0.98, ef)
        assert (np.mean(recalls) >= neardup.RECALL) == passes and (hit == exact).all() == passes and not (hit & ~exact).any()


def linked_vectors(rng, n, dim=24):
    """Unit vectors: a family of an eighth of them, pairs among the next half, and lone ones."""
    x = rng.standard_normal((n, dim))
    near = lambda rows: rows + 0.02 * rng.standard_normal(rows.shape)
    x[: n // 8] = near(np.repeat(x[:1], n // 8, 0))
    odd = np.arange(n // 8 + 1, 5 * n // 8, 2)
    x[odd] = near(x[odd - 1])
    return (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(n)]


def test_the_graph_itself_finds_links_with_few_comparisons():
    x = linked_vectors(np.random.default_rng(3), 3000)
    graph, exact = neardup.Graph.build(x), x @ x.T >= 0.98
    hit, recalls = np.zeros(exact.shape, bool), None
    for i in range(len(x)):
        hit[i, graph.within(x[i], 0.98, neardup.EF, i)] = True
    shares = [(hit[i].sum() - 1) / (exact[i].sum() - 1) for i in np.flatnonzero(exact.sum(1) > 1)]
    assert not (hit & ~exact).any() and np.mean(shares) >= 0.99
    graph.compared = 0
    audited, recalls = neardup.search_pair(x, graph, True, 0.98)
    assert (audited >= hit).all() and 48 <= len(recalls) <= 96 and np.mean(recalls) >= 0.99


def test_embedding_duplicates_through_graphs_of_several_shards(spark):
    rng = np.random.default_rng(12)
    x = linked_vectors(rng, 6000).astype(np.float32)
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (v @ v.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    df = vectors_of(spark, x, np.zeros(len(x), int)).cache()
    got = neardup.near_duplicate_vectors(df, shard=2000).orderBy("vec_id").toPandas()
    assert got.n_links.sum() >= 0.99 * link.sum() and (got.n_links.to_numpy() <= link.sum(1)).all()
    whole, before = np.arange(len(x)), None
    while not np.array_equal(whole, before):
        before, whole = whole, np.array([min(whole[i], whole[row].min(initial=i)) for i, row in enumerate(link)])
    assert np.mean(got.component_id.to_numpy() == whole) >= 0.99
    audits = [r.asDict() for r in neardup.search_audits(df, shard=2000).orderBy("beam").collect()]
    assert [a["beam"] for a in audits] == [neardup.EF] and audits[0]["recall"] >= neardup.RECALL and audits[0]["audited"] > 100
    assert audits[0]["compared"] < 0.4 * audits[0]["pairs"]


def test_a_label_whose_audit_fails_is_searched_again(spark):
    # Scattered links, which a narrow beam misses, and a label under which nothing links.
    x = np.concatenate([np.random.default_rng(13).standard_normal((600, 24)), np.eye(24)]).astype(np.float32)
    df = vectors_of(spark, x, np.repeat([0, 1], [600, 24])).cache()
    audits = [r.asDict() for r in neardup.search_audits(df, threshold=0.6, shard=200, ef=1, goal=1.0).orderBy("label", "beam").collect()]
    beams = [a["beam"] for a in audits if a["label"] == 0]
    assert len(beams) > 1 and beams == [2**k for k in range(len(beams))] and [a["recall"] for a in audits if a["label"] == 0][-1] == 1.0
    assert all(a["recall"] < 1 for a in audits if a["label"] == 0 and a["beam"] < beams[-1])
    assert [(a["beam"], a["audited"], a["recall"]) for a in audits if a["label"] == 1] == [(1, 0, None)]


def test_forest_joins_rows_and_columns():
    hit = np.zeros((4, 3), bool)
    hit[1, 0] = hit[2, 0] = hit[2, 2] = True
    assert neardup.forest(hit).tolist() == [0, 1, 1, 3, 1, 5, 1]
    same = np.eye(4, dtype=bool)
    same[1, 3] = same[3, 1] = True
    assert neardup.forest(same)[:4].tolist() == [0, 1, 2, 1]


def test_components_raise_when_rounds_run_out(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="2 rounds"):
        components.connected_components(edges, most_rounds=2)
    assert {r["component"] for r in components.connected_components(edges).collect()} == {0}
