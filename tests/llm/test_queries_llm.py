"""The registered corpus queries against SQL, and the pipeline end to end."""

import pytest
from oracle import same

from wardline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from wardline.llm.common import documents, saved

    docs = documents(spark, sf_dir)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] >= 0.98 * counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert (packed.start == 0).sum() == counts[4] and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_equals_plain_versions(spark, tmp_path):
    """Each stage against a plain version of its rule, on its own input, with odd rows and columns of the stages' own names."""
    import random

    import corpus_pipeline
    from pyspark.sql import functions as F
    from test_spans import plain_secrets
    from test_tables import brute_jaccard, plain_prediction

    from wardline.llm import langid
    from wardline.llm.common import saved
    from wardline.llm.secrets import find_secrets

    rng = random.Random(3)
    prose = ["the house and the garden were old and quiet that day", "der alte garten und das haus waren still an diesem tag", "la vieille maison et le jardin que nous aimons tant"]
    rows = []
    for i in range(90):
        words = (prose[i % 3] + " " + " ".join(rng.choices(prose[i % 3].split(), k=30))).split()
        rows.append((i, " ".join(words), "en de fr".split()[i % 3], "abc"[i % 3]))
        if i % 4 == 0:
            rows.append((200 + i, " ".join(words[:-1]), "en de fr".split()[i % 3], None))
        if i % 15 == 0:
            rows.append((400 + i, " ".join(words) + " token = abcdefgh12", "en", "a"))
    rows += [(900, None, None, None), (901, "", "en", "a"), (902, "12 34 !!", "en", "a"), (903, "漢字", "en", "a"), (None, prose[0], "en", None), (0, rows[0][1], "en", "a"), (904, "the and " * 40_000, "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", F.lit(1).alias("n_chars"), *(F.lit("c").alias(c) for c in ("kept_id", "tainted_blob", "blob_id", "row", "class", "size", "words", "taken", "part", "seq", "h")))
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())

    model = langid.fit_language_model(docs)
    named = saved(stages["language_id"](spark, docs, ""), "t1")
    assert key(named) == sorted((str(d), t) for d, t, *_ in rows if t and plain_prediction(t, model)[1] >= langid.LEAST_SCORE)

    one = saved(stages["jaccard_join"](spark, named, ""), "t2")
    held = [(r["doc_id"], r["text"]) for r in named.collect()]
    known = sorted((d, t) for d, t in held if d is not None)
    _, groups = brute_jaccard([t for _, t in known])
    first = {}
    for (d, t), g in zip(known, groups, strict=True):
        first.setdefault(g, (d, t))
    assert sorted(r["doc_id"] for r in one.where("doc_id IS NOT NULL").collect()) == sorted(d for d, _ in first.values())
    assert one.where("doc_id IS NULL").count() == sum(d is None for d, _ in held)

    clean = saved(stages["secret_scans"](spark, one, ""), "t3")
    assert key(clean) == [x for x in key(one) if not find_secrets(x[1])] and all(not plain_secrets(t) for _, t in key(clean))

    mixed = saved(stages["source_mixing"](spark, clean, ""), "t4")
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(clean)) <= 4 and mixed.columns == docs.columns
    assert {t[:20] for _, t in key(mixed)} <= {t[:20] for _, t in key(clean)}

    packed = stages["packing"](spark, mixed, "").toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert (packed.start == 0).sum() == mixed.count()
    assert packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
