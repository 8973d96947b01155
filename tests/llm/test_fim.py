"""Fill-in-middle: the wavelet matrix against plain counting, cuts against plain splits, odd rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.llm import fim
from wardline.llm.wavelet import WaveletMatrix

PLAIN_UNITS = {
    "line": r"[^\n]*\n|[^\n]+",
    "sentence": r"(?s)(?:(?![.!?](?:\s|\Z)|\n).)*(?:[.!?](?=\s|\Z)|\n)|.+",
    "word": r"(?s)[\W_]*[^\W_]+|[\W_]+",
    "character": r"(?s).",
}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_matrix_counts_and_finds(codes):
    codes = np.array(codes, np.uint8)
    matrix, places = WaveletMatrix(codes, 3), np.arange(len(codes) + 1)
    for c in range(8):
        assert matrix.rank(c, places).tolist() == [int((codes[:i] == c).sum()) for i in places]
        at = np.flatnonzero(codes == c)
        assert matrix.select(c, np.arange(len(at))).tolist() == at.tolist()
    at = np.flatnonzero(np.isin(codes, [1, 4, 6])) + 1
    assert matrix.behind((1, 4, 6), np.arange(1, len(at) + 1)).tolist() == at.tolist()


def plain(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(PLAIN_UNITS[unit], text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, middle, tail = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    assert head + middle + tail == text
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}"
    return n, "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}"


TEXTS = [
    "a\nb\nc\n", "a\nb\nc", "\n\n\n", "one line", "", None, "x <M> y\nz", "<P", "<\n<S\nP>\n", "ends in <", "é😀\n漢字。\nStraße 12!\n", "Dr. No. Yes!? 3.5 is it.\nOK", "\r\n   a b",
    "... !", "line\n" * 5_000, "long " * 60_000, "<S>", "a<P>", "\ntail", "_under_score_ x",
]


@pytest.mark.parametrize("unit", sorted(PLAIN_UNITS))
def test_equals_plain_splits(spark, unit):
    rows = [(i + 100 * k, t) for i, t in enumerate(TEXTS) for k in range(5)] + [(None, "x\ny\n"), (None, None), (1, "same\nrow"), (1, "same\nrow")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(3).alias(c) for c in ("n", "form", "h1", "output", "prefix_chars"))).repartition(3)
    for rate, spm in ((100, 50), (60, 20)):
        moved = fim.fill_in_middle(docs, unit, rate=rate, spm_rate=spm)
        got = moved.select("*", fim.restored(F.col("form"), F.col("output")).alias("back")).collect()
        said = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in got)
        expected = sorted((str(d), *((x := plain(d, t, unit, rate, spm))[:2]), str(x[2]), str(x[3]), x[4]) for d, t in rows)
        assert said == expected
        assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)


def test_empty_table_and_strings_as_ids(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = fim.fill_in_middle(spark.createDataFrame([("k-1", "a\nb\nc")], "doc_id string, text string")).collect()[0]
    assert tuple(row)[1:] == plain("k-1", "a\nb\nc") and row["doc_id"] == "k-1"


def test_other_markers(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb <P>\nc\n") for i in range(30)], "doc_id long, text string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    got = fim.fill_in_middle(docs, markers=marks).select("form", fim.restored(F.col("form"), F.col("output"), marks).alias("back")).collect()
    assert {r["form"] for r in got} == {"psm", "spm"} and sorted(r["back"] for r in got) == sorted(f"a{i}\nb <P>\nc\n" for i in range(30))
