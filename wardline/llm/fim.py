"""Fill-in-middle: texts cut in three at unit boundaries and put in another order, and back.

Each code point has a class, by itself and what follows it. One wavelet matrix over the classes of a
block of texts counts the units of all of them by rank queries and finds all cuts by selects (one class
ends a unit) or by bisection on added ranks (several do); texts are never split into units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents
from wardline.llm.wavelet import WaveletMatrix
from wardline.llm.wordhash import slices

#: Classes of code points: a line's end, other space, a full stop with space or the text's end behind it, other marks, and letters or digits with (INNER) or without (LAST) another one behind them.
NEWLINE, SPACE, STOP, MARK, INNER, LAST = range(6)
#: What ends a unit. What lies behind the last end is one more unit.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (LAST,), "character": (NEWLINE, SPACE, STOP, MARK, INNER, LAST)}
MARKERS = ("<P>", "<S>", "<M>")
TEXT = 1 << 20  # bytes of text in one matrix


def kinds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter or digit, and whether it is a space."""
    wide = np.unique(points[points > 127])
    letter, space = (np.array([f(chr(c)) for c in [*range(128), *wide.tolist()]], bool) for f in (str.isalnum, str.isspace))
    at = np.where(points > 127, 128 + np.searchsorted(wide, points), points)
    return letter[at], space[at]


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each code point; ends: places behind the last one of each text."""
    letter, space = kinds(points)
    last = np.zeros(len(points) + 1, bool)
    last[ends] = True
    last = last[1:]  # a text ends behind this place
    bare = np.append(~letter[1:], True) | last
    parted = np.append(space[1:], True) | last
    stop = np.isin(points, [ord("."), ord("!"), ord("?")]) & parted
    out = np.where(letter, np.where(bare, LAST, INNER), np.where(space, SPACE, np.where(stop, STOP, MARK)))
    return np.where(points == 10, NEWLINE, out).astype(np.uint8)


def draws(doc_id: str, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def cut_block(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts joined, where each begins and the last ends, units, first cut, second cut), in code points."""
    at = np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
    whole = "".join(texts.to_pylist())
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    ending = UNITS[unit]
    if not len(points):
        return whole, at, *(np.zeros(len(texts), np.int64) for _ in range(3))
    code = classes(points, at[1:])
    matrix = WaveletMatrix(code, 3)
    counts = matrix.count(ending, at)
    starts, ends, before, closed = at[:-1], at[1:], counts[:-1], np.diff(counts)
    n = closed + ((ends > starts) & ~np.isin(code[np.maximum(ends, 1) - 1], ending))

    def place(units):
        out = np.where(units == 0, starts, ends)
        inside = (units > 0) & (units <= closed)
        out[inside] = matrix.behind(ending, (before + units)[inside])
        return out

    a, b = h1 % (n + 1), h2 % (n + 1)
    return whole, at, n, place(np.minimum(a, b)), place(np.maximum(a, b))


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: each text with its middle moved to the end.

    unit: what cuts keep whole (line, sentence, word, character). Of texts that hold no marker, `rate` in
    100 are moved, and of those `spm_rate` in 100 with the suffix first (spm), the rest with the prefix
    first (psm); the others are plain: left as they are, with null lengths. What is drawn depends on seed
    and doc_id alone, so repeated rows come out alike; a null doc_id draws like an empty one. Null texts
    are empty and plain. Texts of any length are worked on whole; empty tables give no rows; other columns,
    whatever their names, are ignored. Nothing is shuffled.
    """
    of, (p, s, m) = dict(docs.dtypes)["doc_id"], markers

    def run(batches):
        for batch in batches:
            done = 0
            for texts in slices(batch["text"], TEXT):
                k = len(texts)
                names = batch["doc_id"].slice(done, k)
                h1, h2, h3, h4 = (batch[f"h{i}"].slice(done, k).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
                done += k
                whole, at, n, first, second = cut_block(texts.fill_null(""), h1, h2, unit)
                forms, heads, middles, outs = [], [], [], []
                for start, a, b, end, x, y in zip(*(c.tolist() for c in (at[:-1], first, second, at[1:], h3 % 100, h4 % 100)), strict=True):
                    text = whole[start:end]
                    plain = start == end or x >= rate or any(mark in text for mark in markers)
                    form = "plain" if plain else "spm" if y < spm_rate else "psm"
                    prefix, middle, suffix = whole[start:a], whole[a:b], whole[b:end]
                    forms.append(form)
                    heads.append(None if plain else a - start)
                    middles.append(None if plain else b - a)
                    outs.append(text if plain else f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}")
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(n), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(outs, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select("doc_id", "text", *draws("doc_id", seed))
    return rows.mapInArrow(run, f"doc_id {of}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that was moved: its pieces lie between the markers, which no moved text holds."""
    p, s, m = (F.lit(x) for x in markers)
    part = lambda text, mark, k: F.split_part(text, mark, F.lit(k))
    head, middle = part(output, m, 1), part(output, m, 2)
    psm = F.concat(part(part(head, p, 2), s, 1), middle, part(head, s, 2))
    spm = F.concat(part(head, p, 2), middle, part(part(head, s, 2), p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark, sf_dir):
    moved = fill_in_middle(documents(spark, sf_dir))
    back = restored(F.col("form"), F.col("output"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = """
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
lines AS (
  SELECT *, string_split(text, chr(10)) AS parts, length(text) - length(replace(text, chr(10), '')) AS closed,
         CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2,
         CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM base),
counted AS (SELECT *, closed + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END AS n FROM lines),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM counted),
placed AS (
  SELECT *, CASE WHEN a = 0 THEN 0 WHEN a > closed THEN length(text) ELSE length(array_to_string(parts[1:a], chr(10))) + 1 END AS p,
         CASE WHEN b = 0 THEN 0 WHEN b > closed THEN length(text) ELSE length(array_to_string(parts[1:b], chr(10))) + 1 END AS q,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cuts),
pieces AS (SELECT *, substr(text, 1, p) AS head, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS tail FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', head, '<S>', tail, '<M>', middle) ELSE concat('<S>', tail, '<P>', head, '<M>', middle) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
