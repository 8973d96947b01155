"""Personal data by a semi-Markov conditional random field.

A stretch of text around digits, @ or spelled-out addresses is a sequence of tokens. A segmentation
labels each token as outside, or as part of a segment of one type. Segments are scored whole (shape of
digit groups, check digits, known endings, the word before), so boundaries and types are chosen together
by dynamic programming over segments of at most LONGEST tokens. Weights are fitted here, by maximum
likelihood over all segmentations, on sentences drawn from a seeded generator. Spans of the base
patterns always stay: they are fixed segments that the others must not touch.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import spans as S
from wardline.llm.common import documents
from wardline.llm.secrets import FINDING, span_digest

TYPES = ("email", "phone", "card", "national_id", "iban")
KINDS = (*S.PII, "email_spelled", "phone_local", "card_spaced", "national_id", "iban")
NAMES = dict(zip(TYPES, ("email_spelled", "phone_local", "card_spaced", "national_id", "iban"), strict=True))
LONGEST = 14
REACH = 60  # characters on either side of a trigger
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s\w]|_")
TRIGGER = re.compile(r"[0-9]{2,}|@|[(\[ ](?:at|AT)[)\] ][^\n]{1,40}?[(\[ ](?:dot|DOT)[)\] ]")
ENDINGS = {"com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "info"}
CUES = {
    "email": {"mail", "email", "contact", "write", "reach"}, "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell"},
    "card": {"card", "visa", "credit", "debit", "mastercard"}, "national_id": {"ssn", "social", "security"}, "iban": {"iban", "account", "bank"},
}


def iban_ok(s: str) -> bool:
    turned = s[4:] + s[:4]
    return turned.isalnum() and turned.isascii() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def segment_features(tokens: list[str], i: int, j: int) -> list[str]:
    """Features of tokens i to j as one segment, shared by all types; each type has a weight for each."""
    part = tokens[i:j]
    text = "".join(part)
    groups = [len(t) for t in part if t.isdigit()]
    words = [t.lower() for t in part if t.isalpha()]
    n = sum(groups)
    before = [t.lower() for t in tokens[max(0, i - 3) : i] if t.isalpha()]
    out = [f"len{min(j - i, 9)}", f"digits{n if n < 20 else 20}", f"groups{'-'.join(map(str, groups)) if len(groups) < 6 else 'many'}"]
    for kind, cues in CUES.items():
        if any(w in cues for w in before):
            out.append(f"cue_{kind}")
    out.append(f"first_{shape(part[0])}")
    out.append(f"last_{shape(part[-1])}")
    if i > 0 and (tokens[i - 1].isdigit() or tokens[i - 1] in "+-./"):
        out.append("joined_left")
    if j < len(tokens) and (tokens[j].isdigit() or tokens[j] in "-/@"):
        out.append("joined_right")
    if words and words[-1] in ENDINGS and ("at" in words[1:-2] or "@" in part) and ("dot" in words[2:-1] or "." in part[2:-1]):
        out.append("address")
    if 12 <= n <= 19 and not words:
        out.append("luhn" if S.luhn("".join(t for t in part if t.isdigit())) else "no_luhn")
    if words and len(words[0]) == 2 and 15 <= len(text) <= 34 and text[2:4].isdigit():
        out.append("iban" if iban_ok(text.upper()) else "no_iban")
    out += sorted({f"mark{t}" for t in part if not t.isalnum()})
    if words and "address" not in out and "iban" not in out:
        out.append("words")
    return out


def shape(t: str) -> str:
    return "digit" if t.isdigit() else "word" if t.isalpha() else t


def allowed(tokens: list[str], i: int, j: int) -> bool:
    """Whether a segment may be an entity at all: it holds a digit pair or an address mark, and ends on no mark."""
    part = tokens[i:j]
    if not (part[0].isalnum() or part[0] in "+(") or not part[-1].isalnum():
        return False
    return any(len(t) > 1 and t.isdigit() for t in part) or "@" in part or ("at" in part[1:] and "dot" in part[2:])


def forward(scores: dict, n: int) -> tuple[np.ndarray, float]:
    """Log sums over all segmentations of the tokens before each place; outside tokens score 0."""
    a = np.full(n + 1, -math.inf)
    a[0] = 0.0
    by_end: dict[int, list] = {}
    for (i, j), s in scores.items():
        by_end.setdefault(j, []).append((i, np.logaddexp.reduce(s)))
    for j in range(1, n + 1):
        a[j] = np.logaddexp.reduce([a[j - 1], *(a[i] + s for i, s in by_end.get(j, ()))])
    return a, a[n]


def fit_weights(examples: int = 260, rounds: int = 14, rate: float = 0.35, ridge: float = 2e-4, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights by feature, one for each type, that make the generator's segmentations most likely."""
    rng = random.Random(seed)
    data = []
    for _ in range(examples):
        tokens, gold = sentence(rng)
        cells = {(i, j): segment_features(tokens, i, j) for i in range(len(tokens)) for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1) if allowed(tokens, i, j)}
        data.append((tokens, gold, cells))
    names = {f: k for k, f in enumerate(sorted({f for _, _, cells in data for fs in cells.values() for f in fs}))}
    w, seen = np.zeros((len(names) + 1, len(TYPES))), np.full((len(names) + 1, len(TYPES)), 1e-6)
    data = [(len(tokens), gold, {c: np.array([len(names), *(names[f] for f in fs)]) for c, fs in cells.items()}) for tokens, gold, cells in data]
    for _ in range(rounds):
        for at in range(0, len(data), 50):
            grad = ridge * w * 50
            for n, gold, cells in data[at : at + 50]:
                scores = {c: w[f].sum(0) for c, f in cells.items()}
                a, z = forward(scores, n)
                flipped, _ = forward({(n - j, n - i): s for (i, j), s in scores.items()}, n)
                for (i, j), f in cells.items():
                    p = np.exp(a[i] + scores[i, j] + flipped[n - j] - z)
                    if (i, j) in gold:
                        p = p - np.eye(len(TYPES))[TYPES.index(gold[i, j])]
                    np.add.at(grad, f, p[None, :])
            seen += grad**2
            w -= rate * grad / np.sqrt(seen)
    return {"": w[-1]} | {f: w[k] for f, k in names.items()}


def sentence(rng: random.Random) -> tuple[list[str], dict]:
    """Tokens of an invented sentence, and the segments that are personal data."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    tokens, gold = [word() for _ in range(rng.randint(1, 5))], {}
    for _ in range(rng.randint(1, 2)):
        kind = rng.choice([*TYPES, "none", "none", "none", "none"])
        if kind != "none" and rng.random() < 0.4:
            tokens.append(rng.choice(sorted(CUES[kind])))
            if rng.random() < 0.5:
                tokens.append(":")
        if kind == "email":
            at, dot = rng.choice([("at", "dot"), ("( at )", "( dot )"), ("[ at ]", "[ dot ]"), ("@", "dot"), ("at", ".")])
            made = f"{word()} {at} {word()} {dot} {rng.choice(sorted(ENDINGS))}"
        elif kind == "phone":
            made = rng.choice([f"( {num(3)} ) {num(3)} - {num(4)}", f"{num(3)} - {num(3)} - {num(4)}", f"{num(3)} . {num(3)} . {num(4)}"])
        elif kind == "card":
            digits = num(15)
            digits += next(d for d in "0123456789" if S.luhn(digits + d))
            made = rng.choice([" . ", " / ", " _ "]).join(digits[k : k + 4] for k in range(0, 16, 4))
        elif kind == "national_id":
            made = f"{num(3)} - {num(2)} - {num(4)}"
        elif kind == "iban":
            body = rng.choice(["DE", "FR", "ES", "NL"]), num(rng.choice([18, 20]))
            check = 98 - int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
            whole = f"{check:02d}{body[1]}"
            made = f"{body[0]} " + (whole if rng.random() < 0.5 else f"{whole[:2]} " + " ".join(whole[k : k + 4] for k in range(2, len(whole), 4)))
        else:
            made = rng.choice([f"{num(2)} . {num(2)} . {num(4)}", f"{num(4)} - {num(2)} - {num(2)}", f"{num(rng.randint(2, 11))}", f"{num(1)} . {num(2)} . {num(1)}", f"$ {num(3)} , {num(3)}", f"{num(2)} : {num(2)}", num(16), f"{num(3)} - {num(3)}", f"{num(3)} . {num(3)}", f"{num(4)} / {num(4)}", f"{word()} at {word()} {word()}", f"{word()} - {num(5)} - {num(6)}"])
        part = made.split()
        if kind != "none":
            gold[len(tokens), len(tokens) + len(part)] = kind
        tokens += part + [word() for _ in range(rng.randint(1, 4))]
    return tokens, gold


def added_spans(text: str, base: list[tuple[int, int, str]], weights: dict) -> list[tuple[int, int, str]]:
    """What the best segmentation adds to the base spans."""
    hits = [m.span() for m in TRIGGER.finditer(text)]
    if not hits:
        return []
    out, k = [], 0
    while k < len(hits):
        low, high = hits[k]
        while k + 1 < len(hits) and hits[k + 1][0] - high <= REACH:
            k += 1
            high = hits[k][1]
        k += 1
        # Triggers at most REACH apart are decoded as one window. Windows of others may share words without
        # digits or address marks only; a segment holds one of these and LONGEST tokens at most.
        low, high = widen(text, low, -1), widen(text, high, 1)
        tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, low, high)]
        out += decode(tokens, base, weights)
    return out


def widen(text: str, at: int, step: int) -> int:
    """The place REACH characters away, or a little more, never inside a word."""
    end = max(0, at - REACH) if step < 0 else min(len(text), at + REACH)
    while 0 < end < len(text) and text[end - 1].isalnum() and text[end].isalnum() and end != at:
        end -= step
    return end


def decode(tokens, base, weights) -> list[tuple[int, int, str]]:
    words = [t[2] for t in tokens]
    taken = [any(s < e and b < t for b, e, _ in base) for s, t, _ in tokens] if base else [False] * len(tokens)
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i in range(j - 1, max(-1, j - LONGEST - 1), -1):
            if taken[i]:
                break
            if allowed(words, i, j):
                s = weights[""] + sum((weights[f] for f in segment_features(words, i, j) if f in weights), np.zeros(len(TYPES)))
                k = int(s.argmax())
                if best[i] + s[k] > best[j]:
                    best[j], back[j] = best[i] + s[k], (i, k)
    out, j = [], len(tokens)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((tokens[i][0], tokens[j - 1][1], NAMES[TYPES[k]]))
            j = i
    return out


def find_personal_data(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """doc_id and findings (start, end, kind by start) of every row's whole text.

    Null and empty texts have none. Repeated rows are answered each. Other columns are ignored.
    """
    weights = fit_weights() if weights is None else weights

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            found = []
            for text in batch["text"].to_pylist():
                base = S.pii_spans(text) if text else []
                found.append([{"start": s, "end": e, "kind": k} for s, e, k in S.in_order(base + added_spans(text, base, weights), KINDS)] if text else [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "findings"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, findings {FINDING}")


def op1_personal_data(spark, sf_dir):
    found = find_personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *span_digest(F.col("findings"), KINDS, S.PII), F.size("findings").cast("long").alias("n_spans"))
