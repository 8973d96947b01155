"""Base patterns for personal data and secrets, as spans in code points, in time linear in the text.

Spans of one kind are found leftmost first and don't overlap; a match that fails its test is dropped
and the search goes on behind it.
"""

from __future__ import annotations

import re

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that starts inside a run of digits fails or succeeds like one from the run's start, so only starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
DIGIT = re.compile(r"[0-9]")

PII = ("email", "ip", "card", "phone")
SECRETS = ("assign", "access", "hex")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str):
    pos = 0
    while (at := text.find("@", pos)) >= 0:
        start = pos + len(text[pos:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        pos = found.end() if found else at + 1


def pii_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every base kind, by start and then kind as listed."""
    found = [(s, e, "email") for s, e in emails(text)]
    if DIGIT.search(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return in_order(found, PII)


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low or "ſ" in text or "K" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return in_order(found, SECRETS)


def in_order(spans, kinds) -> list[tuple[int, int, str]]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda x: (x[0], rank.get(x[2], len(rank)), x[2], x[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
