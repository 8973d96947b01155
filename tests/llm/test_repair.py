"""Repair of conversations: the search against a plain table of costs, and the query against a plain version of its rules."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wardline.llm import repair
from wardline.llm.editsearch import FITS, STEPS, Repair


def cheapest(rows):
    """(cost, edits) from a table of the cost from every place and state to the end."""
    n, none = len(rows), 1 << 30
    togo = [[none] * 4 for _ in range(n + 1)]
    fit = [STEPS[q][FITS[q][0]] for q in range(4)]
    for i in reversed(range(n + 1)):
        for q in range(4):
            if i == n:
                togo[i][q] = 0 if q in (0, 3) else none
                continue
            (c, fault), best = rows[i], 4 + togo[i + 1][q]
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                best = min(best, 3 + more + togo[i + 1][fit[q]], more + togo[i + 1][STEPS[q][c]] if c in STEPS[q] else none)
            togo[i][q] = best
        for _ in range(4):
            for q in range(4):
                togo[i][q] = min(togo[i][q], 3 + togo[i][fit[q]])
    out, i, q = "", 0, 0
    while i < n or q not in (0, 3):
        need, fault = togo[i][q], rows[i][1] if i < n else 0
        more = 3 * (fault == 3)
        if i < n and need == 4 + togo[i + 1][q]:
            out, i = out + "D", i + 1
        elif need == 3 + togo[i][fit[q]]:
            out, q = out + "I", fit[q]
        elif rows[i][0] in STEPS[q] and need == more + togo[i + 1][STEPS[q][rows[i][0]]]:
            out, i, q = out + "K", i + 1, STEPS[q][rows[i][0]]
        else:
            assert need == 3 + more + togo[i + 1][fit[q]]
            out, i, q = out + "R", i + 1, fit[q]
    return togo[0][0], out


def searched(rows, run=repair.RUN):
    found = Repair(run)
    for row in rows:
        found.add(*row)
    return found.done()


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_least_of_the_cheapest(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:  # a clean run
                first = rng.choice("ua")
                rows += [((first, "au"[first == "a"])[k % 2], 0) for k in range(rng.randint(1, rng.choice([4, 20, 50])))]
            else:
                rows += [(rng.choice("uuaasst "), rng.choice([0, 0, 0, 1, 2, 3, 3])) for _ in range(rng.randint(1, 6))]
        assert searched(rows) == searched(rows, 1 << 30) == cheapest(rows), rows
    assert searched([]) == (0, "") and searched([("s", 0)]) == (4, "D")


def test_long_conversation_is_searched_in_pieces():
    rng = random.Random(1)
    rows = [("ua"[i % 2], 0) if rng.random() < 0.97 else (rng.choice("uas"), rng.choice([0, 1, 2, 3])) for i in range(30_000)]
    found, most = Repair(), 0
    for row in rows:
        found.add(*row)
        most = max(most, len(found.initials))
    assert found.done() == cheapest(rows) and most < 2_000


def plain(rows, harm=True):
    """conv_id -> what the query returns, by its rules, from rows (conv_id, turn, role, text)."""
    said = lambda x: " " if x is None else str(x)
    out, held = {}, {}
    for conv, turn, role, text in rows:
        own, role, text = held.setdefault(conv, []), said(role), said(text)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20 if harm else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in held.items():
        tie = lambda r: (hash_of(r[1]), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        state, at, told = 0, 0, []
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else own[at]
            at += e != "I"
            if e != "D":
                role = role if e == "K" else FITS[state]
                state = STEPS[state][role[0]]
                told.append(f"{role}:{text}")
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


_hashes = {}


def hash_of(role):
    return _hashes[role]


def learn_hashes(spark, roles):
    rows = spark.createDataFrame([(r,) for r in roles], "role string").select("role", F.xxhash64("role")).collect()
    _hashes.update({r[0]: r[1] for r in rows})


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_version(spark, sf):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '/root/testdata/{sf}/conversations.parquet'").fetchall()
    learn_hashes(spark, {"user", "assistant", "system"})
    got = repair.op12_repair_conversations(spark, f"/root/testdata/{sf}").collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain(rows) and len(got) == len({r[0] for r in rows})
    assert [f.dataType.simpleString() for f in repair.op12_repair_conversations(spark, f"/root/testdata/{sf}").schema][1:7] == ["bigint"] * 6


def test_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    texts = ["Yes.", "no end", None, "", " \t", "Why?  \n", "Stop! ", "x" * 50_000 + ".", "é."]
    roles = ["user", "assistant", "system", "tool", None, "", "a"]
    rows = [(i, t, rng.choice(roles), rng.choice(texts)) for i in range(150) for t in rng.sample(range(12), rng.randint(1, 7))]
    rows += [(200, None, "user", "A."), (200, None, "user", "A."), (200, 1, "assistant", "B."), (200, 1, "system", "C."), (201, None, None, None), (None, 3, "user", "q?"), (None, 9, "assistant", "r."), (None, None, "user", None)]
    rows += [(202, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(-1_500, 1_500)]
    learn_hashes(spark, {r or " " if r is None else r for r in roles} | {"user"})
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in ("key", "fault", "seq", "here", "harm", "audit"))).repartition(4)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = repair.op12_repair_conversations(spark, str(tmp_path)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain(rows)
    plans, turns = repair.repair_conversations(df)
    expected = plain(rows, harm=False)
    assert {r["conv_id"]: tuple(r)[1:] for r in plans.collect()} == {k: v[:-1] for k, v in expected.items()}
    again = repair.plan_repairs(turns.withColumnRenamed("seq", "turn")).collect()
    assert len(again) > 90 and sum(r["illegal"] + r["gaps"] for r in again) == 0
    empty = df.limit(0)
    assert repair.plan_repairs(empty).count() == 0 and repair.repaired_turns(empty, plans.limit(0)).count() == 0
    gone = repair.plan_repairs(empty, spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")).collect()
    assert sorted(map(tuple, gone), key=str) == [(5, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
