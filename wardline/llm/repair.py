"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

Plans are made from a few bytes a row (initial of the role, faults, hash of role and text); texts go once
through a shuffle, next to the plan of their conversation, and stream by while it is carried out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import saved
from wardline.llm.editsearch import BLANK, DUPLICATE, FITS, RUN, START, STEPS, TRUNCATED, Repair

SPACES = " \t\n\x0b\x0c\r"
PLAN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, key: nulls of role and text are one space; key hashes both."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), key.alias("key"))


def own_fault(text: Column) -> Column:
    """Blank or truncated, from the text alone."""
    bare = F.rtrim(text, F.lit(SPACES))
    return F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)


def plan_repairs(rows: DataFrame, also: DataFrame | None = None, run: int = RUN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation.

    rows: conv_id, turn, role, text; a conversation's rows count in order of turn (nulls first), equal turns
    by role and a hash of role and text. also: conversations (conv_id, repeated or not) that get a row even
    without turns: zeros and an empty audit. A row's first fault counts: blank, duplicate (role and text of
    an earlier row), truncated. audit has the initials of the cheapest edits that make the roles legal, the
    ASCII-least of them (see editsearch). gaps: turns missing between the least and the greatest. Null roles
    and texts are one space, so such texts are blank; rows of a null conv_id are one conversation; repeated
    rows are duplicates; other columns, whatever their names, are ignored; empty tables give no rows.

    Of a conversation 16 bytes a row are kept for duplicates and two a row up to its next run of `run` clean
    turns; the audit is a letter a row.
    """
    own = keyed(rows)
    small = own.select("conv_id", "turn", "role", "key", F.left("role", F.lit(1)).alias("initial"), own_fault(F.col("text")).cast("tinyint").alias("fault"), F.lit(True).alias("here"))
    small = small.select("conv_id", "turn", F.xxhash64("role").alias("by_role"), "key", "initial", "fault", "here")
    if also is not None:
        blank = also.select("conv_id", *(F.lit(None).cast(small.schema[c].dataType).alias(c) for c in ("turn", "by_role", "key", "initial", "fault")), F.lit(False).alias("here"))
        small = small.unionByName(blank)
    of = dict(small.dtypes)["conv_id"]
    ordered = small.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "by_role", "key")

    def plan(batches):
        key, begun, kind, done = None, False, None, []

        def close():
            cost, audit = repair.done()
            gaps = 0 if low is None else last_turn - low + 1 - turns
            done.append((key, gaps, *(counts[f] for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit))

        def batch_of():
            kinds = (kind, *[pa.int64()] * len(PLAN), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", *PLAN, "audit"])

        for batch in batches:
            kind = batch["conv_id"].type
            for name, turn, mark, initial, fault, here in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "key", "initial", "fault", "here")), strict=True):
                if not begun or name != key:
                    if begun:
                        close()
                    begun, key = True, name
                    repair, seen, counts, illegal, before = Repair(run), set(), [0] * 4, 0, None
                    low, last_turn, turns = None, None, 0
                if not here:
                    continue
                if fault != BLANK and mark in seen:
                    fault = DUPLICATE
                seen.add(mark)
                counts[fault] += 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                repair.add(initial, fault)
                if turn is not None and turn != last_turn:
                    low, last_turn, turns = turn if low is None else low, turn, turns + 1
            if done:
                yield batch_of()
                done.clear()
        if begun:
            close()
            yield batch_of()

    columns = ", ".join(f"{c} long" for c in PLAN)
    return ordered.select("conv_id", "turn", "key", "initial", "fault", "here").mapInArrow(plan, f"conv_id {of}, {columns}, audit string")


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, seq, role, text, edit: the turns that the plans leave, rename or insert, in order.

    plans: those of plan_repairs for these rows. Rows of a conversation are next to each other; seq counts
    them from 0; edit is K, R or I. What is said of odd rows there holds here too. No conversation is held.
    """
    texts = keyed(rows).select("conv_id", F.lit(1).alias("step"), "turn", F.xxhash64("role").alias("by_role"), "key", "role", "text")
    audits = plans.select("conv_id", F.lit(0).alias("step"), *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("turn", "by_role", "key", "role")), F.col("audit").alias("text"))
    of = dict(texts.dtypes)["conv_id"]
    both = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "by_role", "key")

    def carry_out(batches):
        out = {"conv_id": [], "seq": [], "role": [], "text": [], "edit": []}
        key, audit, at, state, seq, kind = None, "", 0, START, 0, None

        def emit(role, text, edit):
            nonlocal seq, state
            for c, v in zip(out, (key, seq, role, text, edit), strict=True):
                out[c].append(v)
            seq, state = seq + 1, STEPS[state][role[:1]]

        def insert():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                emit(FITS[state], "", "I")
                at += 1

        def batch_of():
            kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))
            for c in out.values():
                c.clear()
            return made

        for batch in batches:
            kind = batch["conv_id"].type
            for name, step, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "step", "role", "text")), strict=True):
                if step == 0:
                    insert()
                    key, audit, at, state, seq = name, text, 0, START, 0
                    continue
                insert()
                edit = audit[at]
                at += 1
                if edit != "D":
                    emit(role if edit == "K" else FITS[state], text, edit)
            if out["seq"]:
                yield batch_of()
        insert()
        if out["seq"]:
            yield batch_of()

    return both.select("conv_id", "step", "role", "text").mapInArrow(carry_out, f"conv_id {of}, seq long, role string, text string, edit string")


def repair_conversations(rows: DataFrame, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(plans, turns): plans are written in the shared folder, as turns come of them."""
    plans = saved(plan_repairs(rows, also), "repair-plans")
    return plans, repaired_turns(rows, plans)


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` joined by line feeds; turns as repaired_turns gives them."""
    of = dict(turns.dtypes)["conv_id"]

    def run(batches):
        key, told, kind, done = None, None, None, []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([h for _, h in done])], ["conv_id", "repaired_sha256"])
        for batch in batches:
            kind = batch["conv_id"].type
            for name, seq, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "seq", "role", "text")), strict=True):
                if seq == 0:
                    if told:
                        done.append((key, told.hexdigest()))
                    key, told = name, hashlib.sha256()
                told.update(f"{chr(10) if seq else ''}{role}:{text}".encode())
            if done:
                yield batch_of()
                done.clear()
        if told:
            done.append((key, told.hexdigest()))
            yield batch_of()

    return turns.select("conv_id", "seq", "role", "text").mapInArrow(run, f"conv_id {of}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here: rows harmed by the CRC-32 of `conv_id:turn`, modulo 20; nulls are one space.

    0: the row goes (here is false), 1: no text, 2: no full stops, 3: comes twice, 4: its role is user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(said("role"))
    rows = rows.withColumn("harm", harm).withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") != 0).alias("here"))


def op12_repair_conversations(spark, sf_dir):
    harmed = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plans, turns = repair_conversations(harmed.where("here"), harmed.where("NOT here"))
    digests = turn_digests(turns).withColumnRenamed("conv_id", "of")
    found = plans.join(digests, plans["conv_id"].eqNullSafe(digests["of"]), "left")
    return found.select("conv_id", *PLAN, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
