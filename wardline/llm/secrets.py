"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the hash of its content. Only pairs of blob and rule
version that the ledger doesn't hold are scanned, once each however many paths hold the blob; what was
found is joined back to all paths. The ledger is a table that the next run takes in.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import spans as S
from wardline.llm.common import cut, documents, forget_caches, free_name, leaner, saved

RULES = "2026.1"
#: Kinds that the scan adds to the base kinds: well-known formats with a fixed prefix.
ADDED = {
    "private_key": ("-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+")),
    "forge_token": ("gh", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+")),
    "chat_token": ("xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+")),
    "url_password": ("://", re.compile(r"(?<=://)[A-Za-z0-9._%-]{1,64}:[^\s:@/]{3,128}(?=@[A-Za-z0-9])")),
}
KINDS = (*S.SECRETS, *ADDED)
FINDING = "array<struct<start:int,end:int,kind:string>>"
LEDGER = f"blob_id string, rule_version string, findings {FINDING}"
BROADCAST = 100_000  # ids of unseen blobs that are sent to the texts, 64 bytes each


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    found = S.secret_spans(text)
    for kind, (mark, pattern) in ADDED.items():
        if mark in text:
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
    return S.in_order(found, KINDS)


def blob(text) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark, table: str) -> DataFrame | None:
    """The rows of a ledger table; None if there is no such table yet."""
    try:
        return spark.read.schema(LEDGER).parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def one_of_each_pair(ledger: DataFrame) -> DataFrame:
    """One row per blob and rule version."""
    return ledger.groupBy("blob_id", "rule_version").agg(F.first("findings").alias("findings"))


def unseen_texts(versions: DataFrame, known: DataFrame | None, rules: str, text: str) -> DataFrame:
    """blob_id, text: one row per blob that has no row of this rule version in the ledger.

    Copies are put together before the shuffle, however many there are. Where few blobs are unseen
    (BROADCAST at most, counted first), their ids go to the texts and no other text is shuffled.
    """
    texts = versions.select(blob(F.col(text)).alias("blob_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if known is None:
        return texts.groupBy("blob_id").agg(F.first("text").alias("text"))
    seen = known.where(F.col("rule_version") == rules).select("blob_id")
    unseen = cut(texts.select("blob_id").distinct().join(seen, "blob_id", "left_anti"))
    if unseen.count() <= BROADCAST:
        return texts.join(F.broadcast(unseen), "blob_id", "left_semi").groupBy("blob_id").agg(F.first("text").alias("text"))
    return texts.groupBy("blob_id").agg(F.first("text").alias("text")).join(unseen, "blob_id", "left_semi")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES, path: str = "doc_id", text: str = "text", table: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): path, blob_id, findings for every row of versions; and the grown ledger.

    versions: one row per path and version. ledger: blob_id, rule_version, findings from earlier runs.
    Null and empty texts are the same empty blob, with no findings. Repeated rows and copies share one
    scan, under whatever paths, null ones too; each row of versions keeps its row. Empty tables give no
    rows and leave the ledger as it is. Other columns, whatever their names, are ignored. New ledger rows
    are appended to `table`, whose earlier rows count as known like those of `ledger`; without it they are
    written to a table of their own in the shared folder. The grown ledger has one row per blob and rule
    version, those of both and the new ones.
    """
    earlier = [x for x in (ledger, read_ledger(versions.sparkSession, table) if table else None) if x is not None]
    known = functools.reduce(DataFrame.unionByName, [x.select("blob_id", "rule_version", "findings") for x in earlier]) if earlier else None

    def scan(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        forget_caches()
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(t)] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["blob_id"], pa.array(found, kind)], ["blob_id", "findings"])

    fresh = unseen_texts(versions, known, rules, text).mapInArrow(leaner(scan), f"blob_id string, findings {FINDING}").select("blob_id", F.lit(rules).alias("rule_version"), "findings")
    if table:
        known = ledger  # what the table held is read again with the new rows
        fresh.write.mode("append").parquet(table)
        fresh = versions.sparkSession.read.schema(LEDGER).parquet(table)
    else:
        fresh = saved(fresh, "blob-ledger")
    grown = one_of_each_pair(fresh if known is None else known.select(fresh.columns).unionByName(fresh))
    return found_in(versions, grown, rules, path, text), grown


def found_in(versions: DataFrame, ledger: DataFrame, rules: str = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob_id, findings for every row of versions, by what the ledger has for their blobs."""
    paths = versions.select(F.col(path).alias("path"), blob(F.col(text)).alias("blob_id"))
    hits = ledger.where((F.col("rule_version") == rules) & (F.size("findings") > 0)).select(F.col("blob_id").alias("b"), "findings")
    return paths.join(hits, F.col("blob_id") == F.col("b"), "left").select("path", "blob_id", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def span_digest(findings, kinds: tuple[str, ...], base: tuple[str, ...]) -> list:
    """Counts of the base kinds, the hash of their spans and all spans, of findings sorted by start and kind."""
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = F.filter(findings, lambda x: x["kind"].isin(*base))
    return [
        *(F.size(F.filter(findings, of_kind(k))).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(text(own), 256).alias("base_sha256"),
        text(findings).alias("spans"),
    ]


def drop_texts_with_secrets(docs: DataFrame, ledger: DataFrame | None = None, table: str | None = None) -> DataFrame:
    """docs, with all their columns, whatever their names, without texts in which the scan finds a secret.

    ledger and table are those of scan_versions. Null and empty texts stay, and so do repeated rows, each
    of them. Empty tables give no rows.
    """
    _, grown = scan_versions(docs, ledger, table=table)
    name = free_name(docs, "blob_id")
    tainted = grown.where((F.col("rule_version") == RULES) & (F.size("findings") > 0)).select(F.col("blob_id").alias(name))
    return docs.join(tainted, blob(docs["text"]) == F.col(name), "left_anti")


def op4_secret_ledger(spark, sf_dir):
    """Documents come to the ledger in two runs, dealt by a hash; the second scans only what the first did not."""
    docs = documents(spark, sf_dir)
    ledger = None
    for run in (0, 1):
        _, ledger = scan_versions(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == run), ledger)
    found = found_in(docs, ledger)
    return found.select(F.col("path").alias("doc_id"), *span_digest(F.col("findings"), KINDS, S.SECRETS), "blob_id")
