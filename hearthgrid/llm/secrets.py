"""Scanning for secrets with a ledger of blobs already scanned."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import stored

# The kinds of secrets, in the order in which spans at one place are listed.
# Pattern, the group that must have a length, and that length. Case is free where marked,
# among ASCII letters only.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (
        r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        2,
        12,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
}
RULES_VERSION = 1
BASE_KINDS = ("assign", "access", "hex")

FINDINGS = "blob_id binary, kind string, rank int, begin long, end long"


def spans_of(text: str, rules: Mapping[str, tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int]]:
    """Kind, its place in the rules, start and end of each match whose group is long enough.

    Matches of a kind are the leftmost ones that do not overlap, in code points.
    """
    for rank, (kind, (pattern, group, least)) in enumerate(rules.items()):
        for match in re.finditer(pattern, text):
            if match.end(group) - match.start(group) >= least:
                yield kind, rank, match.start(), match.end()


def versions(df: DataFrame, path: str, text: str) -> DataFrame:
    """``path``, ``text`` and the content address ``blob_id`` of every version of every path."""
    content = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(path).alias("path"),
        content.alias("text"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("blob_id"),
    )


def scan_versions(
    files: DataFrame,
    ledger: DataFrame | None = None,
    rules: Mapping[str, tuple[str, int, int]] = RULES,
    rules_version: int = RULES_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """Findings of the blobs that this version of the rules has not seen, and the new ledger.

    ``files`` comes from ``versions``; ``ledger`` has (blob_id, rules_version) of earlier
    scans, or is None at the first. Equal contents are one blob: it is scanned once, however
    many paths hold it. Copies fold on the map side, so a text that a third of all paths
    hold travels once per task. Returned are the new findings (one row per span) and the
    rows to append to the ledger; both tables are stored, so append them to the earlier ones.
    """
    spark = files.sparkSession
    blobs = files.select("blob_id", "text")
    if ledger is None:
        unseen = blobs.groupBy("blob_id").agg(F.first("text").alias("text"))
    else:
        seen = ledger.where(F.col("rules_version") == rules_version).select(
            "blob_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("seen")
        )
        both = blobs.withColumn("seen", F.lit(False)).unionByName(seen)
        unseen = (
            both.groupBy("blob_id")
            .agg(F.first("text", ignorenulls=True).alias("text"), F.max("seen").alias("seen"))
            .where(~F.col("seen"))
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob, text in zip(batch["blob_id"].to_pylist(), batch["text"], strict=True):
                found = list(spans_of(text.as_py(), rules))
                # A blob without findings has one row, for the ledger.
                rows += [(blob, *f) for f in found] or [(blob, None, None, None, None)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(
                        columns,
                        (pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64()),
                        strict=True,
                    )
                ],
                names=["blob_id", "kind", "rank", "begin", "end"],
            )

    scanned = stored(unseen.mapInArrow(scan, FINDINGS), "secret-findings")
    findings = scanned.where(F.col("kind").isNotNull())
    # All rows of a blob come from one task, next to each other.
    entries = scanned.select("blob_id", F.lit(rules_version).alias("rules_version")).distinct()
    return findings, entries


def _listed(spans, condition=None):
    """kind:start:end of the spans, by start and then kind as listed, joined by commas."""
    chosen = F.filter(spans, condition) if condition else spans
    ordered = F.array_sort(
        F.transform(chosen, lambda s: F.struct(s["begin"], s["rank"], s["end"], s["kind"]))
    )
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ","
    )


def _of_kinds(*kinds: str):
    return lambda span: span["kind"].isin(*kinds)


def findings_by_path(files: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """One row per version of a path: counts per base kind, digest of base spans, all spans.

    Versions without findings have zero counts, the digest of the empty text and no spans.
    A blob's spans are bounded by its text; they are gathered per blob, before the join, so
    a blob that many paths hold is joined as one row and its paths can be split.
    """
    spans = F.collect_list(F.struct("begin", "rank", "end", "kind"))
    by_blob = findings.groupBy("blob_id").agg(spans.alias("spans"))
    digest = by_blob.select(
        "blob_id",
        *[
            F.size(F.filter("spans", _of_kinds(kind))).cast("long").alias(f"n_{kind}")
            for kind in BASE_KINDS
        ],
        F.sha2(_listed(F.col("spans"), _of_kinds(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
    digest = stored(digest, "secret-digests")
    joined = files.join(digest, "blob_id", "left")
    return joined.select(
        F.col("path").alias(key),
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.coalesce("base_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def secrets_of(df: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets in every text, as a first scan with an empty ledger.

    Null and empty texts are the empty blob. Repeated rows and null paths keep a row each.
    """
    files = versions(df, path, text)
    findings, _ = scan_versions(files)
    narrow = stored(files.select("path", "blob_id"), "secret-paths")
    return findings_by_path(narrow, findings, path)
