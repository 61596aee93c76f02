"""Bounded labelled samples, shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 5 is 0: such rows never train anything. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def bounded_sample(rows: DataFrame, label: str, most: int, seed: int = 5) -> DataFrame:
    """About `most` rows at most, the labels in equal parts as far as they go: a keyed hash of doc_id picks the share.

    Each label keeps its rows below a hash cutoff of (its part / its count), so no row is sorted or moved to choose;
    the number kept is its part give or take a few of its square root, which bounds what callers broadcast.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    each = most / max(1, len(counts))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (draw < int((1 << 30) * min(1.0, each / n))))
    return rows.filter(keep)
