r"""Substring dedup with prefix-partitioned suffix trees.

A window is `window` consecutive words. The prefix that parts the suffixes is the window's anchor: the smallest hash
among its runs of `gram` words (leftmost on ties), a function of the window's words alone, so equal windows meet under
equal anchors. Consecutive windows with one anchor travel as one segment, about a twentieth of the words; an anchor
that stands in a single document cannot repeat across documents and is dropped before any text moves. What is left is
dealt by anchor. A task takes whole anchor groups of about a million words and ranks their suffixes by doubling; runs of
equal rank are the suffix tree's nodes at depth `window`, whose smallest document id judges every suffix below them, and
neighbouring suffixes below such nodes join to maximal repeats.

Prefixes vary in length with the group: one of over `group_segments` segments (counted within documents too) takes the
longest prefix there is, the whole window, as its 128-bit hash. Under it a group is a single node, so all that is left
to find is its smallest document: Spark pre-aggregates that on the map side and joins it back, and no task holds a hot
passage. Both ways give the same rows; a test runs the shorter prefixes against the longest.

Defined results: null text has no words; a null doc_id loses nothing and makes nobody lose a word; rows with equal
doc_id never count as smaller than each other; repeated rows get equal results; documents under `window` words stay
whole; a text of any length is one unit (a row must hold it); bytes that are not UTF-8 are ordinary word characters; an
empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, pick

_MULT = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """64-bit hash by word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h


_memo = _WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of `gram` words, mixed so that its order is as good as random."""
    out = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        out = out * _MULT + h[k : k + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def sliding_argmin(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each run of `width` values, by doubling."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        have += step
    return at


def segments(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of the maximal runs of windows with one anchor."""
    g = gram_hashes(h, gram)
    at = sliding_argmin(g, window - gram + 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    return g[at[first]], first, np.diff(np.append(first, len(at)))


_ANCHORS = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("h", pa.list_(pa.int64())), ("at", pa.list_(pa.list_(pa.int32())))])


def _anchors(window: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, xh, texts = (c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())))
            out, size = [], 0
            for i, x, t in zip(ids, xh, texts):
                words = t.split() if t else ()
                if i is None or len(words) < window:
                    continue
                h, s, n = segments(word_hashes(words), window, gram)
                spots: dict[int, list[int]] = {}
                for key, a, m in zip(h.view(np.int64).tolist(), s.tolist(), n.tolist()):
                    spots.setdefault(key, []).extend((a, m))
                out.append((i, x, list(spots), list(spots.values())))
                size += len(h)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ANCHORS)], schema=_ANCHORS)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ANCHORS)], schema=_ANCHORS)

    return run


_SEGMENT = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("xh", pa.int64()), ("s", pa.list_(pa.int32())), ("n", pa.int32()), ("hot", pa.bool_()), ("body", pa.binary())])
_SEGMENT_SQL = "h long, doc_id long, xh long, s array<int>, n int, hot boolean, body binary"


def _cut(window: int):
    """Texts with their live segments -> segments with their words."""

    def run(batches):
        for batch in batches:
            ids, xh, texts, live = (c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)))
            out, size = [], 0
            for i, x, t, found in zip(ids, xh, texts, live):
                words = t.split()
                same: dict[tuple, list[int]] = {}  # segments of one document with the same words travel once
                for f in found:
                    for s, n in zip(f["at"][::2], f["at"][1::2]):
                        same.setdefault((f["h"], n, f["hot"], b" ".join(words[s : s + n + window - 1])), []).append(s)
                for (h, n, hot, body), starts in same.items():
                    out.append((h, i, x, starts, n, hot, body))
                    size += len(body) + 60 + 4 * len(starts)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SEGMENT)], schema=_SEGMENT)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SEGMENT)], schema=_SEGMENT)

    return run


class _Vocabulary(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def head_ranks(tokens: np.ndarray, window: int) -> np.ndarray:
    """Rank of each suffix among all by its first `window` words, equal heads sharing one; by doubling.

    Ranks by heads of h words, taken at i and at i + step, order heads of h + step words, so log(window) sorts of
    numbers replace any sort of texts. Runs of equal ranks are the suffix tree's nodes at depth `window`.
    """
    rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while have < window:
        step = min(have, window - have)
        far = np.zeros(len(rank), np.int64)
        far[:-step] = rank[step:] + 1
        rank, have = np.unique(rank * (len(rank) + 2) + far, return_inverse=True)[1].astype(np.int64), have + step
    return rank


def deep_nodes(docs: np.ndarray, n: np.ndarray, bodies: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of each suffix below a node of depth `window` that a smaller document also reaches.

    Segment k is bodies[k] of document docs[k], with n[k] suffixes that have `window` words or more.
    """
    numbers = _Vocabulary().__getitem__
    split = [b.split(b" ") for b in bodies]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    tokens = np.fromiter(map(numbers, chain.from_iterable(split)), np.int64, int(lengths.sum()))
    rank = head_ranks(tokens, window)
    first = np.cumsum(lengths) - lengths
    segment = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    node, doc = rank[first[segment] + start], docs[segment]
    order = np.lexsort((doc, node))
    node, doc = node[order], doc[order]
    head = np.concatenate(([True], node[1:] != node[:-1]))
    least = doc[head][np.cumsum(head) - 1]
    found = np.sort(order[doc > least])
    return segment[found], start[found]


def maximal_runs(segment: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """Repeated suffixes that follow one another, as the repeat they make up together: (segment, first, number)."""
    if not len(segment):
        return []
    cut = np.concatenate(([0], np.flatnonzero((np.diff(segment) != 0) | (np.diff(start) != 1)) + 1))
    return list(zip(segment[cut].tolist(), start[cut].tolist(), np.diff(np.append(cut, len(segment))).tolist()))


_RANGE = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def _trees(window: int, words: int = 1 << 20):
    """Segments in order of their prefix -> repeated runs; whole prefix groups of about `words` words share one structure."""

    def solve(rows):
        ids, xh, starts, n, bodies = zip(*rows)
        found = deep_nodes(np.array(ids, np.int64), np.array(n, np.int64), list(bodies), window)
        out = [(ids[k], xh[k], s + j, m) for k, j, m in maximal_runs(*found) for s in starts[k]]
        for a in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a : a + 100_000]), _RANGE)], schema=_RANGE)

    def run(batches):
        last, group, held, size, docs = None, [], [], 0, set()
        for batch in batches:
            for h, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if h != last:
                    if len(docs) > 1:  # a prefix that one document alone holds repeats nowhere else
                        held += group
                        size += sum(r[3] + window for r in group)
                        if size > words:
                            yield from solve(held)
                            held, size = [], 0
                    last, group, docs = h, [], set()
                group.append(row)
                docs.add(row[0])
        if len(docs) > 1:
            held += group
        if held:
            yield from solve(held)

    return run


def _windows(body: bytes, n: int, window: int) -> list[bytes]:
    """The n windows of a segment's words."""
    ends = [-1]
    at = body.find(b" ")
    while at >= 0:
        ends.append(at)
        at = body.find(b" ", at + 1)
    ends.append(len(body))
    return [body[ends[k] + 1 : ends[k + window]] for k in range(n)]


_WINDOW = pa.schema([("k", pa.binary()), ("doc_id", pa.int64()), ("xh", pa.int64()), ("s", pa.list_(pa.int32()))])


def _whole_prefixes(window: int, rows: int = 20_000):
    """Segments -> their suffixes under the longest prefix, the whole window."""

    def run(batches):
        for batch in batches:
            out = []
            for i, x, s, n, body in zip(*(c.to_pylist() for c in batch.columns)):
                for j, w in enumerate(_windows(body, n, window)):
                    out.append((xxhash.xxh3_128_digest(w), i, x, [a + j for a in s]))
                    if len(out) >= rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _WINDOW)], schema=_WINDOW)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _WINDOW)], schema=_WINDOW)

    return run


def repeated_windows(docs: DataFrame, window: int = 50, gram: int = 10, group_segments: int = 20_000) -> DataFrame:
    """(doc_id, xh, s, n): runs of window starts whose words also start in a document with a smaller id; rows may repeat."""
    anchors = materialize(docs.mapInArrow(_anchors(window, gram), "doc_id long, xh long, h array<long>, at array<array<int>>"), "anchors")
    each = anchors.select("doc_id", "xh", F.explode(F.arrays_zip("h", "at")).alias("a")).select("doc_id", "xh", "a.h", "a.at")
    seen = each.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum(F.size("at") / 2).alias("c"))
    shared = materialize(seen.filter("lo < hi").select("h", (F.col("c") > group_segments).alias("hot")), "shared")  # a plain table: the join below can then split hot anchors
    live = each.join(shared, "h").groupBy("doc_id", "xh").agg(F.collect_set(F.struct("h", "at", "hot")).alias("live"))  # repeated rows give one list
    cut = materialize(docs.join(live, ["doc_id", "xh"]).mapInArrow(_cut(window), _SEGMENT_SQL), "segments")
    flat = "doc_id long, xh long, s int, n int"
    cold = cut.filter("not hot").select("h", "doc_id", "xh", "s", "n", "body").repartition("h").sortWithinPartitions("h")
    found = cold.mapInArrow(_trees(window), flat)
    hot = cut.filter("hot").select("doc_id", "xh", "s", "n", "body").mapInArrow(_whole_prefixes(window), "k binary, doc_id long, xh long, s array<int>")
    least = hot.groupBy("k").agg(F.min("doc_id").alias("lo"))
    return found.union(hot.join(least, "k").filter("doc_id > lo").select("doc_id", "xh", F.explode("s").alias("s"), F.lit(1).alias("n")))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary()), ("kept_sha256", pa.string())])


def _keep(window: int, text_too: bool):
    def run(batches):
        for batch in batches:
            ids, texts, found = (c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)))
            out, size = [], 0
            for i, t, runs in zip(ids, texts, found):
                words = t.split() if t else []
                n, removed = len(words), 0
                if runs:
                    steps = np.zeros(n + 1, np.int64)
                    for r in runs:
                        steps[r["s"]] += 1
                        steps[r["s"] + r["n"] + window - 1] -= 1
                    stay = np.cumsum(steps[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(stay).tolist()]
                    removed = n - len(words)
                kept = b" ".join(words)
                out.append((i, n, removed, kept if text_too else None, hashlib.sha256(kept).hexdigest()))
                size += 100 + len(kept) * text_too
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], schema=_KEPT)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], schema=_KEPT)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 10, group_segments: int = 20_000, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (null unless with_text), kept_sha256."""
    picked = pick(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("xh"), "text")
    runs = repeated_windows(picked, window, gram, group_segments).groupBy("doc_id", "xh").agg(F.collect_set(F.struct("s", "n")).alias("runs"))
    joined = picked.join(runs, ["doc_id", "xh"], "left").select("doc_id", "text", "runs")
    out = joined.mapInArrow(_keep(window, with_text), "doc_id long, n_words long, n_removed long, kept_text binary, kept_sha256 string")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def op4_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, with_text=False).drop("kept_text")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50),
g AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 49], ' ') AS body FROM s),
m AS (SELECT body, min(doc_id) AS lo FROM g GROUP BY body HAVING min(doc_id) < max(doc_id)),
r AS (SELECT g.doc_id, g.pos FROM g JOIN m ON g.body = m.body WHERE g.doc_id > m.lo),
gone AS (SELECT DISTINCT doc_id, pos + k AS i FROM (SELECT doc_id, pos, unnest(range(0, 50)) AS k FROM r)),
e AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS body, count(*) AS n FROM e ANTI JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
