r"""SimHash near-duplicates with pivot distance tables.

Fingerprints: A-Z lower-cased, words [^\x20\x09-\x0D]+, 3-word shingles with repeats, XXH64 with seed 42; a bit is 1
if it is set in over half the hashes. Linking: equal fingerprints collapse to one node first (copies never meet in
pairs). A node's distances to block-structured references are its bits by block, so two nodes within `radius` agree
exactly on all but `radius` of the blocks: each choice of agreeing blocks is a bucket key. Inside a bucket a table of
Hamming distances to many reference fingerprints is computed once; a pair is discarded when any coordinate differs by
more than the radius, and what survives is verified by its own distance. A bucket hands on a spanning forest of its
links (at most its size; a bucket holds distinct fingerprints that share three of five blocks, 2^26 at most),
and alternating large-star and small-star joins turn the links into components.

Defined results: null text counts as empty; fewer than 3 words: the whole sequence is the shingle; none: fingerprint 0,
which links like any other; repeated rows each get their row; a null doc_id gets a row and never names a component
unless its component has no other id; a text of any length is one fingerprint; bytes that are not UTF-8 are ordinary
word characters; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import discard, in_slots, materialize, pick, slot_table, small_batches
from rankloom.operators.components import connected_components

_FP = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, in order and with repeats."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.array([digest(flat[a:b], 42) for a, b in spans], np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    h = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            marks, first = batch.column(2), 0
            for ids, texts in small_batches(batch):
                fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), marks.slice(first, len(ids)), pa.array(fps)], schema=_FP)
                first += len(ids)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, mark: Column | None = None) -> DataFrame:
    """doc_id, mark (any number that the caller gives its rows), fp."""
    given = docs.withColumn("_rankloom_mark", mark if mark is not None else F.lit(None).cast("long"))
    return pick(given, id_col, text_col, "_rankloom_mark").mapInArrow(_fingerprints(shingle), "doc_id long, mark long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of blocks - radius agreeing blocks of the 64 bits, as signed 64-bit numbers."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [int(np.array(sum(c), np.uint64).view(np.int64)) for c in combinations(parts, blocks - radius)]


def pivots(count: int) -> np.ndarray:
    """Fixed reference fingerprints, spread by a counter's hash."""
    return np.array([xxhash.xxh64_intdigest(str(k).encode(), 7) for k in range(count)], np.uint64)


def links_in_bucket(fps: np.ndarray, refs: np.ndarray, radius: int, free: int, block: int = 512):
    """Spanning forest (pairs of positions) of the links in one bucket of distinct fingerprints.

    free: mask of the bits that may differ. A large bucket is parted again by a third of its free bits at a time:
    a pair within the radius agrees on one part at least as long as there are more parts than differing bits.
    """
    n = len(fps)
    parent = np.arange(n)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def join(i, j):
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    def compare(at: np.ndarray) -> None:
        x = fps[at]
        rows = np.stack([np.bitwise_count(x ^ p) for p in refs], axis=1).astype(np.int16)
        order = np.lexsort((x, rows[:, 0]))
        at, x, rows = at[order], x[order], rows[order]
        first = rows[:, 0]
        for s in range(0, len(at), block):
            e = min(s + block, len(at))
            stop = np.searchsorted(first, first[e - 1] + radius, "right")
            i, j = np.nonzero(np.abs(first[s:e, None] - first[None, s:stop]) <= radius)
            keep = j > i
            i, j = i[keep] + s, j[keep] + s
            for c in range(1, rows.shape[1], 4):  # coordinate by coordinate: most pairs fall early
                near = (np.abs(rows[i, c : c + 4] - rows[j, c : c + 4]) <= radius).all(axis=1)
                i, j = i[near], j[near]
                if not len(i):
                    break
            good = np.bitwise_count(x[i] ^ x[j]) <= radius
            for p, q in zip(at[i[good]].tolist(), at[j[good]].tolist()):
                join(p, q)

    def part(at: np.ndarray, free: int) -> None:
        bits = [b for b in range(64) if free >> b & 1]
        if len(at) <= 3000 or len(bits) <= radius + 1:
            return compare(at)
        for k in range(radius + 1):
            own = sum(1 << b for b in bits[k :: radius + 1])
            key = fps[at] & np.uint64(own)
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(at[order], cut):
                if len(group) > 1:
                    part(group, free & ~own)

    part(np.arange(n), free)
    return out


def _links(masks: list[int], radius: int, count: int):
    def run(batches):
        refs = pivots(count)

        def flush(c, fps, roots):
            if len(fps) < 2:
                return None
            free = ~masks[c] & ((1 << 64) - 1)
            found = links_in_bucket(fps.view(np.uint64), refs, radius, free)
            if not found:
                return None
            i, j = np.array(found).T
            a, b = np.minimum(roots[i], roots[j]), np.maximum(roots[i], roots[j])
            return pa.RecordBatch.from_arrays([pa.array(b), pa.array(a)], schema=_EDGE)

        held: list[tuple] = []  # the pieces of the last bucket, put together once it is whole

        def whole():
            c, key, fp, root = (np.concatenate(x) for x in zip(*held))
            return flush(int(c[0]), fp, root)

        for batch in batches:
            cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            c, key, fp, root = cols
            if not len(c):
                continue
            bounds = [0, *(np.flatnonzero((np.diff(c) != 0) | (np.diff(key) != 0)) + 1).tolist(), len(c)]
            if held and (held[-1][0][-1], held[-1][1][-1]) != (c[0], key[0]):
                if (out := whole()) is not None:
                    yield out
                held = []
            for s, e in zip(bounds, bounds[1:]):
                if s and held:
                    if (out := whole()) is not None:
                        yield out
                    held = []
                if e < len(c) and not held:
                    if e - s > 1 and (out := flush(int(c[s]), fp[s:e], root[s:e])) is not None:
                        yield out
                else:
                    held.append(tuple(x[s:e] for x in cols))
        if held and (out := whole()) is not None:
            yield out

    return run


def fingerprint_links(nodes: DataFrame, radius: int = 2, blocks: int = 5, n_pivots: int = 32) -> DataFrame:
    """Links a > b between nodes (fp, root) whose fingerprints differ in at most `radius` bits, as spanning forests by bucket."""
    masks = block_masks(blocks, radius)
    keyed = nodes.select("fp", "root", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "key"))
    dealt = keyed.select("c", "key", "fp", "root").repartition("c", "key").sortWithinPartitions("c", "key")
    return dealt.mapInArrow(_links(masks, radius, n_pivots), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, blocks: int = 5, n_pivots: int = 32, mark: Column | None = None) -> DataFrame:
    """One row per document: doc_id, mark (as in fingerprints), fp (signed 64 bits), component_id."""
    each = materialize(fingerprints(docs, id_col, text_col, shingle, mark), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("root")), "nodes")
    found = connected_components(fingerprint_links(nodes.filter("root is not null"), radius, blocks, n_pivots))
    named = nodes.join(found, nodes["root"] == found["node"], "left").select("fp", F.coalesce("component", "root").alias("component_id"))
    return each.join(named, "fp").select("doc_id", "mark", "fp", "component_id")


def op9_simhash_neardup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def neardup_stage(spark, docs, sf_dir):
    """Pipeline stage: of each component the rows of its smallest doc_id's texts stay, the others go; a null doc_id stays; columns unchanged.

    Documents are linked by operator 9: fingerprints, block keys, pivot distance tables, 2 bits. An exact check follows,
    since near copies of a few changed words lie further apart: all pairs of a Jaccard similarity of 0.8 or more of their
    five-word shingles are links too, and both kinds join into one set of components. Rows are judged by doc_id and text
    together, so rows that share an id do not judge each other. A bit table parts the documents that surely stay, so only
    the others' texts are shuffled.
    """
    from rankloom.llm.jaccard import jaccard_components, text_mark

    tagged = docs.withColumn("_rankloom_text", text_mark("text"))
    by_bits = materialize(simhash_components(docs, mark=text_mark("text")).filter("doc_id IS NOT NULL").select("doc_id", "mark", F.col("component_id").alias("a")).distinct(), "by-bits")
    by_sets = jaccard_components(docs).filter("doc_id IS NOT NULL").select("doc_id", "mark", F.col("component_id").alias("b")).distinct()
    both = materialize(by_bits.join(by_sets, ["doc_id", "mark"]), "by-both")
    discard(by_bits)
    joined = connected_components(both.select("a", "b"))
    each = both.join(joined, both["b"] == joined["node"], "left").select("doc_id", "mark", F.coalesce("component", "b").alias("component_id"))
    gone = materialize(each.filter("doc_id <> component_id").select(F.col("doc_id").alias("_rankloom_id"), F.col("mark").alias("_rankloom_mark")).distinct(), "gone")
    named = in_slots(slot_table(gone, "_rankloom_mark"), F.col("_rankloom_text"))
    some = tagged.filter(named)
    out = some.join(gone, (some["doc_id"].cast("long") == gone["_rankloom_id"]) & (some["_rankloom_text"] == gone["_rankloom_mark"]), "left_anti")
    return tagged.filter(~named).union(out).select(*docs.columns)
