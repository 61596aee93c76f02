r"""Exact dedup with Patricia-trie owners.

Each input partition inserts its normalised texts into a compressed radix trie, so a text leaves the partition once,
however many copies stand in it. These local owners are dealt by length and content hash; each such partition inserts
the full byte strings into a trie again, whose terminal nodes hold the smallest identifier and the number of copies.
What a document learns comes back by a join on (input partition, hash), a key that no hot text can dominate.
A trie over its memory budget spills whole subtrees to a scratch file of the task and finishes them one by one; the file
ends with the task, and a lost task starts anew from its input.

Defined results: null text counts as empty; runs of [\x20\x09-\x0D] become one space (nothing is trimmed); of rows
with equal text and equal doc_id exactly one is kept; a null doc_id sorts after all others; an empty table gives no
row; a text of any length is one key (a row must hold it); bytes that are not UTF-8 are compared as they stand; other
columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import in_slots, materialize, pick, slot_table, small_batches

_SPACE = b" \t\n\x0b\x0c\r"
#: Rough cost of a node beside its label, in bytes.
_NODE = 280


class _Node:
    __slots__ = ("label", "kids", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.kids, self.value = label, None, value


class PatriciaTrie:
    """Compressed radix trie from byte strings to values; merge(old, new) joins the values of equal strings.

    Over `budget` bytes the largest subtree below the shared prefix goes to a scratch file, with all later strings
    that start with its path; items() reads every spilled subtree back into a trie of its own.
    """

    def __init__(self, merge: Callable, budget: int = 96 << 20):
        self.merge, self.budget = merge, budget
        self.root, self.size, self.spilled = _Node(b""), 0, {}

    def insert(self, key: bytes, value) -> None:
        for prefix, file in self.spilled.items():
            if key.startswith(prefix):
                pickle.dump((key, value), file, protocol=5)
                return
        node, at, n = self.root, 0, len(key)
        while at < n:
            if node.kids is None:
                node.kids = {}
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = _Node(key[at:], value)
                self.size += _NODE + n - at
                break
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            k = _shared(label, key, at)
            upper = _Node(label[:k])
            upper.kids = {label[k]: kid}
            node.kids[label[0]] = upper
            kid.label = label[k:]
            self.size += _NODE
            node, at = upper, at + k
        else:
            node.value = value if node.value is None else self.merge(node.value, value)
        if self.size > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Move the largest subtree below the first branching node to disk."""
        node, path = self.root, b""
        while node.value is None and node.kids and len(node.kids) == 1:
            node = next(iter(node.kids.values()))
            path += node.label
        if not node.kids:
            self.budget *= 2  # a single string: there is nothing to part
            return
        sizes = {b: sum(_NODE + len(x.label) for x, _ in _walk(kid, b"")) for b, kid in node.kids.items()}
        byte = max(sizes, key=sizes.get)
        file = tempfile.TemporaryFile()
        for x, key in _walk(node.kids.pop(byte), path):
            if x.value is not None:
                pickle.dump((key, x.value), file, protocol=5)
        self.spilled[path + bytes([byte])] = file
        self.size -= sizes[byte]

    def items(self) -> Iterator[tuple[bytes, object]]:
        for x, key in _walk(self.root, b""):
            if x.value is not None:
                yield key, x.value
        self.root = _Node(b"")
        for file in self.spilled.values():
            file.seek(0)
            part = PatriciaTrie(self.merge, self.budget)
            while True:
                try:
                    part.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from part.items()
        self.spilled = {}


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:], by halving."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def _walk(node: _Node, path: bytes) -> Iterator[tuple[_Node, bytes]]:
    todo = [(node, path)]
    while todo:
        x, before = todo.pop()
        path = before + x.label
        yield x, path
        if x.kids:
            todo += [(kid, path) for kid in x.kids.values()]


def normalise(text: bytes) -> bytes:
    """One space for each run of ASCII white space."""
    if not text:
        return text
    out = b" ".join(text.split())
    if text[0] in _SPACE:
        out = b" " + out
    if text[-1] in _SPACE and len(out) and out != b" ":
        out += b" "
    return out


_LOCAL = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("sha", pa.binary()), ("copies", pa.int64()), ("text", pa.binary()), ("raw", pa.string())])
_OWNED = pa.schema([("part", pa.int32()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_FAR = 1 << 63


def _least(a: tuple, b: tuple) -> tuple:
    return a if (_FAR if a[0] is None else a[0], a[1]) <= (_FAR if b[0] is None else b[0], b[1]) else b


def _merge_local(a, b):
    return (_least(a[0], b[0]), a[1] + b[1], a[2])


def _merge_owner(a, b):
    a[2].extend(b[2])
    return (_least(a[0], b[0]), a[1] + b[1], a[2])


def _batched(schema: pa.Schema, items: Iterator[tuple], weight: Callable, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in items:
        held.append(x)
        size += weight(x)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _local(budget: int):
    def run(batches):
        part, trie, row = TaskContext.get().partitionId(), PatriciaTrie(_merge_local, budget), 0
        for batch in batches:
            marks, first = batch.column(2).to_pylist(), 0
            for ids, texts in small_batches(batch):
                out = []
                for i, t, mark in zip(ids, texts, marks[first:]):
                    text = normalise(t)
                    sha = hashlib.sha256(text).digest()
                    at = (part << 40) + row
                    trie.insert(text, ((i, at), 1, sha))
                    out.append((i, at, part, sha, None, None, mark))
                    row += 1
                first += len(ids)
                yield from _batched(_LOCAL, iter(out), lambda x: 100)
        found = ((who[0], who[1], part, sha, n, text, None) for text, (who, n, sha) in trie.items())
        yield from _batched(_LOCAL, found, lambda x: 100 + len(x[5]))

    return run


def _owners(budget: int):
    def run(batches):
        trie = PatriciaTrie(_merge_owner, budget)
        for batch in batches:
            for i, row, part, sha, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert(text, ((i, row), n, [(part, sha)]))
        found = ((part, sha, who[0], who[1], n) for _, (who, n, parts) in trie.items() for part, sha in parts)
        yield from _batched(_OWNED, found, lambda x: 80)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 96 << 20, raw: Column | None = None) -> DataFrame:
    """One row per document: doc_id, row (a stable row number), keep_id, group_size, kept, text_sha256, raw (any string that the caller gives its rows)."""
    flat = "doc_id long, row long, part int, sha binary, copies long, text binary, raw string"
    given = pick(docs.withColumn("_rankloom_raw", raw if raw is not None else F.lit(None).cast("string")), id_col, text_col, "_rankloom_raw")
    local = materialize(given.mapInArrow(_local(trie_bytes), flat), "exact-local")
    owners = (
        local.filter("copies is not null").drop("raw")
        .repartition(F.length("text"), F.col("sha"))
        .mapInArrow(_owners(trie_bytes), "part int, sha binary, keep_id long, keep_row long, group_size long")
    )
    mine = local.filter("copies is null").select("doc_id", "row", "part", "sha", "raw")
    return mine.join(owners, ["part", "sha"]).select(
        "doc_id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "raw"
    )


def op1_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""


def dedup_stage(spark, docs, sf_dir):
    """Pipeline stage: of equal texts the row with the smallest doc_id stays; columns unchanged.

    The kept row is found again by its doc_id and the hash of its bytes as they stand, so a null doc_id can stay, texts
    that are not UTF-8 are parted like any other, and of rows equal in both one stays: the window runs over kept rows
    alone, on the join's own partitioning. Only texts that have copies are asked for: a bit table of their hashes parts
    the documents that surely have none, and those are not shuffled.
    """
    marks = ["_rankloom_raw", "_rankloom_id", "_rankloom_null"]
    raw = F.sha2(F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")), 256)
    tagged = docs.select("*", raw.alias(marks[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(marks[1]), F.isnull("doc_id").alias(marks[2]))
    several = materialize(exact_dedup(docs, raw=raw).filter("group_size > 1").select(F.col("raw").alias(marks[0]), F.coalesce("doc_id", F.lit(0)).alias(marks[1]), F.isnull("doc_id").alias(marks[2]), "kept"), "exact-copies")
    slot = F.xxhash64(marks[0])
    copied = in_slots(slot_table(several.select(slot.alias("slot")), "slot"), slot)
    one = F.row_number().over(W.partitionBy(*marks).orderBy(marks[0]))
    flags = several.groupBy(*marks).agg(F.max("kept").alias("_rankloom_kept"))
    asked = tagged.filter(copied).join(flags, marks, "left").withColumn("_rankloom_n", one).filter("_rankloom_kept IS NULL OR (_rankloom_kept AND _rankloom_n = 1)")
    return tagged.filter(~copied).select(*docs.columns).union(asked.select(*docs.columns))
