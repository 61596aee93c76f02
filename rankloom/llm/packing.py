"""Packing by first-fit decreasing over a tournament tree of bin capacities.

Documents become token ids; each is cut every `length` ids, so all pieces but the last are whole sequences. Pieces are
dealt to randomised groups of documents (a keyed hash of doc_id; the number of groups follows the number of documents),
and each group runs first-fit decreasing by itself: a tournament tree holds the largest free capacity below each node,
so the leftmost bin that fits is found in log(bins) steps. Only piece descriptions are shuffled, never texts or ids.

Ids come from the tokenizer by white-space-bounded pieces of text: a byte-level BPE never merges across a single space
or line feed between non-space characters, so cached pieces joined give exactly the ids of the whole text. Texts with
other white space, or runs of it, are encoded in chunks cut only at such safe places.

Defined results: null text counts as empty and still gives the end id; repeated rows are packed each; ties in length
fall to the smaller (doc_id, start); an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import pick, small_batches

_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
_PLACED = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SIGNS = ".,;:!?%&*#$|)]}\"/-+=~"  # signs after a letter or digit are tokens of their own, so a word and its signs are encoded apart
#: Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on, in order.
_BYTE_CHARS = {b: chr(b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else 256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174) for x in range(b))) for b in range(256)}
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Token ids as little-endian uint32 bytes, by a cache of pieces in two generations of at most `most` entries each.

    A full young generation becomes the old one; a piece found in the old one is young again, so frequent pieces stay.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.most, self.cache, self.old = Tokenizer.from_file(path), most, {}, {}

    def _fill(self, missing: list[str]) -> None:
        rest, word = [], self.model.model.tokenize
        for w in missing:
            if w.lstrip(" ").isalpha():  # letters after at most one space are one pre-token: straight to the merges
                self.cache[w] = array("I", [t.id for t in word(w.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            else:
                rest.append(w)
        for k in range(0, len(rest), 5000):
            part = rest[k : k + 5000]
            for w, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[w] = array("I", e.ids).tobytes()

    def _chunks(self, text: str, size: int = 1 << 15) -> bytes:
        """Ids of a text with odd white space, encoded in chunks of about `size` characters cut at safe spaces."""
        out, a = [], 0
        while a < len(text):
            m = _SAFE.search(text, a + size)
            b = m.start() if m else len(text)
            out.append(np.array(self.model.encode(text[a:b], add_special_tokens=False).ids, "<u4").tobytes())
            a = b
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for t in texts:
            odd = "\x01" in t or "  " in t or "\n\n" in t or " \n" in t or "\n " in t or _OTHER_SPACE.search(t)
            split.append(None if odd else t.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01"))
        wanted = set().union(*(s for s in split if s))
        missing = [w for w in wanted if w not in self.cache]
        if len(self.cache) + len(missing) > self.most:
            self.cache, self.old, missing = {}, self.cache, list(wanted)
        unknown = []
        for w in missing:
            ids = self.old.get(w)
            if ids is None:
                unknown.append(w)
            else:
                self.cache[w] = ids
        cores = {}
        for w in unknown:
            core = w.rstrip(_SIGNS)
            cores[w] = (core, w[len(core) :]) if core and core[-1].isalnum() and len(core) < len(w) else (w, "")
        parts = {x for pair in cores.values() for x in pair if x and x not in self.cache}
        self._fill([x for x in parts if x not in self.old])
        self.cache.update((x, self.old[x]) for x in parts if x in self.old)
        self.cache[""] = b""
        self.cache.update((w, self.cache[a] + self.cache[b]) for w, (a, b) in cores.items() if b)
        get = self.cache.__getitem__
        return [self._chunks(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _pieces(path: str, length: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = _encoder(path)
        for batch in batches:
            for ids, texts in small_batches(batch, 1 << 20):
                out = []
                for i, tokens in zip(ids, enc.encode([t.decode("utf-8", "replace") for t in texts])):
                    tokens += end
                    n = len(tokens) // 4
                    for s in range(0, n, length):
                        cut = tokens[4 * s : 4 * (s + length)]
                        out.append((i, s, len(cut) // 4, zlib.crc32(cut), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_PIECE)

    return run


class TournamentTree:
    """Free capacity of bins in order; first(size) is the leftmost bin with room, opening a new one if none has."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """Put size into the leftmost bin with room: (bin, offset in it)."""
        best, k = self.best, 1
        while k < self.leaves:
            k *= 2
            if best[k] < size:
                k += 1
        offset = self.capacity - best[k]
        at = k - self.leaves
        best[k] -= size
        k //= 2
        while k:
            new = best[2 * k] if best[2 * k] >= best[2 * k + 1] else best[2 * k + 1]
            if best[k] == new:
                break
            best[k] = new
            k //= 2
        return at, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; sizes are taken in decreasing order, ties in the order given."""
    tree, bins, offsets = TournamentTree(max(1, len(sizes)), capacity), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        bins[k], offsets[k] = tree.place(int(sizes[k]))
    return bins, offsets


def _pack(length: int):
    def run(key, group):
        group = group.select(_PIECE.names).sort_by([("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), length)
        group = group.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 36)))
        return group.append_column("offset", pa.array(offsets)).cast(_PLACED)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, group_docs: int = 20_000, seed: int = 17) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    group_docs: documents in a randomised group, on average; a group's piece descriptions fit in one task.
    """
    picked = pick(docs, id_col, text_col)
    groups = max(1, -(-picked.count() // group_docs))
    pieces = picked.mapInArrow(_pieces(tokenizer_path, length, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.col("doc_id"), F.col("doc_tokens"), F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())


def packing_stage(spark, docs, sf_dir):
    """Pipeline stage, the last: pieces of packed sequences."""
    return pack(docs, default_tokenizer())
