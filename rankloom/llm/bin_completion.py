"""Best-fit packing by bin completion.

Documents become token ids; only those of more than `length` ids are cut, every `length` ids. Piece descriptions, never
texts or ids, are dealt to randomised groups of about `group_pieces` pieces, and each group is packed by branch and
bound: best-fit decreasing gives the first incumbent; a node takes the largest piece left and branches over the
undominated fillings of the room around it, least waste first; a branch ends when the waste so far leaves no better
packing than the incumbent; the search ends when the incumbent meets a lower bound. Sequences that the first incumbent
fills to the last id stay as they are; the search repacks the others, looks at `nodes_per_bin` nodes for each of them
and at `steps` partial fillings and `width` fillings a node, and beyond that the best packing found so far stands, with
every piece placed. With steps, width and nodes unbounded it searches all sequences and is exact.

Ids are put together from cached words: the pre-tokens of this tokenizer never hold white space, so the ids of a text
are those of its words, one after the other.

Defined results: null text counts as empty and still gives the end id; repeated rows are packed each, and are dealt by
their place in the input, so that no group holds more of them than of others; a null doc_id is a value like others; a
text of any length and a word of any length are encoded whole; bytes that are not UTF-8 become U+FFFD; an empty table
gives no row; other columns are not looked at.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import pick, small_batches

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "row"))])
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PLACED_NAMES = [x.split()[0] for x in _PLACED.split(", ")]
_SIGNS = b".,;:!?%&*#$|)]}\"/-+=~"  # a run of signs behind a letter or digit is a pre-token of its own
#: Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on, in order.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_encoders: dict = {}


class WordEncoder:
    """Token ids of a text as little-endian uint32 bytes, from a cache of at most twice `most` words in two generations."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.most, self.new, self.old = Tokenizer.from_file(path), most, {}, {}

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word that is one pre-token for certain, straight from the merges."""
        if word.isascii() or max(word) < "ɐ" and unicodedata.is_normalized("NFC", word):
            low = word.lower()
            if word.isalpha() and low.isalpha():
                return array("I", [t.id for t in self.model.model.tokenize(low.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
        return None

    def _learn(self, words: list[bytes], into: dict) -> None:
        rest = []
        for w in words:
            core = w.rstrip(_SIGNS)
            text = core.decode("utf-8", "replace")
            ids = self._letters(text) if core else None
            if ids is not None and len(core) < len(w):
                signs = w[len(core) :]
                if signs not in into:
                    into[signs] = array("I", self.model.encode(signs.decode(), add_special_tokens=False).ids).tobytes()
                ids += into[signs]
            if ids is None:
                rest.append(w)
            else:
                into[w] = ids
        for k in range(0, len(rest), 5000):
            part = rest[k : k + 5000]
            for w, e in zip(part, self.model.encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False)):
                into[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]  # ASCII white space only; other white space stays inside its word
        wanted = set().union(*split)
        missing = [w for w in wanted if w not in self.new]
        if len(self.new) + len(missing) > self.most:
            self.new, self.old, missing = {}, self.new, list(wanted)
        self.new.update((w, self.old[w]) for w in missing if w in self.old)
        self._learn([w for w in missing if w not in self.old], self.new)
        get = self.new.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in missing:
            if len(w) > 256:
                del self.new[w]
        return out


def _pieces(path: str, length: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for ids, texts in small_batches(batch, 1 << 20):
                out = []
                for i, tokens in zip(ids, enc.encode(texts)):
                    tokens += end
                    for k, s in enumerate(range(0, len(tokens), 4 * length)):
                        cut = tokens[s : s + 4 * length]
                        out.append((i, k, s // 4, len(cut) // 4, zlib.crc32(cut), row))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE_ARROW)], schema=_PIECE_ARROW)

    return run


def best_fit_decreasing(counts: list[int], capacity: int) -> list[list[int]]:
    """Fillings: each size, largest first, goes to the open sequence that it leaves least room in."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a sequence with room r is open
    for size in range(capacity, 0, -1):
        for _ in range(counts[size]):
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, k = capacity, len(bins)
                bins.append([])
            bins[k].append(size)
            if room > size:
                by_room.setdefault(room - size, []).append(k)
                rooms |= 1 << (room - size)
    return bins


def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences that any packing needs: by total, and with the sizes over half that can take no piece of at least k."""
    n = np.asarray(counts, np.int64)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    for k in range(1, half + 1):
        alone = count[capacity + 1] - count[capacity - k + 1]
        shared, shared_sum = count[capacity - k + 1] - count[half + 1], total[capacity - k + 1] - total[half + 1]
        small = total[half + 1] - total[k]
        best = max(best, int(alone + shared + max(0, -(-int(small - (shared * capacity - shared_sum)) // capacity))))
    return best


def dominates(a: tuple, b: tuple) -> bool:
    """Can the pieces of b be laid into those of a? Then a filling a is never worse than b."""
    if len(a) > len(b) or sum(a) < sum(b):
        return False
    free = list(a)

    def lay(k: int) -> bool:
        if k == len(b):
            return True
        tried = set()
        for i, room in enumerate(free):
            if room >= b[k] and room not in tried:
                tried.add(room)
                free[i] -= b[k]
                if lay(k + 1):
                    return True
                free[i] += b[k]
        return False

    return lay(0)


def fillings(counts: list[int], sizes: int, room: int, steps: int | None, width: int | None) -> list[tuple[int, tuple]]:
    """(waste, pieces) of undominated ways to fill room, least waste first. sizes: bit s is set while counts[s] > 0."""
    found: list[tuple[int, tuple]] = []
    smallest = (sizes & -sizes).bit_length() - 1 if sizes else room + 1
    todo: list[tuple[int, int, tuple]] = [(room, room, ())]
    while todo and (steps is None or steps > 0):
        left, most, taken = todo.pop()
        steps = None if steps is None else steps - 1
        low = sizes & ((1 << (min(left, most) + 1)) - 1)
        size = low.bit_length() - 1
        while size > 0 and taken.count(size) >= counts[size]:
            low &= (1 << size) - 1
            size = low.bit_length() - 1
        if size > 0:
            todo.append((left, size - 1, taken))  # later: without this size
            todo.append((left - size, size, (*taken, size)))
        elif left < smallest or not any(taken.count(s) < counts[s] for s in range(smallest, left + 1)):
            found.append((left, taken))
            if steps is not None and left == 0 and len(found) >= (width or 1):
                break
    if not found:  # out of steps before any filling was whole: the largest pieces first, as they fit
        left, taken, low = room, (), sizes
        while low := low & ((1 << (left + 1)) - 1):
            size = low.bit_length() - 1
            n = min(counts[size], left // size)
            left, taken, low = left - n * size, taken + (size,) * n, low & ((1 << size) - 1)
        found.append((left, taken))
    found.sort(key=lambda x: (x[0], len(x[1]), tuple(-s for s in x[1])))
    kept: list[tuple[int, tuple]] = []
    for way in found:
        if width is not None and len(kept) >= width:
            break
        if not any(dominates(other[1], way[1]) for other in kept):
            kept.append(way)
    return kept


def bin_completion(counts: list[int], capacity: int, nodes_per_bin: int | None = 4, steps: int | None = 300, width: int | None = 6) -> list[list[int]]:
    """Fillings of as few sequences as the search finds. counts: pieces of each size, 0 to capacity."""
    best, bound = best_fit_decreasing(counts, capacity), lower_bound(counts, capacity)
    if len(best) <= bound:
        return best
    if nodes_per_bin is not None and (full := [f for f in best if sum(f) == capacity]):
        rest = list(counts)
        for f in full:
            for s in f:
                rest[s] -= 1
        return full + bin_completion(rest, capacity, nodes_per_bin, steps, width)
    counts, total = list(counts), sum(s * n for s, n in enumerate(counts))
    sizes = sum(1 << s for s, n in enumerate(counts) if n and s)
    nodes = None if nodes_per_bin is None else nodes_per_bin * len(best)
    path: list[list] = []  # [ways still to try, largest, chosen pieces, waste up to here]
    waste = 0

    def move(largest: int, pieces: tuple, by: int) -> None:
        nonlocal sizes
        for s in (largest, *pieces):
            counts[s] += by
            sizes = sizes | 1 << s if counts[s] else sizes & ~(1 << s)

    forward = True
    while len(best) > bound and (nodes is None or nodes > 0):
        if forward and not sizes:
            best = [[f[1], *f[2]] for f in path]
            forward = False
        elif forward:
            nodes = None if nodes is None else nodes - 1
            largest = sizes.bit_length() - 1
            move(largest, (), -1)
            ways = fillings(counts, sizes, capacity - largest, steps, width)
            move(largest, (), 1)
            path.append([iter(ways), largest, None, waste])
        if path:
            frame = path[-1]
            if frame[2] is not None and not forward:
                move(frame[1], frame[2], 1)
                waste, frame[2] = frame[3], None
            allowed = (len(best) - 1) * capacity - total
            way = next((w for w in frame[0] if waste + w[0] <= allowed), None)
            if way is None:
                path.pop()
                forward = False
                if not path:
                    break
            else:
                frame[2] = way[1]
                move(frame[1], way[1], -1)
                waste += way[0]
                forward = True
    return best


def place(lengths: np.ndarray, capacity: int, **limits) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(capacity + 2))
    taken, at, offsets = ends[:-1].copy(), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, pieces in enumerate(bin_completion(np.diff(ends).tolist(), capacity, **limits)):
        offset = 0
        for s in pieces:
            i = order[taken[s]]
            taken[s] += 1
            at[i], offsets[i] = k, offset
            offset += s
    return at, offsets


def _pack(length: int, limits: dict):
    def run(key, group):
        group = group.sort_by([("row", "ascending")])
        at, offsets = place(group.column("length").to_numpy(), length, **limits)
        group = group.append_column("sequence_id", pa.array(at + (key[0].as_py() << 36))).append_column("offset", pa.array(offsets))
        return group.select(_PLACED_NAMES)

    return run


def pack_best_fit(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 0, group_pieces: int = 20_000, seed: int = 29, **limits) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    group_pieces: pieces of a randomised group, at most, on average; limits: those of bin_completion().
    """
    picked = pick(docs, id_col, text_col)
    most = picked.agg(F.sum(1 + F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / length))).first()[0] or 0  # an id stands for a byte at least
    groups = max(1, -(-most // group_pieces))
    pieces = picked.mapInArrow(_pieces(tokenizer_path, length, end_id), _PIECE)
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack(length, limits), _PLACED)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_best_fit_packing(spark, sf_dir):
    return pack_best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
