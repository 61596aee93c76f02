"""Best-fit packing: exact on small sets, whole round trips, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import bin_completion as B


def fewest(sizes, capacity):
    """Fewest sequences, by trying every place of every piece."""
    best, sizes = [len(sizes)], sorted(sizes, reverse=True)

    def go(i, rooms):
        if len(rooms) < best[0]:
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= sizes[i]:
                    go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
            go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_search_without_limits_is_exact_and_beats_best_fit():
    won = 0
    for seed in range(300):
        rng = random.Random(seed)
        capacity = rng.choice([20, 50, 100])
        sizes = [rng.randint(1 if seed % 2 else capacity // 5, capacity * 2 // 3) for _ in range(rng.randint(1, 9 + seed % 3))]
        counts = np.bincount(sizes, minlength=capacity + 1).tolist()
        found = B.bin_completion(counts, capacity, None, None, None)
        assert len(found) == fewest(sizes, capacity) >= B.lower_bound(counts, capacity)
        assert sorted(s for f in found for s in f) == sorted(sizes) and all(sum(f) <= capacity for f in found)
        won += len(found) < len(B.best_fit_decreasing(counts, capacity))
    assert won > 0


def test_limited_search_improves_large_sets_and_places_every_piece():
    lengths = np.random.default_rng(1).integers(400, 1100, 3000)
    at, offsets = B.place(lengths, 2048)
    counts = np.bincount(lengths, minlength=2049).tolist()
    assert B.lower_bound(counts, 2048) <= at.max() + 1 < len(B.best_fit_decreasing(counts, 2048))
    for k in range(at.max() + 1):
        own = np.flatnonzero(at == k)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()] and lengths[own].sum() <= 2048


def test_dominance():
    assert B.dominates((5, 3), (5, 2, 1)) and B.dominates((6,), (3, 2)) and not B.dominates((4, 4), (5, 1)) and not B.dominates((2, 2), (4,))


ODD = [
    "it's  <|endoftext|> x", "a b\x1cc d", "İstanbul ŉa ǅ", "café ÉCOLE. ...", "they're'll 12%.", "ab́. ́x", "ªº x² ..", '"quoted".', "<|startoftext|>y", "ſ ﬁ. Σας ΣΑΣ.",
    "é.", "a'S b'T", "", None, " \n\t ", "x" * 100_000, "word, " * 60_000, "tie tie", "tie tie", "tie tie",
]


def test_round_trip_of_odd_texts(spark):
    """Every id of every row lies in one piece, in whole cuts; sequences are gapless; a row that is not UTF-8 counts too."""
    rows = [(i if i < 17 else None if i == 17 else 5, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.range(1).select(F.lit(77).cast("long"), F.expr("cast(X'61FF6220FE' as string)")))
    docs = docs.withColumns({c: F.lit("x") for c in ("piece", "row", "grp", "length")})
    got = [r.asDict() for r in B.pack_best_fit(docs.repartition(3), B.default_tokenizer(), group_pieces=8).collect()]
    model = Tokenizer.from_file(B.default_tokenizer())
    want = []
    for i, t in [*rows, (77, "a�b �")]:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 2048
    assert B.pack_best_fit(docs.filter("doc_id = 99"), B.default_tokenizer()).count() == 0


@pytest.mark.parametrize("table", ["sf0.001"])
def test_query_meets_the_lower_bound(spark, table):
    got = B.op13_best_fit_packing(spark, f"/root/testdata/{table}").toPandas()
    counts = np.bincount(got["length"], minlength=2049).tolist()
    assert got["sequence_id"].nunique() == B.lower_bound(counts, 2048)
