"""Near copies by shingle similarity against all pairs."""

import random

import numpy as np
import pytest

from rankloom.llm import jaccard, simhash
from tests.llm import brute


def shingles(text, k=5):
    w = brute.WORD.findall((text or "").lower().encode())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(seed=4):
    """Texts with near copies of similarity 0.75 to 0.97, a large family, a passage that many hold, short and odd rows."""
    rng = random.Random(seed)
    words = lambda n: ["w%d" % rng.randrange(5000) for _ in range(n)]
    passage, rows = words(30), []
    for _ in range(25):
        base = words(rng.choice([40, 90, 300]))
        rows.append(base)
        for share in (0.006, 0.015, 0.02, 0.03):
            copy = list(base)
            for k in rng.sample(range(len(base)), max(1, int(share * len(base)))):
                copy[k] = "x%d" % rng.randrange(5000)
            rows.append(copy)
    base = words(120)
    for _ in range(40):
        copy = list(base)
        for k in rng.sample(range(120), 2):
            copy[k] = "y%d" % rng.randrange(5000)
        rows.append(copy)
    rows += [passage + words(rng.choice([3, 8, 40])) for _ in range(40)]
    rows += [["a"], ["A"], ["a", "b"], [], [], words(4), words(5), words(6)]
    return [(i, " ".join(r)) for i, r in enumerate(rows)] + [(len(rows), None)]


@pytest.mark.parametrize("often, stars", [(100, 4), (3, 1)])
def test_components_match_all_pairs(spark, often, stars):
    rows = planted()
    sets = {i: shingles(t) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, often=often, stars=stars).collect()}
    assert got == brute.components(list(sets), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)


def test_stage_drops_near_copies(spark, sf_dir):
    """A copy with one or two changed words of 100 goes (similarity 0.81 to 0.9, many bits apart); one at 0.7 stays."""
    rng = random.Random(7)
    base = ["v%d" % rng.randrange(9000) for _ in range(100)]
    one, two, four = list(base), list(base), list(base)
    one[50] = "new"
    two[30], two[70] = "new", "other"
    four[10], four[30], four[50], four[70] = "p", "q", "r", "s"
    rows = [(1, " ".join(base), "k"), (2, " ".join(one), "k"), (3, " ".join(two), "k"), (4, " ".join(four), "k"), (None, " ".join(one), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = simhash.neardup_stage(spark, docs, sf_dir)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "None"]


def test_parity_bits_bound_the_difference():
    rng = random.Random(2)
    for _ in range(50):
        a = {rng.getrandbits(63) for _ in range(rng.randrange(0, 900))}
        b = set(list(a)[: rng.randrange(0, len(a) + 1)]) | {rng.getrandbits(63) for _ in range(rng.randrange(0, 300))}
        x, y = (jaccard.parity_bits(np.array(sorted(s), np.int64)) for s in (a, b))
        assert sum(int(v & (1 << 64) - 1).bit_count() for v in (x ^ y).tolist()) <= len(a ^ b)
