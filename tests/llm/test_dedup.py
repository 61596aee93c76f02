"""Exact, substring and near dedup against brute force, with nulls, empty and long texts, ties and clashing columns."""

import random

import numpy as np
import pytest

from rankloom.llm import exact_dedup, simhash, substring_dedup
from tests.llm import brute


def corpus(seed=1, n=60, vocab=300):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(vocab)
    passages = [[word() for _ in range(70)] for _ in range(3)]
    docs = []
    for i in range(n):
        body = [word() for _ in range(rng.choice([0, 3, 40, 120]))]
        if rng.random() < 0.4:
            k = rng.randrange(len(body) + 1)
            body[k:k] = rng.choice(passages)
        docs.append((i, (rng.choice([" ", "\n", "\t "])).join(body)))
    docs += [(n, docs[4][1]), (n + 1, None), (n + 2, ""), (n + 3, "rep " * 300), (n + 4, "rep " * 200), (n + 5, "  " + docs[4][1] + " "), (n + 6, "Mixed CASE Wörds ñandú 中文 a b c"), (n + 7, "mixed case wörds ñandú 中文 a b c")]
    near = docs[3 if len(docs[3][1]) > 50 else 6][1].split()
    docs.append((n + 8, " ".join(near[:-1])))
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame([(i, t, i, "x", None) for i, t in rows], "doc_id long, text string, row long, keep_id string, h string").repartition(5)


def test_exact(docs):
    rows, df = docs
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == brute.exact(rows)


def test_exact_spills_and_repeated_rows(spark):
    rows = [(i, "common prefix " + "abc"[i % 3] * (i % 50) + str(i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(df, trie_bytes=4000).collect()}
    assert got == brute.exact(rows)
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(twice).collect()) == [("1", 1, 3, False), ("1", 1, 3, True), ("None", 1, 3, False)]


def test_trie_keeps_every_string():
    rng = random.Random(2)
    trie, want = exact_dedup.PatriciaTrie(lambda a, b: a + b, budget=3000), {}
    for _ in range(2000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12)))
        trie.insert(key, 1)
        want[key] = want.get(key, 0) + 1
    got = {}
    for k, v in trie.items():
        assert k not in got
        got[k] = v
    assert got == want


@pytest.mark.parametrize("group_segments", [20_000, 2])
def test_substring(docs, group_segments):
    rows, df = docs
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df, group_segments=group_segments).collect()}
    assert got == brute.substring(rows)


def test_sliding_argmin_is_leftmost():
    g = np.array([3, 1, 1, 2, 0, 5, 0, 7], np.uint64)
    assert substring_dedup.sliding_argmin(g, 3).tolist() == [int(k + np.argmin(g[k : k + 3])) for k in range(6)]


def test_simhash(docs):
    rows, df = docs
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(df).collect()}
    fps = {i: brute.simhash(t) for i, t in rows}
    assert {i: v[0] for i, v in got.items()} == fps
    assert {i: v[1] for i, v in got.items()} == brute.components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)


def test_links_match_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 5))))
    fps = sorted(fps)
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, root long")
    found = {r.node: r.component for r in simhash.connected_components(simhash.fingerprint_links(nodes)).collect()}
    want = brute.components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {k: found.get(k, k) for k in range(len(fps))} == want


def test_large_bucket_is_parted():
    rng = np.random.default_rng(3)
    low = np.unique(rng.integers(0, 1 << 14, 6000).astype(np.uint64))
    found = simhash.links_in_bucket(low, simhash.pivots(8), 2, (1 << 14) - 1)
    parent = list(range(len(low)))
    for i, j in found:
        while parent[i] != i:
            i = parent[i]
        while parent[j] != j:
            j = parent[j]
        parent[max(i, j)] = min(i, j)
    assert len(found) < len(low) and sum(parent[k] == k for k in range(len(low))) == 1


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(e).count() == 0
    assert substring_dedup.substring_dedup(e).count() == 0
    assert simhash.simhash_components(e).count() == 0


def test_substring_on_repeated_rows_and_a_hot_document(spark):
    """Thousands of repeated rows, null ids, and one document that repeats an anchor thousands of times: linear and right."""
    rng = random.Random(11)
    passage = ["p%d" % k for k in range(60)]
    rows = [(1, " ".join(passage)), *[(2, "x " + " ".join(passage))] * 3000, (None, " ".join(passage)), *[(None, None)] * 3]
    loop = [w for _ in range(3000) for w in (*passage[:12], "v%d" % rng.randrange(9), "v%d" % rng.randrange(9))]
    rows += [(3, " ".join(loop)), (4, "y " + " ".join(loop[:4000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.substring([(1, rows[0][1]), (2, rows[1][1]), (3, rows[-2][1]), (4, rows[-1][1])])
    for most in (20_000, 50):
        got = [(r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in substring_dedup.substring_dedup(df, group_segments=most, with_text=False).collect()]
        assert len(got) == len(rows) and {i: v for i, v in got if i is not None} == want
        assert all(v[1] == 0 for i, v in got if i is None)


def test_head_ranks_order_suffixes():
    rng = random.Random(6)
    tokens = [rng.randrange(3) for _ in range(400)]
    ranks = substring_dedup.head_ranks(np.array(tokens), 7).tolist()
    heads = [tokens[k : k + 7] for k in range(len(tokens) - 7)]
    assert all((heads[a] < heads[b], heads[a] == heads[b]) == (ranks[a] < ranks[b], ranks[a] == ranks[b]) for a in range(len(heads)) for b in range(0, len(heads), 5))
