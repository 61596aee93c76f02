r"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of `window` words and become TF-IDF rows; inverse document frequencies count
every document of the corpus, by word bucket. The items are dealt by hash to blocks of about `block` passages, and the
blocks are decomposed side by side on the executors: a randomised SVD (random projection, range finder, singular values
of the projected passages) gives each block its latent space, cut where `energy` of the squared singular values is
reached. At the default energy nearly all directions stay (a low rank loses exact copies), so the latent cosine is close
to the plain one and meaning beyond shared words is not found. What a task holds is bounded by a block, a copy's cosine does not sink as the benchmark grows, and neither
texts nor sketches of the benchmark are put together on the driver; it hands out the finished models, `blocks_per_scan`
at a time. Corpus passages (every `window` words, half overlapping) are folded in and scored by their cosine with the
items' passages, their norm taken over all of their words; a passage that holds at least `own` of the weight of an item's
passage is a candidate too, so that a short item is found whatever stands around it and however its words' weights
differ. Items of fewer than `shortest` words are found by cosine alone. Candidates are then checked: the longest common subsequence
of the item's words and the words around the passage, and whether the item's answer (what follows its last question mark
or line feed, else its last words) stands there. Paraphrases keep order and answer; unrelated texts of one language do
not. The corpus is read once for the frequencies and once for every `blocks_per_scan` blocks.

Defined results: null text is empty and never contaminated; items without words match nothing; a null doc_id is never
reported; repeated rows are reported once by doc_id; ties between a document's items fall to the larger cosine, then the
larger item_id; a text of any length is searched whole; bytes that are not UTF-8 are ordinary word characters; an empty
table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import drop_rows, materialize, pick, small_batches, table

_BITS = 17
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and non-ASCII characters."""
    return _WORD.findall(text.lower())


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        b = self[word] = xxhash.xxh32_intdigest(word, 3) >> (32 - _BITS)
        return b


_memo = _Buckets()


def bucket_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.int32, len(words))


def _document_counts(batches):
    df, n = np.zeros(1 << _BITS, np.int64), 0
    for batch in batches:
        for _, texts in small_batches(batch):
            for t in texts:
                df[bucket_ids(words_of(t))] += 1  # a repeated index counts once
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["b", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed idf by word bucket over every document of (doc_id, text)."""
    got = docs.mapInArrow(_document_counts, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    b, n = got.column("b").to_numpy(), got.column("n").to_numpy()
    total = int(n[b < 0].sum()) if len(b) else 0
    df = np.zeros(1 << _BITS)
    df[b[b >= 0]] = n[b >= 0]
    return np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(1e-3)


def passages_of(n: int, window: int) -> list[tuple[int, int]]:
    """Spans of an item's passages: half-overlapping windows, the last one flush with the end."""
    if n <= window:
        return [(0, n)] if n else []
    step = window // 2
    spans = [(a, a + window) for a in range(0, n - window + 1, step)]
    return spans if spans[-1][1] == n else [*spans, (n - window, n)]


def tfidf(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(ids, return_counts=True)
    v = count * idf[at]
    return at, (v / np.linalg.norm(v)).astype(np.float32)


def randomised_svd(rows: np.ndarray, rank: int, energy: float, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a matrix, cut at `rank` or where `energy` is reached."""
    draws = np.random.default_rng(seed).standard_normal((rows.shape[1], min(rank, *rows.shape)))
    q, _ = np.linalg.qr(rows.T.astype(np.float64) @ (rows @ draws))
    _, sigma, turn = np.linalg.svd(rows @ q, full_matrices=False)
    held = np.cumsum(sigma**2)
    k = int(np.searchsorted(held, energy * held[-1] * (1 - 1e-12))) + 1
    return sigma[:k], (q @ turn[:k].T).astype(np.float32)


_MODEL = pa.schema([("block", pa.int64()), ("model", pa.binary())])


def _decompose(shared, block: int, settings: dict):
    """The items (block, doc_id, text) of a block -> its models: one for every 2 * block passages, so that long items are parted too."""

    def run(key, group):
        idf, out = shared.value, []
        items = sorted({(i, t) for i, t in zip(group.column("doc_id").to_pylist(), group.column("text").cast(pa.binary()).to_pylist())})
        words = [words_of(t) for _, t in items]
        spans = [(k, a, b) for k, w in enumerate(words) for a, b in passages_of(len(w), settings["window"])]
        for s in range(0, len(spans), 2 * block):
            own = spans[s : s + 2 * block]
            passages = [tfidf(bucket_ids(words[k][a:b]), idf) for k, a, b in own]
            buckets, at = np.unique(np.concatenate([b for b, _ in passages]), return_inverse=True)
            matrix = np.zeros((len(passages), len(buckets)), np.float32)
            matrix[np.repeat(np.arange(len(passages)), [len(b) for b, _ in passages]), at] = np.concatenate([v for _, v in passages])
            spectrum, basis = randomised_svd(matrix, len(passages), settings["energy"])
            used = sorted({k for k, _, _ in own})
            number = {k: n for n, k in enumerate(used)}
            spots = [(number[k], a, b) for k, a, b in own]
            model = settings | {"buckets": buckets, "basis": basis, "spectrum": spectrum, "spans": spots, "item_ids": [items[k][0] for k in used], "texts": [items[k][1] for k in used], "words": [words[k] for k in used]}
            out.append((key[0].as_py() + (s << 32), pickle.dumps(model, protocol=5)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MODEL)], schema=_MODEL)

    return run


def latent_models(items: DataFrame, shared_idf, block: int, **settings) -> DataFrame:
    """(block, model): the items (doc_id, text) in blocks of about `block` passages, each decomposed by itself."""

    def count(batches):
        for batch in batches:
            n = [len(passages_of(len(words_of(t or b"")), settings["window"])) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["doc_id", "text", "n"])

    counted = items.mapInArrow(count, "doc_id long, text string, n long").filter("n > 0")
    total = counted.agg(F.sum("n")).first()[0] or 0
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, round(total / block)))))
    return dealt.select("block", "doc_id", "text").groupBy("block").applyInArrow(_decompose(shared_idf, block, settings), "block long, model binary")


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        u = state & masks.get(x, 0)
        state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def answer_of(text: bytes, words: list[bytes], tail: int = 6) -> list[bytes]:
    """The item's answer: what follows its last question mark or line feed, else its last words."""
    cut = max(text.rstrip().rfind(b"?"), text.rstrip().rfind(b"\n"))
    own = words_of(text[cut + 1 :]) if cut >= 0 else []
    return own if len(own) >= 2 else words[-tail:]


class Retriever:
    """Finds a block of items in texts; built once a worker from the broadcast model."""

    def __init__(self, model: dict, idf: np.ndarray):
        self.__dict__.update(model)
        self.idf = idf
        self.row = np.full(1 << _BITS, len(self.buckets), np.int32)
        self.row[self.buckets] = np.arange(len(self.buckets))
        self.square = self.idf**2
        vectors, owner, size = [], [], []
        for k, a, b in self.spans:
            at, v = tfidf(bucket_ids(self.words[k][a:b]), self.idf)
            vectors.append(v @ self.basis[self.row[at]])
            owner.append(k)
            count = np.bincount(np.searchsorted(at, bucket_ids(self.words[k][a:b])), minlength=len(at))
            size.append(np.linalg.norm(count * self.idf[at]) if len(self.words[k]) >= self.shortest else np.inf)
        self.size = np.array(size, np.float32)
        queries, self.owner = np.array(vectors, np.float32).T, np.array(owner)
        folded = self.basis * self.idf[self.buckets][:, None]
        # a word's part of its passage's product with each item passage: as wide as the basis, so nothing is folded in twice
        self.table = np.vstack([folded @ queries, np.zeros((1, len(owner)), np.float32)]).astype(np.float32) if vectors else np.zeros((len(self.buckets) + 1, 0), np.float32)
        self.most = np.maximum(self.table.max(axis=1, initial=0), 0)
        self.most_own = np.maximum((self.table / self.size).max(axis=1, initial=0), 0)
        del self.basis
        self.answers = [answer_of(t, w) for t, w in zip(self.texts, self.words)]

    def candidates(self, ids: np.ndarray) -> dict[int, list[tuple[float, int]]]:
        """Item -> (cosine, first word) of the passages over the cosine threshold, or that hold `own` of an item passage's weight whatever stands around it."""
        half, rows = self.window // 2, self.row[ids]
        starts = np.arange(0, len(ids), half)
        square = self.square[ids]
        norm, bound, held = (np.add.reduceat(v, starts) for v in (square, self.most[rows], self.most_own[rows]))
        if len(starts) > 1:
            norm, bound, held = (v[:-1] + v[1:] for v in (norm, bound, held))
        norm = np.sqrt(np.maximum(norm, 1e-9))
        able = np.flatnonzero((bound >= self.cosine * norm) | (held >= self.own))  # no item scores more than what its words give at most
        out: dict[int, list[tuple[float, int]]] = {}
        for s in range(0, len(able), 512):
            at = able[s : s + 512]
            need, where = np.unique(np.concatenate((at, at + 1)), return_inverse=True)  # half windows: each is folded in once
            spots = (need * half)[:, None] + np.arange(half)
            folded = self.table[np.where(spots < len(ids), rows[np.minimum(spots, len(ids) - 1)], len(self.buckets))].sum(axis=1)
            product = folded[where[: len(at)]] + folded[where[len(at) :]]
            score = product / norm[at][:, None]
            i, j = np.nonzero((score >= self.cosine) | (product >= self.own * self.size))
            for a, k, c in zip(at[i].tolist(), self.owner[j].tolist(), score[i, j].tolist()):
                out.setdefault(k, []).append((c, a * half))
        return out

    def find(self, words: list[bytes], ids: np.ndarray) -> Iterator[tuple[int, float, float, bool]]:
        """(item, cosine, share of its words in common order, answer found) of the items that the words hold."""
        for k, spots in self.candidates(ids).items():
            item, answer, tried = self.words[k], self.answers[k], set()
            for cosine, at in sorted(spots, reverse=True):
                near = at // self.window
                if near in tried:
                    continue
                tried.add(near)
                around = words[max(0, at - len(item)) : at + self.window + len(item)]
                if len(item) < self.window // 2:  # a short item stands close together, or its words are there by chance
                    around = self.closest(item, around)
                share = common_subsequence(item, around) / len(item)
                if share < (self.weak if len(item) >= self.window // 2 else self.brief):
                    continue
                hit = common_subsequence(answer, around) >= 0.8 * len(answer)
                if share >= self.strong or hit:
                    yield self.item_ids[k], cosine, share, hit
                    break


    @staticmethod
    def closest(item: list[bytes], words: list[bytes]) -> list[bytes]:
        """The run of words, half as long again as the item, that has most of it in order."""
        size = len(item) + max(1, len(item) // 2)
        return max((words[k : k + size] for k in range(max(1, len(words) - size + 1))), key=lambda run: common_subsequence(item, run))


def _searcher(shared, shared_idf):
    """Function from a text to what the models of one scan find in it, one by one."""
    idf = shared_idf.value
    blocks = [Retriever(pickle.loads(m), idf) for m in shared.value]

    def search(text: bytes) -> Iterator[tuple[int, float, float, bool]]:
        words = words_of(text)
        if words:
            ids = bucket_ids(words)
            for b in blocks:
                yield from b.find(words, ids)

    return search


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_found", pa.bool_())])


def _find(shared, shared_idf):
    def run(batches):
        search = _searcher(shared, shared_idf)
        for batch in batches:
            for ids, texts in small_batches(batch):
                out = [(i, *f) for i, t in zip(ids, texts) if i is not None for f in search(t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return run


def _scans(picked: DataFrame, benchmark: DataFrame, window: int = 24, cosine: float = 0.4, own: float = 0.5, strong: float = 0.7, weak: float = 0.55, brief: float = 0.8, shortest: int = 4, block: int = 512, blocks_per_scan: int = 8, energy: float = 0.999):
    """(models, idf), both broadcast, for each scan of the corpus; the models of one scan are all that the driver holds at a time.

    A passage is a candidate by `cosine`, or by holding `own` of the weight of an item's passage (items of `shortest`
    words and more). Checks: `strong` of the item in order, or `weak` and its answer; `brief` for items under half a window.
    """
    context = picked.sparkSession.sparkContext
    items = pick(benchmark, "item_id", "text").filter("doc_id is not null and text is not null")
    shared_idf = context.broadcast(inverse_frequencies(picked))  # bounded: 2^17 numbers
    models = materialize(latent_models(items, shared_idf, block, window=window, cosine=cosine, own=own, strong=strong, weak=weak, brief=brief, shortest=shortest, energy=energy), "latent")
    numbers = sorted(r["block"] for r in models.select("block").collect()) or [-1]
    for k in range(0, len(numbers), blocks_per_scan):
        some = models.filter(F.col("block").isin(numbers[k : k + blocks_per_scan])).orderBy("block").collect()
        yield context.broadcast([bytes(r["model"]) for r in some]), shared_idf  # bounded by blocks_per_scan blocks of passages and words


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found) for each benchmark item that a document holds; settings: those of _scans."""
    picked = pick(docs, id_col, text_col)
    flat = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"
    found = [picked.mapInArrow(_find(*scan), flat) for scan in _scans(picked, benchmark, **settings)]
    return reduce(DataFrame.union, found)


def op7_decontaminate(spark, sf_dir):
    """One row per contaminated document: doc_id, n_items, item_ids, and the figures of its best item."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct("lcs_share", "cosine", "item_id", "answer_found")).alias("b")
    grouped = found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), best)
    return grouped.select("doc_id", "n_items", "item_ids", F.col("b.item_id").alias("best_item"), "b.cosine", "b.lcs_share", "b.answer_found")


def decontaminate_stage(spark, docs, sf_dir):
    """Pipeline stage: rows that hold a benchmark item go, each by its own text, null doc_id or not; columns unchanged."""

    def judge_by(scan):
        def judge():
            search = _searcher(*scan)
            return lambda texts: [next(search(t), None) is None for t in texts]

        return judge

    for scan in _scans(pick(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark")):
        docs = drop_rows(docs, "text", judge_by(scan))
    return docs
