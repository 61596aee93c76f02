"""Toxicity through a noisy channel.

Writers hide words by leetspeak, by spacing letters and by repeating them. A suspicious token becomes a character
lattice: each observed character may stand for the letters of the channel table, a separator or a repeated character
may stand for nothing. Viterbi decoding over letter pairs under a character trigram model of the whole corpus restores
the likeliest word. The restored text is then scored: a logistic model over the presence of words and word beginnings.

Training: labels come only from rows with crc32(doc_id) mod 5 <> 0, at most `most_rows` of them (both labels in equal
parts, weighted to the shares that all such labels have); the character model counts every document.

Defined results: null text counts as empty and scores the model's intercept; a text of any length is scored whole; bytes
that are not UTF-8 become U+FFFD; repeated rows get equal scores; a doc_id with several labels counts as toxic if any
says so, null labels are ignored; without a usable label every score is 0; an empty table gives no row; other columns
are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import drop_rows, pick, small_batches, table, texts_of
from rankloom.llm.labelled import bounded_sample, held_out

#: Letters that a written character may stand for.
CHANNEL = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l",
}
#: Natural-log costs of the channel: a character as it is, a substitution, a dropped repeat, a dropped separator.
AS_IS, SUBSTITUTE, REPEAT, SEPARATOR = 0.0, 0.7, 0.2, 1.2
_EDGE_SIGNS = ".,;:?\"'()[]{}<>-–—_*#%&$!|+/\\~`^="
_SPACED = re.compile(r"(?<!\S)(?:\w[ ._*\-/|~]{1,3}){2,}\w(?=$|[\s.,;:!?])")
_GAPS = re.compile(r"[ ._*\-/|~]")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_LONGER_RUN = re.compile(r"(\S)\1{3,}")
_REMEMBERED = 64  # longer tokens are decoded anew each time, so that what a task remembers stays bounded
_ALPHABET = 28  # 0 edge of a word, 1-26 letters, 27 any other letter
_CODE = np.zeros(256, np.uint8)
_CODE[[*range(97, 123)]] = np.arange(1, 27)
_CODE[[*range(65, 91)]] = np.arange(1, 27)
_CODE[128:] = 27


def trigrams(text: bytes) -> np.ndarray:
    """Counts of letter trigrams of a UTF-8 text, by code."""
    c = _CODE[np.frombuffer(b"  " + text + b"  ", np.uint8)].astype(np.int32)
    return np.bincount((c[:-2] * _ALPHABET + c[1:-1]) * _ALPHABET + c[2:], minlength=_ALPHABET**3)


def _count_trigrams(batches):
    total = np.zeros(_ALPHABET**3, np.int64)
    for batch in batches:
        for _, texts in small_batches(batch):
            total += trigrams(b"  ".join(texts))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a letter after two letters, [28, 28, 28]; counted over every document of (doc_id, text)."""
    rows = docs.mapInArrow(_count_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.full(_ALPHABET**3, 0.5)
    for code, n in rows:
        counts[code] += n
    counts = counts.reshape((_ALPHABET,) * 3)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def _code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest intended word behind a token of any length: Viterbi over the lattice, states are the last two letters.

    A run of one character over three counts as three. Ways are linked backwards, so time and memory follow the length.
    """
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for ch in _LONGER_RUN.sub(r"\1\1\1", token.lower()):
        options = [(x, SUBSTITUTE) for x in CHANNEL.get(ch, "")]
        if ch.isalpha():
            options.append((ch, AS_IS))
        drop = REPEAT if ch == before and ch.isalpha() else SEPARATOR if not ch.isalnum() else None
        if not options and drop is None:
            return token
        options = [(x, price, _code(x)) for x, price in options]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, way) in paths.items():
            if drop is not None:
                old = new.get((a, b))
                if old is None or cost + drop < old[0]:
                    new[a, b] = (cost + drop, way)
            for letter, price, c in options:
                value = cost + price - model[a, b, c]
                old = new.get((b, c))
                if old is None or value < old[0]:
                    new[b, c] = (value, (way, letter))
        paths, before = new, ch
    ends = [(cost - model[a, b, 0], way) for (a, b), (cost, way) in paths.items()]
    least = min(cost for cost, _ in ends)
    return min(_spell(way) for cost, way in ends if cost == least)


def _spell(way: tuple | None) -> str:
    letters = []
    while way is not None:
        way, letter = way
        letters.append(letter)
    return "".join(reversed(letters))


def _suspicious(core: str) -> bool:
    return len(core) > 2 and (not core.isalpha() or _LONG_RUN.search(core) is not None) and any(map(str.isalpha, core)) and not ("." in core and "@" in core[1:-1])


class Restorer(dict):
    """Words and word beginnings that a white-space-bounded token gives once restored, remembered by token."""

    def __init__(self, model: np.ndarray, wanted: dict[str, int] | None = None, most: int = 400_000):
        self.model, self.wanted, self.most = model, wanted, most

    def restore(self, token: str) -> str:
        core = token.strip(_EDGE_SIGNS)
        if core.isalpha() and _LONG_RUN.search(core) is None:
            return core.lower()
        whole = token.strip(".,;:?\"'()[]{}").lower()
        if _suspicious(whole) and not whole.strip(_EDGE_SIGNS).isalpha():
            return decode(whole, self.model)
        return decode(core.lower(), self.model) if _suspicious(core) else core.lower()

    def __missing__(self, token: str):
        if len(self) > self.most:
            self.clear()
        found = set()
        for w in {self.restore(token), token.strip(_EDGE_SIGNS).lower()}:
            found |= {w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)}
        found.discard("")
        out = tuple(found) if self.wanted is None else tuple(self.wanted[x] for x in found if x in self.wanted)
        if len(token) <= _REMEMBERED:
            self[token] = out
        return out

    def features(self, text: str) -> set:
        """Features of a whole text; letters spaced apart count as one token."""
        tokens = set(text.split())
        for m in _SPACED.finditer(text):
            tokens.add(_GAPS.sub("", m.group(0)))
        out: set = set()
        for f in filter(None, map(self.__getitem__, tokens)):
            out.update(f)
        return out


def _count_features(model: np.ndarray, most: int = 300_000):
    """(text, y) -> (feature, toxic documents, other documents), combined before they leave a partition."""

    def flush(seen):
        names = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[x][0] for x in names]), pa.array([seen[x][1] for x in names])], names=["f", "n1", "n0"])

    def run(batches):
        memo, seen = Restorer(model), {}
        for batch in batches:
            for text, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                for f in memo.features(text):
                    seen.setdefault(f, [0, 0])[1 - y] += 1
                if len(seen) > most:
                    yield flush(seen)
                    seen = {}
        if seen:
            yield flush(seen)

    return run


def _index_features(model: np.ndarray, wanted: dict[str, int]):
    def run(batches):
        memo = Restorer(model, wanted)
        for batch in batches:
            found = [sorted(memo.features(t)) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["x", "y"])

    return run


def _logistic(rows: list[tuple[list[int], int]], size: int, weights: np.ndarray, l2: float = 1e-5, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression over sparse binary rows, by accelerated gradient steps."""
    y = np.array([r[1] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col = np.array([c for r in rows for c in r[0]], np.int64)
    w, b, vw, vb = np.zeros(size), 0.0, np.zeros(size), 0.0
    rate = 4.0 / (1 + np.bincount(at, minlength=len(rows)).max(initial=0) ** 0.5)
    for _ in range(steps):
        z = b + 0.9 * vb + np.bincount(at, (w + 0.9 * vw)[col], len(rows))
        g = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        vw = 0.9 * vw - rate * (np.bincount(col, g[at], size) / weights.sum() + l2 * w)
        vb = 0.9 * vb - rate * g.sum() / weights.sum()
        w, b = w + vw, b + vb
    return w, b


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, clear: float = 10.0) -> dict:
    """The model: character trigrams of all documents, and word weights from at most most_rows labelled documents.

    A feature counts if it stands in three of these documents or more and its log odds times the root of their number
    are `clear` or more: what tells the labels apart stays, however many features that are.
    """
    chars = character_model(docs)
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y")).filter(~held_out())
    marked = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = docs.join(F.broadcast(bounded_sample(marks, "y", most_rows)), "doc_id").select("text", "y")  # bounded by most_rows pairs of numbers; no text is shuffled
    got = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(got) < 2:
        return {"chars": chars, "wanted": {}, "w": np.zeros(0), "b": -30.0}
    n1, n0 = got[1], got[0]
    counts = sample.mapInArrow(_count_features(chars), "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log((F.col("n1") + 0.1) / (n1 + 0.2)) - F.log((F.col("n0") + 0.1) / (n0 + 0.2))
    told = counts.filter("n1 + n0 >= 3").filter(F.abs(odds) * F.sqrt(F.col("n1") + F.col("n0")) >= clear).select("f").orderBy("f").collect()  # bounded by the sampled documents
    wanted = {r["f"]: k for k, r in enumerate(told)}
    rows = [(list(r["x"]), r["y"]) for r in sample.mapInArrow(_index_features(chars, wanted), "x array<int>, y int").collect()]
    share = marked[1] / (marked[0] + marked[1])  # as common as the labels say
    weight = np.array([share / n1 if y else (1 - share) / n0 for _, y in rows])
    w, b = _logistic(rows, len(wanted), weight / weight.mean())
    return {"chars": chars, "wanted": wanted, "w": w, "b": float(b)}


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scorer(model: dict):
    """Function from texts (UTF-8) to their scores."""
    memo, w, b = Restorer(model["chars"], model["wanted"]), model["w"], model["b"]

    def score(texts: list[bytes]) -> np.ndarray:
        z = [b + w[list(f)].sum() if (f := memo.features(t.decode("utf-8", "replace"))) else b for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))

    return score


def _scores(shared):
    def run(batches):
        score = _scorer(shared.value)
        for batch in batches:
            for ids, texts in small_batches(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score(texts))], schema=_SCORE)

    return run


def _shared_model(docs: DataFrame, labels: DataFrame, most_rows: int):
    return docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_rows))  # bounded: 28^3 numbers and the weights of most_rows documents' features


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 12_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    picked = pick(docs, id_col, text_col)
    scored = picked.mapInArrow(_scores(_shared_model(picked, labels, most_rows)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicity_stage(spark, docs, sf_dir, most_rows: int = 12_000):
    """Pipeline stage: rows predicted toxic go, each by its own text, null doc_id or not; columns unchanged."""
    shared = _shared_model(pick(docs, "doc_id", "text"), table(spark, sf_dir, "labels"), most_rows)

    def judge():
        score = _scorer(shared.value)
        return lambda texts: (score(texts) < 0.5).tolist()

    return drop_rows(docs, "text", judge)
