"""Language identification in two levels.

A linear support vector machine per language family (one against the rest) picks the family; inside it, one-versus-one
machines between every two languages vote, ties falling to the larger summed margin. Features are hashed byte trigrams
of the lower-cased whole text, non-letters folded to one space; a document's score is the mean weight over its
trigrams, so prediction is one gather per trigram and no matrix per document.

Training: text and non-null lang of documents with crc32(doc_id) mod 5 <> 0, at most `most_rows` of them, the
languages in equal parts. A prediction sees the text alone.

Defined results: null text, or text without a letter, is `und` with score 0, as is every text when nothing could be
learned (a letter is what str.isalpha holds for one); a text of any length is read whole; bytes that are not UTF-8 count
as U+FFFD, no letter; repeated rows get equal results; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import small_batches, texts_of
from rankloom.llm.labelled import bounded_sample, held_out

#: Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ca gl ro oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi bn mr gu pa ne ur",
    "semitic": "ar he mt am",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_BITS = 12
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def buckets(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text."""
    b = _FOLD[np.frombuffer(f"  {text.lower()} ".encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


def _vectors(batches):
    for batch in batches:
        x = []
        for t in texts_of(batch.column(1)):
            at = buckets(t)
            x.append((np.bincount(at, minlength=1 << _BITS) / len(at)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(2)], names=["x", "lang"])


def linear_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine, classes weighted equally, by accelerated gradient steps; y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    rate = 0.5 / (float((weight * (x * x).sum(axis=1)).sum()) + 1)
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ (w + 0.9 * vw) + b + 0.9 * vb))
        g = (-2 * weight * gap * y).astype(np.float32)
        vw = 0.9 * vw - rate * (x.T @ g + l2 * w)
        vb = 0.9 * vb - rate * float(g.sum())
        w, b = w + vw, b + vb
    return w, float(b)


def train(docs: DataFrame, most_rows: int = 4_000) -> dict:
    """Machines over trigram buckets from at most most_rows labelled rows of (doc_id, text, lang)."""
    usable = docs.filter("lang is not null and text is not null").filter(~held_out()).select("doc_id", "lang")
    chosen = bounded_sample(usable, "lang", most_rows).distinct()  # bounded by most_rows pairs, so it is broadcast and no text is shuffled
    got = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "text", "lang").mapInArrow(_vectors, "x binary, lang string").collect()
    if not got:
        return {"languages": []}
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    lang = np.array([r["lang"] for r in got])
    scale = 1 / (x.std(axis=0) + 1e-4)
    x = (x * scale / 30).astype(np.float32)
    languages = sorted(set(lang.tolist()))
    family = np.array([FAMILY.get(v, v) for v in lang])
    families = sorted(set(family.tolist()))
    names, machines = [], []
    if len(families) > 1:
        for f in families:
            names.append(("family", f, None))
            machines.append(linear_svm(x, np.where(family == f, 1.0, -1.0).astype(np.float32)))
    for f in families:
        for a, b in combinations([v for v in languages if FAMILY.get(v, v) == f], 2):
            mine = (lang == a) | (lang == b)
            names.append(("pair", a, b))
            machines.append(linear_svm(x[mine], np.where(lang[mine] == a, 1.0, -1.0).astype(np.float32)))
    w = np.stack([m[0] * scale / 30 for m in machines], axis=1).astype(np.float32) if machines else np.zeros((1 << _BITS, 0), np.float32)
    return {"languages": languages, "families": families, "names": names, "w": w, "b": np.array([m[1] for m in machines])}


def decide(model: dict, margins: np.ndarray) -> tuple[str, float]:
    """(language, score) from a document's margins."""
    p = 1 / (1 + np.exp(-np.clip(3 * margins, -50, 50)))
    first = [(margins[k], p[k], n[1]) for k, n in enumerate(model["names"]) if n[0] == "family"]
    best, sure, family = max(first) if first else (0.0, 1.0, model["families"][0])
    votes = {v: [0, 0.0, 1.0] for v in model["languages"] if FAMILY.get(v, v) == family}
    for k, (kind, a, b) in enumerate(model["names"]):
        if kind == "pair" and a in votes:
            win, lose = (a, b) if margins[k] >= 0 else (b, a)
            votes[win][0] += 1
            votes[win][2] = min(votes[win][2], max(p[k], 1 - p[k]))
            votes[a][1] += margins[k]
            votes[b][1] -= margins[k]
    lang = max(sorted(votes), key=lambda v: (votes[v][0], votes[v][1]))
    return lang, float(min(1.0, max(0.0, sure * votes[lang][2])))


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for ids, raw in small_batches(batch, 1 << 20):
                texts = [t.decode("utf-8", "replace") for t in raw]
                out = [("und", 0.0)] * len(texts)
                some = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))] if model["languages"] else []
                if some:
                    at = [buckets(texts[k]) for k in some]
                    starts = np.concatenate(([0], np.cumsum([len(x) for x in at])[:-1]))
                    if len(model["names"]):
                        sums = np.add.reduceat(model["w"][np.concatenate(at)], starts, axis=0, dtype=np.float64)
                        margins = sums / np.array([len(x) for x in at])[:, None] + model["b"]
                    else:
                        margins = np.zeros((len(some), 0))
                    for k, m in zip(some, margins):
                        out[k] = decide(model, m)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], schema=_OUT)

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 4_000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(train(picked, most_rows))  # bounded: 2^12 weights a machine
    found = picked.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_language_id(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
