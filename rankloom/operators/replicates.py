"""Thousands of permutation and bootstrap replicates in one pass: a task draws its rows' weights and multiplies.

Draws are words of md5(seed|replicate // 4|row), four replicates a digest, so any engine can draw them again. A row's
weights for all replicates are never written or shuffled; what leaves a task is one sum per key, replicate and column.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import matrix as M
from rankloom.operators.quantiles import select_ranks
from rankloom.sources.shared import discard, materialize

#: Cumulative probabilities of a Poisson variable of mean one, up to nine.
POISSON = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887]


#: MD5 (RFC 1321): constants, rotations and the order of the words.
_K = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]
_TURN = [t[i % 4] for t in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _md5_block(prefix: bytes, ids: np.ndarray) -> np.ndarray:
    """MD5 words of prefix + id, for ids of one length (lines of bytes) that fit one block with it: all rows a step."""
    m, p, n = len(ids), len(prefix), len(prefix) + ids.shape[1]
    text = np.zeros((m, 64), np.uint8)
    text[:, :p], text[:, p:n], text[:, n] = np.frombuffer(prefix, np.uint8), ids, 0x80
    text[:, 56:58] = np.frombuffer((8 * n).to_bytes(2, "little"), np.uint8)
    w = np.ascontiguousarray(text.view("<u4").T)
    own = range(p // 4, (n - 1) // 4 + 1)  # the words that differ by row
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(m, v) for v in start)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        k = _WORD[i]
        if k in own:
            f += w[k]
            f += np.uint32(_K[i])
        else:
            f += np.uint32((_K[i] + int(w[k, 0])) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_TURN[i]), out=g)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    # an MD5 word is little-endian, a draw reads the hex digits in order
    return np.stack([v + s for v, s in zip((a, b, c, d), start)], axis=1).byteswap()


def digests(prefixes: list[bytes], ids: list[bytes], step: int = 8192) -> np.ndarray:
    """The four 32-bit words of md5(prefix + id), as the hex digits show them, by id, prefix and word."""
    out = np.empty((len(ids), len(prefixes), 4), np.uint32)
    length = np.array([len(i) for i in ids])
    longest = max(map(len, prefixes), default=0)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        if len(at) < 512 or not n or n + longest > 55:  # vector steps pay from some hundred rows on
            out[at] = np.frombuffer(b"".join([hashlib.md5(p + ids[i]).digest() for i in at for p in prefixes]), ">u4").reshape(len(at), len(prefixes), 4)
            continue
        lines = np.frombuffer(b"".join(ids if len(at) == len(ids) else [ids[i] for i in at]), np.uint8).reshape(len(at), n)
        for k in range(0, len(at), step):
            for j, p in enumerate(prefixes):
                out[at[k : k + step], j] = _md5_block(p, lines[k : k + step])
    return out


def _bits(seed: str, ids, reps: int) -> np.ndarray:
    """Draws of each row (lines) for each replicate 0..reps-1 (columns) as 32-bit numbers."""
    return digests([f"{seed}|{k}|".encode() for k in range(-(-reps // 4))], [str(i).encode() for i in ids]).reshape(len(ids), -1)[:, :reps]


def words(seed: str, ids, reps: int) -> np.ndarray:
    """Draws in [0, 1) of each row (lines) for each replicate 0..reps-1 (columns)."""
    return _bits(seed, ids, reps) / 4294967296.0


def poisson_weights(seed: str, ids, reps: int) -> np.ndarray:
    """Poisson numbers of mean one: how many of POISSON a draw reaches, told from its 32 bits."""
    u = _bits(seed, ids, reps)
    out = np.zeros(u.shape, np.float32)
    for p in POISSON:
        out += u >= np.uint32(math.ceil(p * 4294967296.0))
    return out


def word_sql(seed: str, rep: str, row: str) -> str:
    """DuckDB text of a draw."""
    return f"(('0x' || substr(md5('{seed}|' || ({rep} // 4) || '|' || {row}), 1 + 8 * ({rep} % 4)::INT, 8))::BIGINT / 4294967296.0::DOUBLE)"


def poisson_sql(draw: str) -> str:
    return "(" + " + ".join(f"({draw} >= {p})::INT" for p in POISSON) + ")"


def _spark_word(seed: str, rep, row):
    text = F.md5(F.concat_ws("|", F.lit(seed), F.floor(rep / 4).cast("string"), row.cast("string")))
    return F.conv(F.substr(text, (1 + 8 * (rep % 4)).cast("int"), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def cutoffs(rows: DataFrame, row: str, take, seed: str, reps: int, key: str | None = None):
    """For each replicate the draw of rank `take` (1-based) among all rows: those up to it are a random subset of that size (equal draws at the cutoff, one in four billion, all count).

    With key, take is a dict and so is the result.
    """
    keys = [key] if key else []
    each = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), row).select(*keys, "rep", _spark_word(seed, F.col("rep"), F.col(row)).alias("u"))
    targets = rows.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep"))
    if key:
        wanted = rows.sparkSession.createDataFrame([(k, n - 1) for k, n in take.items()], f"{key} {rows.schema[key].dataType.simpleString()}, rank long")
        targets = targets.crossJoin(F.broadcast(wanted))  # replicates times keys
    else:
        targets = targets.withColumn("rank", F.lit(take - 1).cast("long"))
    out: dict = {k: np.full(reps, -1.0) for k in (take if key else [None])}
    for r in select_ranks(each, [*keys, "rep"], "u", targets).collect():  # one number a replicate
        out[r[key] if key else None][r["rep"]] = r["u"]
    return out if key else out[None]


def _tasks(df: DataFrame) -> int:
    """A number of tasks that is kept: by bytes alone, rows with thousands of draws each would fall into one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def permuted_products(rows: DataFrame, row: str, at: str, n: int, a: str, b: str, seed: str, reps: int, most_bytes: int = 1 << 30, bin_rows: int = 1 << 15, chunk_rows: int = 1 << 16) -> DataFrame:
    """rep (1..reps), v: the sum of a times b over all rows, with a permuted: the a of k-th smallest draw md5(seed|rep|row) meets the b of place k.

    at: 0-based place of each row by its id, to which equal draws fall too; a and b are whole numbers under 2^31.
    Rows lie in chunks of places. A chunk draws for some replicates and parts draws and a by the draw's first bits; a bin
    of one replicate then has a known first rank, and is sorted and multiplied with the b of its ranks by itself. A draw
    and its a are eight bytes, and replicates are taken in passes of at most most_bytes of them.
    """
    tasks = _tasks(rows)
    size = max(8192, min(chunk_rows, n // 64))
    shift = 32 - max(0, (max(1, n) - 1) // bin_rows).bit_length()

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(at)
        return pd.DataFrame({"chunk": g["chunk"].iloc[:1], "ids": ["\n".join(map(str, g[row])).encode()], "a": [g[a].to_numpy("<i4").tobytes()], "b": [g[b].to_numpy("<i4").tobytes()]})

    chunks = materialize(rows.withColumn("chunk", F.floor(F.col(at) / size)).select("chunk", at, row, a, b).groupBy("chunk").applyInPandas(pack, "chunk long, ids binary, a binary, b binary"), "chunks")

    def draw(batches):
        for some in batches:
            for chunk, g, first, last, ids, values in zip(*(some[c] for c in ("chunk", "g", "first", "last", "ids", "a"))):
                ids, values, out = bytes(ids).split(b"\n"), np.frombuffer(values, "<i4"), []
                for rep in range(first, last):
                    u = digests([f"{seed}|{rep}|".encode()], ids)[:, 0, 0]
                    bins = (u.astype(np.int64) >> shift).astype(np.int32)
                    order = np.argsort(bins, kind="stable")
                    u, x, bins = u[order], values[order], bins[order]
                    cut = np.flatnonzero(np.diff(bins)) + 1
                    out += [(chunk, g, rep, int(bins[i]), j - i, u[i:j].tobytes(), x[i:j].tobytes()) for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(u)])]
                yield pd.DataFrame(out, columns=["chunk", "g", "rep", "bin", "n", "u", "x"])

    def multiply(drawn: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("chunk")
        y, base, out = np.frombuffer(b"".join(blocks["b"]), "<i4").astype(float), int(blocks["chunk"].iloc[0]) * size, []
        for rep, p in drawn.sort_values("chunk").groupby("rep"):
            u, x = np.frombuffer(b"".join(p["u"]), "<u4"), np.frombuffer(b"".join(p["x"]), "<i4").astype(float)
            start = int(p["start"].iloc[0]) - base
            out.append((rep, x[np.argsort(u, kind="stable")] @ y[start : start + len(u)]))
        return pd.DataFrame(out, columns=["rep", "v"])

    done, width = [], max(1, min(reps, most_bytes // (8 * max(1, n))))
    for first in range(1, reps + 1, width):
        last, step = min(first + width, reps + 1), max(1, min(25, width // 4))
        turns = F.explode(F.array(*(F.struct(F.lit(k).alias("g"), F.lit(k).alias("first"), F.lit(min(k + step, last)).alias("last")) for k in range(first, last, step)))).alias("t")
        asked = chunks.select("chunk", "ids", "a", turns).select("chunk", "t.*", "ids", "a").repartition(tasks, "chunk", "g")
        drawn = materialize(asked.mapInPandas(draw, "chunk long, g int, rep int, bin int, n long, u binary, x binary"), "drawn")
        counts = drawn.groupBy("g", "rep", "bin").agg(F.sum("n").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("rep").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = materialize(counts.withColumn("start", before), "starts")
        span = starts.groupBy("g", "bin").agg(F.floor(F.min("start") / size).alias("lo"), F.floor((F.max(F.col("start") + F.col("n")) - 1) / size).alias("hi"))
        blocks = span.select("g", "bin", F.explode(F.sequence("lo", "hi")).alias("chunk")).join(chunks.select("chunk", "b"), "chunk")
        placed = drawn.join(F.broadcast(starts.select("rep", "bin", "start")), ["rep", "bin"]).drop("n")  # bins times the replicates of a pass
        met = placed.repartition(tasks, "g", "bin").groupBy("g", "bin").cogroup(blocks.repartition(tasks, "g", "bin").groupBy("g", "bin"))
        done.append(materialize(met.applyInPandas(multiply, "rep int, v double"), "products"))
        discard(drawn, starts)
    discard(chunks)
    return reduce(DataFrame.union, done).groupBy(F.col("rep").cast("long").alias("rep")).agg(F.sum("v").alias("v"))


def weighted_sums(rows: DataFrame, key: str, row: str, x: str, seed: str, reps: int, cut=None, block: int = 2048, together: bool = False) -> DataFrame:
    """key, rep, n (sum of weights), s (array: weighted sums of x), all_n, all_s (unweighted).

    Weights are 1 up to the replicate's cutoff (by key where cut is a dict) and 0 above it, or without cutoffs Poisson numbers of mean one.
    A row's draws do not depend on its key, so rows of one name draw once for all their keys where a
    batch holds them; together: they are dealt so that it does.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        total: dict = {}
        for b in batches:
            names, of = np.unique(b[row].to_numpy(), return_inverse=True)
            own = [(k, at) for k, at in b.groupby(key, sort=False).indices.items()]
            values = M.stacked(b[x]) if len(b) else None
            for a in range(0, len(names), block):
                part = names[a : a + block]
                w = poisson_weights(seed, part, reps) if cut is None else words(seed, part, reps)
                for k, at in own:
                    here = at[(of[at] >= a) & (of[at] < a + block)]
                    if not len(here):
                        continue
                    y = np.hstack([np.ones((len(here), 1)), values[here]])
                    mine = w[of[here] - a]
                    mine = mine.astype(float) if cut is None else (mine <= (cut[k] if isinstance(cut, dict) else cut)).astype(float)
                    total[k] = total.get(k, 0) + np.vstack([y.sum(axis=0), mine.T @ y])
        yield pd.DataFrame([(k, v.ravel()) for k, v in total.items()], columns=[key, "v"])

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        v = np.asarray(g["v"].iloc[0]).reshape(reps + 1, -1)
        return pd.DataFrame({key: g[key].iloc[0], "rep": np.arange(reps), "n": v[1:, 0], "s": list(v[1:, 1:]), "all_n": v[0, 0], "all_s": [v[0, 1:]] * reps})

    dealt = rows.select(key, row, x)
    dealt = dealt.repartition(_tasks(rows), row).sortWithinPartitions(row) if together else dealt
    sums = M.sum_arrays(dealt.mapInPandas(run, f"{key} {kind}, v array<double>"), [key])
    return sums.groupBy(key).applyInPandas(spread, f"{key} {kind}, rep long, n double, s array<double>, all_n double, all_s array<double>")
