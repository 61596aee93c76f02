"""What fails only on large tables or several executors, made to show on small ones."""

import hashlib
import math
import time
from fractions import Fraction
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rankloom.operators import replicates as R
from rankloom.operators import tails
from rankloom.operators.nearest import nearest
from rankloom.operators.rewiring import rewire
from rankloom.plans import vector_queries as V
from rankloom.sources.relations import Tables


class InAnyOrder(Tables):
    """Lineitem in another row order each time it is read, as rows come from remote tasks."""

    @property
    def lineitem(self):
        df = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")

        def mixed(batches):
            for b in batches:
                yield b.iloc[np.random.default_rng().permutation(len(b))]

        return df.mapInPandas(mixed, df.schema)


def test_signed_ranks_lose_no_supplier(spark, sf_dir):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = V.wilcoxon_signed_rank(InAnyOrder(spark, sf_dir)).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    x = pd.read_parquet(f"{sf_dir}/lineitem.parquet").pivot_table(index="l_suppkey", columns="l_returnflag", values="l_extendedprice", aggfunc="mean")
    d = (x["A"] - x["R"]).dropna()
    assert got.n == (d != 0).sum() and got.w == d.abs().rank()[d > 0].sum()


def test_sign_test_is_exact_and_does_not_grow():
    cases = [(0, 1), (1, 2), (1, 5), (9, 31), (140, 300), (480, 1000), (9990, 20_000), (9700, 20_000)]
    for x, n in cases:
        term = total = math.comb(n, x)
        for i in range(x, 0, -1):
            term = term * i // (n - i + 1)
            total += term
        want = min(1.0, float(Fraction(2 * total, 2**n)))
        got = tails._binomial(pd.Series([x, n - x]), pd.Series([n, n]))
        assert np.allclose(got, want, rtol=1e-12)
    start = time.time()
    p = tails._binomial(pd.Series([199_900, 199_900_000]), pd.Series([400_000, 400_000_000]))
    z = np.array([(200_000 - 199_900 - 0.5) / math.sqrt(100_000), (200_000_000 - 199_900_000 - 0.5) / math.sqrt(100_000_000)])
    assert np.allclose(p, [math.erfc(v / math.sqrt(2)) for v in z], atol=1e-6) and time.time() - start < 10


def test_pipeline_leaves_one_stage_on_disk(spark, sf_dir):
    """The last stage reads one table; inputs and working tables of the stages before are gone."""
    import corpus_pipeline
    from rankloom.sources.shared import shared_dir

    where = Path(shared_dir(spark).removeprefix("file:")) / "rankloom" / spark.sparkContext.applicationId
    before = set(where.iterdir()) if where.exists() else set()
    out = corpus_pipeline.run(spark, sf_dir)
    left = [p.name for p in set(where.iterdir()) - before]
    assert len(left) == 1 and left[0].startswith("stage-decontamination") and out.count() > 0


def test_pipeline_links_by_fingerprint(spark, sf_dir, monkeypatch):
    """Fingerprints within 2 bits make a link in the pipeline's near-dedup, whatever the shingle sets say, and join the sets' components."""
    from rankloom.llm import simhash

    rng = np.random.default_rng(5)
    base, other = (["%s%d" % (c, k) for k in rng.integers(0, 9000, 100)] for c in "vu")
    near = [*base[:50], "new", *base[51:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(other[:60])), (None, "no id")]
    marked = {" ".join(near).encode(): 0b11, " ".join(other).encode(): 0b10}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, id_col, text_col, shingle, mark: plain(docs, marked, mark))
    left = simhash.neardup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "None"]


def plain(docs, marked, mark):
    """Set fingerprints for the texts named, and one far from all others for the rest."""
    fp = F.xxhash64("text")
    for text, bits in marked.items():
        fp = F.when(F.col("text") == text.decode(), F.lit(bits).cast("long")).otherwise(fp)
    return docs.select("doc_id", mark.alias("mark"), fp.alias("fp"))


def test_digests_equal_the_library():
    ids = [str(i).encode() for i in [*range(0, 9000, 7), 10**18, -5]] + [b"x" * 60, b""]
    prefixes = [b"sp|1|", b"boot|499|", b"a" * 40]
    got = R.digests(prefixes, ids, step=500)
    for j, p in enumerate(prefixes):
        assert got[:, j].tolist() == [np.frombuffer(hashlib.md5(p + i).digest(), ">u4").tolist() for i in ids]
    assert (R.poisson_weights("boot", range(700), 22) == np.searchsorted(R.POISSON, R.words("boot", range(700), 22), side="right")).all()


def test_permuted_products_over_bins_and_passes(spark):
    """Small bins, chunks and passes against one sort; draws of equal first bits and negative ids included."""
    rng = np.random.default_rng(3)
    n, reps = 1500, 13
    ids = np.sort(rng.choice(np.arange(-4000, 60_000), n, replace=False))
    a, b = rng.integers(-n, n, n), rng.integers(-n, n, n)
    df = spark.createDataFrame([(int(i), k, int(x), int(y)) for k, (i, x, y) in enumerate(zip(ids, a, b))], "id long, i long, a int, b int").repartition(3)
    got = {r.rep: r.v for r in R.permuted_products(df, "id", "i", n, "a", "b", "s", reps, most_bytes=8 * n * 5, bin_rows=100).collect()}
    want = {}
    for rep in range(1, reps + 1):
        u = [int(hashlib.md5(f"s|{rep}|{i}".encode()).hexdigest()[:8], 16) for i in ids]
        want[rep] = float(a[np.argsort(u, kind="stable")] @ b)
    assert got == want


def test_bootstrap_draws_once_for_all_keys(spark):
    """Rows of one name under several keys take the same weights, dealt together or not."""
    rng = np.random.default_rng(1)
    x, key, name = rng.normal(size=(90, 2)), rng.integers(0, 3, 90), rng.integers(0, 25, 90)
    df = spark.createDataFrame([(int(k), int(i), v.tolist()) for k, i, v in zip(key, name, x)], "k long, i long, x array<double>").repartition(4)
    w = np.searchsorted(R.POISSON, R.words("a", name, 10), side="right")
    for r in R.weighted_sums(df, "k", "i", "x", "a", 10, block=4, together=True).collect():
        own = key == r.k
        assert r.n == w[own, r.rep].sum() and np.allclose(r.s, w[own, r.rep] @ x[own]) and r.all_n == own.sum()


def test_nearest_in_steps_of_queries(spark):
    """Steps smaller than a block of queries give the same partners."""
    x = np.random.default_rng(2).normal(size=(120, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample long, x array<double>").repartition(3)
    got = {r.i: (r.j, r.w) for r in nearest(df, df.filter("sample % 2 = 0"), 1, block=40, at_once=7).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = np.round(u @ u.T, 6)
    np.fill_diagonal(w, -2)
    assert got == {i: (int(w[i].argmax()), w[i].max()) for i in range(0, 120, 2)}


def test_rewiring_sends_no_table_to_the_driver(spark):
    """A broadcast passes the driver whole: with the largest one set to a byte, each would fail."""
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(100 + b)) for a, b in rng.integers(0, 100, (900, 2))} | {(0, 100 + b) for b in range(100)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        out, told = rewire(edges, swap_factor=3)
        got = [(r.a, r.b) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    degree = lambda es: np.bincount(np.ravel(list(es)), minlength=200).tolist()
    assert degree(got) == degree(pairs) and len(set(got)) == len(pairs) and told["swaps_done"] >= 3 * len(pairs)


def test_near_dedup_keeps_no_table_of_whole_sets(spark, sf_dir, monkeypatch):
    """Whole sets take more room than texts; of texts without near copies none is written, and the tables stay well under them."""
    from rankloom.llm import jaccard

    rng = np.random.default_rng(6)
    texts = [" ".join("%06d" % k for k in rng.integers(0, 1_000_000, 2000)) for _ in range(60)]
    live, written = {}, []
    plainly, drop = jaccard.materialize, jaccard.discard

    def noted(df, name):
        out = plainly(df, name)
        live[out._written_at] = sum(p.stat().st_size for p in Path(out._written_at.removeprefix("file:").replace("//", "/")).rglob("*.parquet"))
        written.append(sum(live.values()))
        return out

    monkeypatch.setattr(jaccard, "materialize", noted)
    monkeypatch.setattr(jaccard, "discard", lambda *t: ([live.pop(x._written_at) for x in t], drop(*t)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    out = jaccard.jaccard_components(docs)
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, i) for i in range(60)}
    assert max(written) < 0.8 * 5 * 60 * 1996  # five bytes an element


def test_exact_dedup_keeps_texts_that_share_a_slot(spark, sf_dir):
    """Bit tables only part rows: a text alone in its group stays though its slot is that of a text with copies, and equal rows stay once."""
    from rankloom.llm import common, exact_dedup

    spread = spark.range(30_000).select("id", F.xxhash64(F.sha2(F.concat(F.lit("text "), F.col("id").cast("string")).cast("binary"), 256)).bitwiseAND(F.lit(common.SLOTS - 1)).alias("at"))
    a, b = next(sorted(r.ids) for r in spread.groupBy("at").agg(F.collect_list("id").alias("ids")).filter("size(ids) > 1").collect())[:2]
    rows = [(1, f"text {a}"), (1, f"text {a}"), (2, f"text  {a}"), (3, f"text {a}"), (4, f"text {b}"), (None, f"text {b}."), (5, "other")]
    left = exact_dedup.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sf_dir)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("1", f"text {a}"), ("4", f"text {b}"), ("None", f"text {b}."), ("5", "other")])


def test_rewired_graph_holds_every_line(spark, sf_dir, monkeypatch):
    """Every line item is an edge of its supplier and customer, whatever its quantity."""
    from rankloom.plans import catalog, null_queries

    monkeypatch.setattr(null_queries, "rewire", lambda e, swap_factor: (e.select("a", "b").distinct(), {}))  # swaps keep the degrees
    got = {r.node: r.degree for r in catalog.queries()["rewired_degrees"](spark, sf_dir).collect()}
    lines, orders = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    e = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey")[["l_suppkey", "o_custkey"]].drop_duplicates()
    want = pd.concat([e["l_suppkey"].value_counts(), e["o_custkey"].rename_axis(None).add(1_000_000_000).value_counts()])
    assert got == want.to_dict()
