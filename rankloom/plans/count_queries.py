"""Counts to pseudobulk, compositions, counterfactuals and exact attribution."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.plans.base import query, r6
from rankloom.sources.relations import COUNTS

_PB = f"{COUNTS}, pb AS (SELECT donor, kind, feature, sum(n)::BIGINT AS n, count(*) AS n_cells FROM counts GROUP BY 1, 2, 3)"


def _pb(t):
    return t.counts.groupBy("donor", "kind", "feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_cells"))


@query(f"WITH {_PB} SELECT donor, kind, feature, n, n_cells FROM pb")
def pseudobulk(t):
    return _pb(t)


@query(f"WITH {COUNTS}, m AS (SELECT kind, unnest([substr(kind, 1, 7), 'ALL']) AS grp FROM (SELECT DISTINCT p_brand AS kind FROM part)) SELECT donor, grp, sum(n)::BIGINT AS n FROM counts JOIN m ON counts.kind = m.kind GROUP BY 1, 2")
def pseudobulk_relabel_overlap(t):
    """Overlapping labels: a row counts once in each of its groups; the map is a join fan-out on the aggregated rows."""
    pb = t.counts.groupBy("donor", "kind").agg(F.sum("n").alias("n"))
    return pb.select("donor", "n", F.explode(F.array(F.substring("kind", 1, 7), F.lit("ALL"))).alias("grp")).groupBy("donor", "grp").agg(F.sum("n").alias("n"))


@query(f"WITH {_PB} SELECT donor, kind, feature, round(log2(n / greatest(sum(n) OVER (PARTITION BY donor, kind), 1) * 1e6 + 1), 6) AS v FROM pb")
def log2cpm(t):
    lib = F.greatest(F.sum("n").over(W.partitionBy("donor", "kind")), F.lit(1))
    return _pb(t).select("donor", "kind", "feature", r6(F.log2(F.col("n") / lib * 1e6 + 1), "v"))


@query(f"WITH {COUNTS}, s AS (SELECT donor, kind, sum(n) AS n FROM counts GROUP BY 1, 2) SELECT donor, kind, round(n / sum(n) OVER (PARTITION BY donor), 6) AS share FROM s")
def state_fractions(t):
    s = t.counts.groupBy("donor", "kind").agg(F.sum("n").alias("n"))
    return s.select("donor", "kind", r6(F.col("n") / F.sum("n").over(W.partitionBy("donor")), "share"))


@query(f"WITH {COUNTS}, s AS (SELECT donor, kind, ln(sum(n) + 0.5::DOUBLE) AS l FROM counts GROUP BY 1, 2) SELECT donor, kind, round(l - avg(l) OVER (PARTITION BY donor), 6) AS clr FROM s")
def clr_composition(t):
    s = t.counts.groupBy("donor", "kind").agg(F.ln(F.sum("n") + 0.5).alias("l"))
    return s.select("donor", "kind", r6(F.col("l") - F.avg("l").over(W.partitionBy("donor")), "clr"))


@query(f"WITH {COUNTS}, s AS (SELECT kind, feature, sum(n) AS n FROM counts GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY kind) AS p FROM s), o AS (SELECT *, p / sum(p) OVER (PARTITION BY feature) AS own FROM p) SELECT kind, feature, round(own, 6) AS own FROM o WHERE own > 0.15")
def owned_features(t):
    s = t.counts.groupBy("kind", "feature").agg(F.sum("n").alias("n"))
    p = s.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("kind")))
    return p.withColumn("own", F.col("p") / F.sum("p").over(W.partitionBy("feature"))).filter("own > 0.15").select("kind", "feature", r6("own"))


_CF = f"{COUNTS}, d AS (SELECT donor % 2 AS arm, kind, sum(n)::DOUBLE AS n, avg(feature) AS m FROM counts GROUP BY 1, 2), p AS (SELECT arm, kind, m, n / sum(n) OVER (PARTITION BY arm) AS p FROM d), j AS (SELECT a.kind, a.p AS p1, a.m AS m1, b.p AS p0, b.m AS m0 FROM p a JOIN p b ON a.kind = b.kind AND a.arm = 1 AND b.arm = 0)"


def _arms(t):
    d = t.counts.groupBy((F.col("donor") % 2).alias("arm"), "kind").agg(F.sum("n").cast("double").alias("n"), F.avg("feature").alias("m"))
    p = d.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("arm")))
    side = lambda k, c: F.max(F.when(F.col("arm") == k, F.col(c))).alias(f"{c}{k}")
    return p.groupBy("kind").agg(side(1, "p"), side(1, "m"), side(0, "p"), side(0, "m")).na.drop()


@query(f"WITH {_CF} SELECT round(sum(p1 * m1), 6) AS full_tissue, round(sum(p1 * m0), 6) AS comp_only, round(sum(p0 * m1), 6) AS state_only, round(sum(p0 * m0), 6) AS reference FROM j")
def counterfactual_comp_state(t):
    s = lambda p, m, n: r6(F.sum(F.col(p) * F.col(m)), n)
    return _arms(t).agg(s("p1", "m1", "full_tissue"), s("p1", "m0", "comp_only"), s("p0", "m1", "state_only"), s("p0", "m0", "reference"))


@query(f"WITH {COUNTS}, r AS (SELECT kind, feature, avg(n) AS x FROM counts WHERE donor % 3 = 0 GROUP BY 1, 2), a AS (SELECT kind, feature, avg(n) AS x FROM counts GROUP BY 1, 2), g AS (SELECT feature, avg(n) AS x FROM counts GROUP BY 1), k AS (SELECT DISTINCT kind FROM counts) SELECT k.kind, g.feature, round(coalesce(r.x, a.x, g.x), 6) AS x, CASE WHEN r.x IS NOT NULL THEN 'ref' WHEN a.x IS NOT NULL THEN 'all' ELSE 'pooled' END AS used FROM k, g LEFT JOIN r ON r.kind = k.kind AND r.feature = g.feature LEFT JOIN a ON a.kind = k.kind AND a.feature = g.feature")
def ref_profile_fallback(t):
    """Reference profile, else all donors, else pooled kinds."""
    n = F.col("n")
    own = t.counts.groupBy("kind", "feature").agg(F.avg(F.when(F.col("donor") % 3 == 0, n)).alias("r"), F.avg(n).alias("a"))
    g = t.counts.groupBy("feature").agg(F.avg(n).alias("g"))
    grid = t.part.select(F.col("p_brand").alias("kind")).distinct().join(F.broadcast(g))
    kinds = t.counts.select("kind").distinct()
    j = grid.join(kinds, "kind", "left_semi").join(own, ["kind", "feature"], "left")
    return j.select("kind", "feature", r6(F.coalesce("r", "a", "g"), "x"), F.when(F.col("r").isNotNull(), "ref").when(F.col("a").isNotNull(), "all").otherwise("pooled").alias("used"))


_SH = "f AS (SELECT l_returnflag || l_linestatus AS grp, log(avg(l_quantity)) AS a, log(avg(l_extendedprice)) AS b, avg(l_discount) AS c, avg(l_tax) AS d FROM lineitem GROUP BY 1), r AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(d) AS d FROM f), v AS (SELECT grp, mask, (CASE WHEN mask & 1 > 0 THEN f.a ELSE r.a END) * (CASE WHEN mask & 2 > 0 THEN f.b ELSE r.b END) * (1 - (CASE WHEN mask & 4 > 0 THEN f.c ELSE r.c END)) * (1 + (CASE WHEN mask & 8 > 0 THEN f.d ELSE r.d END)) AS v FROM f, r, (SELECT unnest(range(0, 16)) AS mask)), s AS (SELECT x.grp, i, sum((y.v - x.v) * CASE bit_count(x.mask) WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 1 / 12 WHEN 2 THEN 1 / 12 ELSE 0.25::DOUBLE END) AS phi FROM v x, (SELECT unnest(range(0, 4)) AS i) JOIN v y ON y.grp = x.grp AND y.mask = (x.mask | (1 << i)) AND x.mask & (1 << i) = 0 GROUP BY 1, 2)"


def _shapley(t):
    """Exact Shapley over the 2^4 subsets of four factors: all subsets of a group are one array, so there is no join at all."""
    n = 4
    f = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("grp")).agg(F.log10(F.avg("l_quantity")).alias("a"), F.log10(F.avg("l_extendedprice")).alias("b"), F.avg("l_discount").alias("c"), F.avg("l_tax").alias("d"))
    r = f.agg(*(F.avg(c).alias(f"{c}0") for c in "abcd"))
    j = f.join(F.broadcast(r))
    on = lambda k, c, m: F.when(m.bitwiseAND(1 << k) > 0, F.col(c)).otherwise(F.col(f"{c}0"))
    value = F.transform(F.sequence(F.lit(0), F.lit(2**n - 1)), lambda m: on(0, "a", m) * on(1, "b", m) * (1 - on(2, "c", m)) * (1 + on(3, "d", m)))
    weight = [1 / (n * [1, 3, 3, 1][k]) for k in range(n)]
    v = j.withColumn("v", value)
    phis = [sum((F.col("v")[m | 1 << i] - F.col("v")[m]) * weight[m.bit_count()] for m in range(2**n) if not m >> i & 1) for i in range(n)]
    return v.select("grp", F.posexplode(F.array(*phis)).alias("i", "phi"))


@query(f"WITH {_SH} SELECT grp, i, round(phi, 6) AS phi FROM s")
def shapley_exact(t):
    return _shapley(t).select("grp", F.col("i").cast("long").alias("i"), r6("phi"))


@query(f"WITH {_SH} SELECT grp, CASE WHEN i < 2 THEN 'size' ELSE 'terms' END AS block, round(sum(phi), 6) AS phi FROM s GROUP BY 1, 2")
def shapley_blocks(t):
    return _shapley(t).groupBy("grp", F.when(F.col("i") < 2, "size").otherwise("terms").alias("block")).agg(r6(F.sum("phi"), "phi"))


@query(f"WITH {COUNTS}, c AS (SELECT donor, count(*) AS n_counts, count(DISTINCT feature) AS n_features, sum((kind LIKE 'Brand#1%')::INT) / count(*) AS mito FROM counts GROUP BY 1), q AS (SELECT quantile_cont(n_features, 0.99) AS hi FROM c) SELECT donor, n_counts, n_features, round(mito, 6) AS mito, n_features >= 20 AND n_features <= hi AND mito < 0.5 AS pass FROM c, q")
def cell_qc_metrics(t):
    c = t.counts.groupBy("donor").agg(F.count(F.lit(1)).alias("n_counts"), F.countDistinct("feature").alias("n_features"), F.avg(F.col("kind").startswith("Brand#1").cast("double")).alias("mito"))
    q = c.agg(F.percentile("n_features", F.lit(0.99)).alias("hi"))
    return c.join(F.broadcast(q)).select("donor", "n_counts", "n_features", r6("mito"), ((F.col("n_features") >= 20) & (F.col("n_features") <= F.col("hi")) & (F.col("mito") < 0.5)).alias("pass"))


@query(f"WITH {COUNTS}, p AS (SELECT donor, avg(n) AS x FROM counts GROUP BY 1), f AS (SELECT donor % 2 AS half, x, donor // 2 AS pair FROM p), j AS (SELECT a.x AS a, b.x AS b FROM f a JOIN f b ON a.pair = b.pair AND a.half = 0 AND b.half = 1) SELECT count(*) AS n, round(avg((sign(a - 25.5::DOUBLE) = sign(b - 25.5::DOUBLE))::INT), 6) AS concordance FROM j")
def replication_concordance(t):
    p = t.counts.groupBy("donor").agg(F.avg("n").alias("x")).select(F.floor(F.col("donor") / 2).alias("pair"), (F.col("donor") % 2).alias("half"), "x")
    side = lambda k: F.max(F.when(F.col("half") == k, F.col("x")))
    j = p.groupBy("pair").agg(side(0).alias("a"), side(1).alias("b")).na.drop()
    return j.agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.signum(F.col("a") - 25.5) == F.signum(F.col("b") - 25.5)).cast("double")), "concordance"))
