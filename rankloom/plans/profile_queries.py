"""Type profiles, mixtures, state allocation, domain and size filters, folds and guards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import statistics as T
from rankloom.operators.ranks import average_rank
from rankloom.plans.base import query, r6
from rankloom.plans.resample_queries import _u
from rankloom.sources.relations import ASSAY, COUNTS, RANKED

_CPM = f"{COUNTS}, kf AS (SELECT kind, feature, sum(n)::DOUBLE AS n FROM counts GROUP BY 1, 2), kt AS (SELECT kind, sum(n) AS total FROM kf GROUP BY 1), pr AS (SELECT kf.kind, feature, n / total AS share, log2(1e6 * n / total + 1) AS l FROM kf JOIN kt ON kf.kind = kt.kind)"


def _profiles(t):
    """(kind, feature, share, l): every kind's feature shares and their log2 counts per million; kinds times features rows."""
    k = t.counts.groupBy("kind", "feature").agg(F.sum("n").cast("double").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("kind"))
    return k.select("kind", "feature", share.alias("share")).withColumn("l", F.log2(1e6 * F.col("share") + 1))


@query(f"WITH {_CPM}, s AS (SELECT feature, avg(l) AS m, stddev_samp(l) AS sd, max(l) AS top, max(exp2(l) - 1) AS mx, sum(exp2(l) - 1) AS tot, count(*) AS n FROM (SELECT *, power(2, l) AS p2 FROM pr) GROUP BY 1), o AS (SELECT feature, kind, row_number() OVER (PARTITION BY feature ORDER BY round(l, 9) DESC, kind) AS k FROM pr) SELECT s.feature, a.kind AS top_kind, b.kind AS second_kind, round((top - m) / (sd + 1e-6), 5) AS top_z, round((n - tot / (mx + 1e-12)) / (n - 1), 5) AS tau, round(mx / (tot + 1e-12), 6) AS top_share FROM s JOIN o a ON s.feature = a.feature AND a.k = 1 JOIN o b ON s.feature = b.feature AND b.k = 2".replace("exp2(l)", "power(2, l)"))
def localisation(t):
    """Where a feature is expressed: its first two kinds, z of the first, tau and share."""
    p = _profiles(t)
    lin = F.pow(F.lit(2.0), F.col("l")) - 1
    s = p.groupBy("feature").agg(F.avg("l").alias("m"), F.stddev_samp("l").alias("sd"), F.max("l").alias("top"), F.max(lin).alias("mx"), F.sum(lin).alias("tot"), F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(W.partitionBy("feature").orderBy(F.desc(F.round("l", 9)), "kind"))
    o = p.withColumn("k", k).filter("k <= 2").groupBy("feature").agg(F.max(F.when(F.col("k") == 1, F.col("kind"))).alias("top_kind"), F.max(F.when(F.col("k") == 2, F.col("kind"))).alias("second_kind"))
    return s.join(o, "feature").filter("second_kind IS NOT NULL").select("feature", "top_kind", "second_kind", F.round((F.col("top") - F.col("m")) / (F.col("sd") + 1e-6), 5).alias("top_z"), F.round((F.col("n") - F.col("tot") / (F.col("mx") + 1e-12)) / (F.col("n") - 1), 5).alias("tau"), r6(F.col("mx") / (F.col("tot") + 1e-12), "top_share"))


@query(f"WITH {ASSAY}, {RANKED}, b AS (SELECT feature, avg(m) AS bulk FROM (SELECT cohort, feature, avg(r) AS m FROM ranks GROUP BY 1, 2) GROUP BY 1), r AS (SELECT feature, avg(value) AS v FROM assay WHERE label = 0 GROUP BY 1), rr AS (SELECT feature, (rank() OVER (ORDER BY v) - 1.0::DOUBLE) / (count(*) OVER () - 1) AS ref FROM r) SELECT b.feature, round(bulk, 6) AS bulk_rank, round(ref, 6) AS ref_rank, round(bulk - ref, 6) AS diff, abs(round(bulk - ref, 6)) <= 0.25 AS keep FROM b JOIN rr ON b.feature = rr.feature")
def domain_filter(t):
    """Features whose mean rank over units (a mean of unit means, so that no large unit leads) is near their rank in the reference."""
    from rankloom.operators.signatures import full_ranks

    b = full_ranks(t.assay).groupBy("cohort", "feature").agg(F.avg("r").alias("m")).groupBy("feature").agg(F.avg("m").alias("bulk"))
    r = t.assay.filter("label = 0").groupBy("feature").agg(F.avg("value").alias("v")).withColumn("all", F.lit(1))  # one short list: the features
    w = W.partitionBy("all")
    ref = r.select("feature", ((F.rank().over(w.orderBy("v")) - 1) / (F.count(F.lit(1)).over(w) - 1)).alias("ref"))
    d = F.round(F.col("bulk") - F.col("ref"), 6) + F.lit(0.0)
    return b.join(ref, "feature").select("feature", r6("bulk", "bulk_rank"), r6("ref", "ref_rank"), d.alias("diff"), (F.abs(d) <= 0.25).alias("keep"))


_W = f"g AS (SELECT mixture, kind, -ln({_u('mix', 'mixture', 'kind')} + 1e-9) AS e FROM (SELECT DISTINCT kind FROM pr), (SELECT unnest(range(1, 21)) AS mixture)), w AS (SELECT mixture, kind, e / sum(e) OVER (PARTITION BY mixture) AS w FROM g)"


def _weights(t, mixtures: int = 20):
    """Flat Dirichlet weights of the kinds in each mixture, from hashed exponentials; kinds times mixtures rows."""
    k = t.counts.select("kind").distinct().withColumn("mixture", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(mixtures).cast("long"))))
    e = k.withColumn("e", -F.ln(T.unit_random("mix", F.col("mixture"), F.col("kind")) + 1e-9))
    return e.select("mixture", "kind", (F.col("e") / F.sum("e").over(W.partitionBy("mixture"))).alias("w"))


@query(f"WITH {_CPM}, {_W} SELECT mixture, feature, round(1e6 * sum(w * share), 4) AS cpm FROM w JOIN pr ON w.kind = pr.kind GROUP BY 1, 2")
def mixture_builder(t):
    """Pseudo-bulk mixtures of the kinds' profiles under drawn weights."""
    m = _weights(t).join(_profiles(t), "kind")
    return m.groupBy("mixture", "feature").agg(F.round(1e6 * F.sum(F.col("w") * F.col("share")), 4).alias("cpm"))


_OWN = "ow AS (SELECT feature, arg_max(kind, struct_pack(a := round(share, 12), b := kind)) AS kind FROM pr GROUP BY 1)"


@query(f"WITH {_CPM}, {_W}, {_OWN}, mx AS (SELECT mixture, feature, sum(w * share) AS x FROM w JOIN pr ON w.kind = pr.kind GROUP BY 1, 2), e AS (SELECT mixture, ow.kind, sum(x) / any_value(s) AS est FROM mx JOIN ow ON mx.feature = ow.feature JOIN (SELECT pr.kind, sum(share) AS s FROM pr JOIN ow ON pr.kind = ow.kind AND pr.feature = ow.feature GROUP BY 1) o ON ow.kind = o.kind GROUP BY 1, 2) SELECT e.kind, round(regr_slope(est, w), 4) AS slope, round(sum(est) / sum(w), 4) AS ratio, round(corr(est, w), 4) AS r FROM e JOIN w ON e.kind = w.kind AND e.mixture = w.mixture GROUP BY 1")
def sensitivity_recovery(t):
    """How far the weights of known mixtures come back from the features that each kind owns: slope, ratio and correlation."""
    p, w = _profiles(t), _weights(t)
    own = p.groupBy("feature").agg(F.max_by("kind", F.struct(F.round("share", 12), "kind")).alias("kind"))
    held = p.join(own, ["kind", "feature"]).groupBy("kind").agg(F.sum("share").alias("s"))
    x = w.join(p, "kind").groupBy("mixture", "feature").agg(F.sum(F.col("w") * F.col("share")).alias("x"))
    e = x.join(own, "feature").groupBy("mixture", "kind").agg(F.sum("x").alias("x")).join(held, "kind").withColumn("est", F.col("x") / F.col("s"))
    j = e.join(w, ["mixture", "kind"])
    return j.groupBy("kind").agg(F.round(F.regr_slope("est", "w"), 4).alias("slope"), F.round(F.sum("est") / F.sum("w"), 4).alias("ratio"), F.round(F.corr("est", "w"), 4).alias("r"))


_ALLOC = f"{_CPM}, df AS (SELECT donor, feature, sum(n)::DOUBLE AS e FROM counts GROUP BY 1, 2), dk AS (SELECT donor, kind, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY donor) AS p FROM counts GROUP BY 1, 2), m AS (SELECT dk.donor, dk.kind, pr.feature, p * share AS m, sum(p * share) OVER (PARTITION BY dk.donor, pr.feature) AS mh FROM dk JOIN pr ON dk.kind = pr.kind), tot AS (SELECT donor, sum(e) AS te FROM df GROUP BY 1), th AS (SELECT donor, sum(m) AS tm FROM m GROUP BY 1), r AS (SELECT m.donor, m.kind, m.feature, m / mh AS w, log2(coalesce(e, 0) + 1) - log2(mh / tm * te + 1) AS r FROM m JOIN tot ON m.donor = tot.donor JOIN th ON m.donor = th.donor LEFT JOIN df ON m.donor = df.donor AND m.feature = df.feature)"


@query(f"WITH {_ALLOC} SELECT donor, kind, round(sum(w * r) / sum(w), 5) AS state FROM r GROUP BY 1, 2")
def state_allocation(t):
    """Each donor's deviation from what its composition predicts, given to the kinds by their expected part in every feature."""
    c = t.counts
    e = c.groupBy("donor", "feature").agg(F.sum("n").cast("double").alias("e"))
    p = c.groupBy("donor", "kind").agg(F.sum("n").cast("double").alias("n")).select("donor", "kind", (F.col("n") / F.sum("n").over(W.partitionBy("donor"))).alias("p"))
    m = p.join(_profiles(t), "kind").select("donor", "kind", "feature", (F.col("p") * F.col("share")).alias("m"))
    hat = m.groupBy("donor", "feature").agg(F.sum("m").alias("mh"))
    tot = e.groupBy("donor").agg(F.sum("e").alias("te")).join(hat.groupBy("donor").agg(F.sum("mh").alias("tm")), "donor")
    r = F.log2(F.coalesce("e", F.lit(0.0)) + 1) - F.log2(F.col("mh") / F.col("tm") * F.col("te") + 1)
    resid = hat.join(tot, "donor").join(e, ["donor", "feature"], "left").select("donor", "feature", "mh", r.alias("r"))
    part = F.col("m") / F.col("mh")
    return m.join(resid, ["donor", "feature"]).groupBy("donor", "kind").agg(F.round(F.sum(part * F.col("r")) / F.sum(part), 5).alias("state"))


@query(f"WITH {COUNTS}, d AS (SELECT donor, kind, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY donor) AS p FROM counts GROUP BY 1, 2) SELECT kind, count(*) AS donors, round(min(p), 6) AS lo, round(avg(p), 6) AS mean, round(max(p), 6) AS hi, round(avg((p BETWEEN 0.005 AND 0.5)::INT), 6) AS plausible FROM d GROUP BY 1")
def plausibility_summary(t):
    """Range of every kind's proportion and the share of donors within plausible bounds."""
    d = t.counts.groupBy("donor", "kind").agg(F.sum("n").cast("double").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("donor")))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("donors"), r6(F.min("p"), "lo"), r6(F.avg("p"), "mean"), r6(F.max("p"), "hi"), r6(F.avg(F.col("p").between(0.005, 0.5).cast("double")), "plausible"))


_PAIRED = "f AS (SELECT l_suppkey AS donor, p_brand AS feature, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), l AS (SELECT donor, feature, log2(1e6 * a / sum(a) OVER w + 1) - log2(1e6 * b / sum(b) OVER w + 1) AS d FROM f WINDOW w AS (PARTITION BY donor)), s AS (SELECT feature, count(d) AS n, avg(d) AS lfc, stddev_samp(d) AS sd, avg((d > 0)::INT) AS up FROM l GROUP BY 1), z AS (SELECT *, round(lfc / (sd / sqrt(n) + 1e-12), 6) AS t, round(lfc / (sd + 1e-9), 6) AS dz FROM s), c AS (SELECT *, CASE WHEN abs(t) >= 1.96 AND abs(lfc) >= 0.25 THEN CASE WHEN lfc > 0 THEN 'up' ELSE 'down' END ELSE '' END AS call FROM z)"


@query(f"WITH {_PAIRED} SELECT feature, n, round(lfc, 5) AS log2fc, dz, t, round(up, 6) AS share_up, call, call <> '' AND row_number() OVER (PARTITION BY call ORDER BY abs(dz) DESC, feature) <= 5 AS in_score_set FROM c")
def program_call(t):
    """Paired contrast of two states within donors, the features that it calls up or down, and the first five of each for scoring."""
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature"))
    side = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0))
    f = t.lineitem.join(part, "l_partkey").groupBy(F.col("l_suppkey").alias("donor"), "feature").agg(side("R").alias("a"), side("N").alias("b"))
    w = W.partitionBy("donor")
    cpm = lambda c: F.log2(1e6 * F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0.0)) + 1)
    d = f.select("feature", (cpm("a") - cpm("b")).alias("d"))
    s = d.groupBy("feature").agg(F.count("d").alias("n"), F.avg("d").alias("lfc"), F.stddev_samp("d").alias("sd"), F.avg((F.col("d") > 0).cast("double")).alias("up"))
    z = s.withColumn("t", F.round(F.col("lfc") / (F.col("sd") / F.sqrt("n") + 1e-12), 6)).withColumn("dz", F.round(F.col("lfc") / (F.col("sd") + 1e-9), 6))
    c = z.withColumn("call", F.when((F.abs("t") >= 1.96) & (F.abs("lfc") >= 0.25), F.when(F.col("lfc") > 0, "up").otherwise("down")).otherwise(""))
    k = F.row_number().over(W.partitionBy("call").orderBy(F.desc(F.abs("dz")), "feature"))
    return c.select("feature", "n", F.round("lfc", 5).alias("log2fc"), "dz", "t", r6("up", "share_up"), "call", ((F.col("call") != "") & (k <= 5)).alias("in_score_set"))


@query(f"WITH {ASSAY}, {RANKED}, q AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT feature, avg(value) AS v FROM assay WHERE label = 0 GROUP BY 1)), n AS (SELECT count(*) - 1 AS top FROM q), x AS (SELECT sample, feature, r * top AS spot FROM ranks, n) SELECT sample, feature, round(lo.v + (spot - floor(spot)) * (hi.v - lo.v), 5) AS level FROM x JOIN q lo ON lo.i = floor(spot)::BIGINT JOIN q hi ON hi.i = ceil(spot)::BIGINT")
def rank_to_quantile(t):
    """A sample's ranks read as quantiles of a reference distribution, with linear interpolation between its order statistics."""
    from rankloom.operators.signatures import full_ranks

    ref = t.assay.filter("label = 0").groupBy("feature").agg(F.avg("value").alias("v"))
    q = ref.agg(F.array_sort(F.collect_list("v")).alias("q"))  # one short list: the features
    x = full_ranks(t.assay).select("sample", "feature", "r").join(F.broadcast(q)).withColumn("at", F.col("r") * (F.size("q") - 1))
    lo, hi = F.get("q", F.floor("at").cast("int")), F.get("q", F.ceil("at").cast("int"))
    return x.select("sample", "feature", F.round(lo + (F.col("at") - F.floor("at")) * (hi - lo), 5).alias("level"))


@query(f"WITH {ASSAY}, e AS (SELECT sample, feature, greatest(power(2, value) - 0.5, 0) AS x FROM assay) SELECT sample, feature, round(10000 * x / sum(x) OVER (PARTITION BY sample), 3) AS scaled, floor(10000 * x / sum(x) OVER (PARTITION BY sample) + 0.5)::BIGINT AS n FROM e")
def log_to_linear_counts(t):
    """Log values back on the linear scale, scaled to one total per sample and rounded to counts."""
    e = t.assay.select("sample", "feature", F.greatest(F.pow(F.lit(2.0), F.col("value")) - 0.5, F.lit(0.0)).alias("x"))
    y = 10000 * F.col("x") / F.sum("x").over(W.partitionBy("sample"))
    return e.select("sample", "feature", F.round(y, 3).alias("scaled"), F.floor(y + 0.5).cast("long").alias("n"))


@query(f"WITH {ASSAY}, z AS (SELECT sample, avg(value) AS z FROM assay GROUP BY 1), c AS (SELECT feature, value, z FROM assay JOIN z ON assay.sample = z.sample), b AS (SELECT feature, covar_pop(value, z) * count(*) / (var_pop(z) * count(*) + 1.0) AS b, avg(value) AS my, avg(z) AS mz FROM c GROUP BY 1) SELECT b.feature, round(any_value(b), 6) AS slope, round(var_samp(value - my - b * (z - mz)), 6) AS residual_variance FROM c JOIN b ON c.feature = b.feature GROUP BY 1")
def ridge_residual(t):
    """Every feature's residual on a sample covariate under a ridge of one: slope and residual variance, all from sums."""
    z = t.assay.groupBy("sample").agg(F.avg("value").alias("z"))
    c = t.assay.join(z, "sample")
    s = c.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("value", "z").alias("cxy"), F.var_pop("z").alias("vz"), F.var_pop("value").alias("vy"))
    b = F.col("cxy") * F.col("n") / (F.col("vz") * F.col("n") + 1.0)
    rest = (F.col("vy") - 2 * F.col("b") * F.col("cxy") + F.col("b") * F.col("b") * F.col("vz")) * F.col("n") / (F.col("n") - 1)
    return s.withColumn("b", b).select("feature", r6("b", "slope"), r6(rest, "residual_variance"))


@query("WITH u AS (SELECT DISTINCT l_partkey AS member FROM lineitem WHERE l_quantity >= 49), s AS (SELECT p_brand AS set_id, p_partkey AS member FROM part), i AS (SELECT set_id, count(*) AS size, count(u.member) AS measured FROM s LEFT JOIN u ON s.member = u.member GROUP BY 1) SELECT set_id, size, measured, measured BETWEEN 10 AND 500 AS usable FROM i")
def set_size_filter(t):
    """Sets cut to the measured universe, usable from 10 to 500 members."""
    u = t.lineitem.filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("hit")).distinct()
    i = t.part.select("p_partkey", F.col("p_brand").alias("set_id")).join(u, "p_partkey", "left").groupBy("set_id").agg(F.count(F.lit(1)).alias("size"), F.count("hit").alias("measured"))
    return i.withColumn("usable", F.col("measured").between(10, 500))


@query("WITH k AS (SELECT DISTINCT p_size AS feature FROM part WHERE p_type LIKE '%BRASS%' AND p_size <= 25), f AS (SELECT DISTINCT p_size AS feature FROM part) SELECT f.feature, CASE WHEN k.feature IS NULL THEN 'novel' ELSE 'known' END AS status FROM f LEFT JOIN k ON f.feature = k.feature")
def known_vs_novel(t):
    known = t.part.filter("p_type LIKE '%BRASS%' AND p_size <= 25").select(F.col("p_size").alias("feature"), F.lit("known").alias("status")).distinct()
    return t.part.select(F.col("p_size").alias("feature")).distinct().join(known, "feature", "left").select("feature", F.coalesce("status", F.lit("novel")).alias("status"))


@query(f"WITH g AS (SELECT o_custkey AS grp, max((o_orderstatus = 'F')::INT) AS cls, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT grp, cls, n, (row_number() OVER (PARTITION BY cls, n ORDER BY {_u('fold', 'grp')}, grp) - 1 + n) % 5 AS fold FROM g) SELECT fold::BIGINT AS fold, cls, count(*) AS groups, sum(n)::BIGINT AS n FROM f GROUP BY 1, 2")
def stratified_group_folds(t):
    """Groups stay whole: those of one class and size are dealt to the folds in turn, so classes and sizes are spread alike."""
    g = t.orders.groupBy(F.col("o_custkey").alias("grp")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("cls"), F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(W.partitionBy("cls", "n").orderBy(T.unit_random("fold", F.col("grp")), "grp"))
    return g.withColumn("fold", ((k - 1 + F.col("n")) % 5).cast("long")).groupBy("fold", "cls").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"))


@query(f"WITH {ASSAY}, ref AS (SELECT feature, avg(value) AS v FROM assay WHERE label = 0 GROUP BY 1) SELECT a.sample, a.feature, count(ref.v) AS below FROM assay a LEFT JOIN ref ON ref.v < a.value WHERE a.label = 1 GROUP BY 1, 2")
def searchsorted_rank(t):
    """Place of every value in a sorted reference row, by halving over the reference as one short array."""
    q = t.assay.filter("label = 0").groupBy("feature").agg(F.avg("value").alias("v")).agg(F.array_sort(F.collect_list("v")).alias("q"))  # one short list: the features
    return t.assay.filter("label = 1").join(F.broadcast(q)).select("sample", "feature", F.size(F.filter("q", lambda x: x < F.col("value"))).cast("long").alias("below"))


@query("SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100) ORDER BY p_name, p_partkey")
def topn_then_lexical(t):
    """The hundred dearest, in the order of their names."""
    return t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT p_partkey AS id, p_brand AS meta_brand, p_type AS meta_type, p_size AS meta_size FROM part")
def prefixed_columns(t):
    """Some columns by their prefix, renamed to another one."""
    wanted = [c for c in t.part.columns if c.startswith("p_") and c in ("p_brand", "p_type", "p_size")]
    return t.part.select(F.col("p_partkey").alias("id"), *(F.col(c).alias("meta_" + c.removeprefix("p_")) for c in wanted))


@query("SELECT l_returnflag, round(var_samp(l_extendedprice), 2) AS var1, round(var_pop(l_extendedprice), 2) AS var0, round(stddev_samp(l_quantity), 6) AS sd1, round(stddev_pop(l_quantity), 6) AS sd0 FROM lineitem GROUP BY 1")
def variance_by_ddof(t):
    x, y = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.var_samp(x), 2).alias("var1"), F.round(F.var_pop(x), 2).alias("var0"), r6(F.stddev_samp(y), "sd1"), r6(F.stddev_pop(y), "sd0"))


_FOLDS = "f AS (SELECT o_orderkey AS sample, o_orderpriority AS cohort, o_orderstatus AS class, CASE WHEN o_orderpriority = '5-LOW' THEN 'target' WHEN o_orderstatus = 'P' THEN 'external' ELSE 'dev' END AS role FROM orders)"


def _folds(t):
    role = F.when(F.col("o_orderpriority") == "5-LOW", "target").when(F.col("o_orderstatus") == "P", "external").otherwise("dev")
    return t.orders.select(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("cohort"), F.col("o_orderstatus").alias("class"), role.alias("role"))


@query(f"WITH {_FOLDS} SELECT cohort, class, count(*) AS rows FROM f WHERE role = 'dev' AND (cohort = '5-LOW' OR class = 'P') GROUP BY 1, 2")
def forbidden_rows_in_dev(t):
    """Invariant: neither the held-back cohort nor the target class stands in the development rows. Every row returned breaks it."""
    return _folds(t).filter("role = 'dev' AND (cohort = '5-LOW' OR class = 'P')").groupBy("cohort", "class").agg(F.count(F.lit(1)).alias("rows"))


@query("WITH a AS (SELECT 'nation' AS name, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', n_nationkey, n_name, n_regionkey)), 1, 12))::BIGINT)::DOUBLE AS h FROM nation UNION ALL SELECT 'region', count(*), sum(('0x' || substr(md5(concat_ws('|', r_regionkey, r_name)), 1, 12))::BIGINT)::DOUBLE FROM region) SELECT name, n, h AS frozen, h AS now, TRUE AS unchanged FROM a")
def frozen_input_check(t):
    """Order-free digests of inputs, as frozen before a run and as they are now; a run may go on only where they agree."""

    def digest(df, name, *cols):
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in cols))), 1, 12), 16, 10).cast("long")
        return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(h).cast("double").alias("h"))

    both = lambda: digest(t.nation, "nation", "n_nationkey", "n_name", "n_regionkey").union(digest(t.region, "region", "r_regionkey", "r_name"))
    now = both().select("name", F.col("h").alias("now"))
    return both().withColumnRenamed("h", "frozen").join(now, "name").select("name", "n", "frozen", "now", (F.col("frozen") == F.col("now")).alias("unchanged"))
