"""Meta-analysis in full, permutation tests over whole feature tables, small-sample resampling, reliability."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import statistics as T
from rankloom.operators.ranks import ordinal_rank, top_n
from rankloom.operators.replicates import cutoffs, weighted_sums, word_sql
from rankloom.plans.base import query, r6
from rankloom.plans.resample_queries import N_BOOT, N_PERM, _reps, _u
from rankloom.plans.stat_queries import _AUC, _DL, _g
from rankloom.sources.relations import ASSAY, CASES

#: 97.5 % points of Student's t for 1 to 10 degrees of freedom.
T975 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139]


@query(f"WITH {_DL}, h AS (SELECT u.feature, sqrt(sum((g - mu) * (g - mu) / (v + tau2)) / (greatest(any_value(k) - 1, 1) * sum(1 / (v + tau2)))) AS hk, avg((sign(g) = sign(mu))::INT) AS sign_frac, min(abs(g)) AS g_min FROM u JOIN dl ON u.feature = dl.feature GROUP BY 1) SELECT h.feature, round(mu / se, 5) AS z, round(abs(mu / greatest(hk, se * 0.001)), 5) AS t_hk, greatest(k - 1, 1) AS df, round(sign_frac, 6) AS sign_frac, round(g_min, 6) AS g_min FROM h JOIN dl ON h.feature = dl.feature")
def dl_hartung_knapp(t):
    """Hartung-Knapp t of each feature's random-effects mean, with the share of studies on its side."""
    g = _g(t)
    x = g.filter("g IS NOT NULL AND var_g > 0").join(T.random_effects(g, "feature"), "feature").withColumn("w", 1 / (F.col("var_g") + F.col("tau2")))
    gap = F.col("g") - F.col("mu")
    one = lambda c: F.max(c).alias(c)
    s = x.groupBy("feature").agg(one("mu"), one("se"), F.greatest(F.max("k") - 1, F.lit(1).cast("long")).alias("df"), F.sum(F.col("w") * gap * gap).alias("q"), F.sum("w").alias("sw"), F.avg((F.signum("g") == F.signum("mu")).cast("double")).alias("sign_frac"), F.min(F.abs("g")).alias("g_min"))
    hk = F.greatest(F.sqrt(F.col("q") / (F.col("df") * F.col("sw"))), F.col("se") * 0.001)
    return s.select("feature", F.round(F.col("mu") / F.col("se"), 5).alias("z"), F.round(F.abs(F.col("mu") / hk), 5).alias("t_hk"), "df", r6("sign_frac"), r6("g_min"))


_T = "CASE WHEN k - 2 <= 10 THEN [{0}][(k - 2)::INT] ELSE 1.959964 + 9.489099 / (4 * (k - 2)) + 271.0 / (96 * (k - 2) * (k - 2)) END".format(", ".join(map(str, T975)))


@query(f"WITH {_DL} SELECT feature, k, round(mu - 1.96 * se, 6) AS lo, round(mu + 1.96 * se, 6) AS hi, CASE WHEN k >= 3 THEN round(mu - {_T} * sqrt(tau2 + se * se), 5) END AS pi_lo, CASE WHEN k >= 3 THEN round(mu + {_T} * sqrt(tau2 + se * se), 5) END AS pi_hi FROM dl")
def dl_prediction_interval(t):
    """Confidence and prediction interval; the latter from three studies on, by Student's t with k - 2 degrees of freedom."""
    m = T.random_effects(_g(t), "feature")
    df = F.col("k") - 2
    point = F.when(df <= 10, F.get(F.array(*[F.lit(x) for x in T975]), (df - 1).cast("int"))).otherwise(1.959964 + 9.489099 / (4 * df) + 271.0 / (96 * df * df))
    half = point * F.sqrt(F.col("tau2") + F.col("se") * F.col("se"))
    return m.select("feature", "k", r6(F.col("mu") - 1.96 * F.col("se"), "lo"), r6(F.col("mu") + 1.96 * F.col("se"), "hi"), F.when(F.col("k") >= 3, F.round(F.col("mu") - half, 5)).alias("pi_lo"), F.when(F.col("k") >= 3, F.round(F.col("mu") + half, 5)).alias("pi_hi"))


def _tail(z):
    """Two-sided normal tail by the five-term rational fit (error under 2e-7), JVM-side."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    s = 1 / (1 + 0.3275911 * x)
    return s * (0.254829592 + s * (-0.284496736 + s * (1.421413741 + s * (-1.453152027 + s * 1.061405429)))) * F.exp(-x * x)


_TAIL = "(1 / (1 + 0.3275911 * {0})) * (0.254829592 + (1 / (1 + 0.3275911 * {0})) * (-0.284496736 + (1 / (1 + 0.3275911 * {0})) * (1.421413741 + (1 / (1 + 0.3275911 * {0})) * (-1.453152027 + (1 / (1 + 0.3275911 * {0})) * 1.061405429)))) * exp(-{0} * {0})"


@query("WITH " + _AUC.format(CASES, "cohort", "score", "cases") + ", m AS (SELECT cohort, p, q, auroc * p * q AS u, (auroc - 0.5) * p * q / sqrt(p::DOUBLE * q * (p + q + 1) / 12) AS z FROM auc) SELECT cohort, round(u, 1) AS u, round(z, 6) AS z, round(" + _TAIL.format("(abs(z) / sqrt(2.0::DOUBLE))") + ", 5) AS p FROM m")
def mann_whitney_p(t):
    """U, its normal deviate and two-sided p per cohort."""
    a = T.auroc(t.cases, "cohort")
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    z = (F.col("auroc") - 0.5) * p * q / F.sqrt(p * q * (p + q + 1) / 12)
    return a.select("cohort", F.round(F.col("auroc") * p * q, 1).alias("u"), z.alias("z")).select("cohort", "u", F.round(_tail(F.col("z")), 5).alias("p"), r6("z"))


_LFC = f"{ASSAY}, a AS (SELECT sample, feature, label, value FROM assay WHERE label IN (0, 1)), s AS (SELECT DISTINCT sample, label FROM a), n AS (SELECT sum(label) AS n1 FROM s), d AS (SELECT rep + 1 AS rep, sample, row_number() OVER (PARTITION BY rep ORDER BY {word_sql('lfc', 'rep', 'sample')}, sample) <= (SELECT n1 FROM n) AS pos FROM s, (SELECT unnest(range(0, {N_PERM})) AS rep) UNION ALL SELECT 0, sample, label = 1 FROM s), l AS (SELECT rep, feature, round(avg(value) FILTER (WHERE pos) - avg(value) FILTER (WHERE NOT pos), 9) AS d FROM a JOIN d ON a.sample = d.sample GROUP BY 1, 2)"
_BULK = "b0 AS (SELECT feature, avg(value) FILTER (WHERE label = 2) - avg(value) FILTER (WHERE label = 0) AS g FROM assay GROUP BY 1), b AS (SELECT feature, sign(g) AS s, row_number() OVER (ORDER BY abs(g) DESC, feature) <= 16 AS top FROM b0)"


def _lfc(t):
    """(rep, feature, d): mean difference of every feature under each of 1,000 assignments of labels; rep 0 is the observed one.

    The assignments are a matrix of signs over the samples, whose product with the value matrix is summed block by block.
    """
    e = t.embeddings.filter("label IN (0, 1)").select(F.lit(0).alias("all"), F.col("vec_id").alias("sample"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    n1 = e.agg(F.coalesce(F.sum("label"), F.lit(0))).first()[0]
    null = weighted_sums(e, "all", "sample", "x", "lfc", N_PERM, cutoffs(e, "sample", n1, "lfc", N_PERM))
    shift = F.transform(F.arrays_zip("s", "all_s"), lambda v: v["s"] / F.col("n") - (v["all_s"] - v["s"]) / (F.col("all_n") - F.col("n")))
    drawn = null.select((F.col("rep") + 1).alias("rep"), F.posexplode(shift).alias("p", "d")).select("rep", (F.col("p") + 1).cast("long").alias("feature"), F.round("d", 9).alias("d"))
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("value")))
    seen = t.assay.filter("label IN (0, 1)").groupBy("feature").agg(F.round(side(1) - side(0), 9).alias("d")).select(F.lit(0).cast("long").alias("rep"), "feature", "d")
    return drawn.union(seen)


@query(f"WITH {_LFC} SELECT o.feature, round(o.d, 6) AS delta, round((1 + sum((abs(l.d) >= abs(o.d))::INT)) / (1 + count(*)), 6) AS p FROM l o JOIN l ON o.feature = l.feature AND l.rep > 0 WHERE o.rep = 0 GROUP BY o.feature, o.d")
def permutation_all_features(t):
    """Permutation p of every feature's mean difference at once."""
    each = _lfc(t).groupBy("feature").agg(F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("o"), F.collect_list(F.when(F.col("rep") > 0, F.col("d"))).alias("n"))  # as many numbers as replicates
    hits = F.size(F.filter("n", lambda x: F.abs(x) >= F.abs(F.col("o"))))
    return each.select("feature", r6("o", "delta"), r6((1 + hits) / (1 + F.size("n")), "p"))


def _bulk(t):
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("value")))
    b = t.assay.groupBy("feature").agg((side(2) - side(0)).alias("g"))
    top = b.orderBy(F.desc(F.abs("g")), "feature").limit(16).select("feature", F.lit(True).alias("hit"))
    return b.join(F.broadcast(top), "feature", "left").select("feature", F.signum("g").alias("s"), F.coalesce("hit", F.lit(False)).alias("top"))


@query(f"WITH {_LFC}, {_BULK}, c AS (SELECT rep, round(avg((sign(d) = s)::INT) FILTER (WHERE top), 9) AS a, round(avg((sign(d) = s)::INT) FILTER (WHERE NOT top), 9) AS bg FROM l JOIN b ON l.feature = b.feature GROUP BY rep), o AS (SELECT a, bg, round(a - bg, 9) AS delta FROM c WHERE rep = 0) SELECT round(any_value(o.a), 6) AS agree_top, round(any_value(o.bg), 6) AS agree_background, round(any_value(delta), 6) AS delta, round((1 + sum((round(c.a - c.bg, 9) >= delta)::INT)) / (1 + count(*)), 6) AS p, round(avg(c.a), 6) AS null_agree FROM c, o WHERE rep > 0")
def direction_test(t):
    """Do the top features of one contrast keep their direction in another more often than the rest, against permuted labels?"""
    same = (F.signum("d") == F.col("s")).cast("double")
    c = _lfc(t).join(F.broadcast(_bulk(t)), "feature").groupBy("rep").agg(F.round(F.avg(F.when(F.col("top"), same)), 9).alias("a"), F.round(F.avg(F.when(~F.col("top"), same)), 9).alias("bg")).withColumn("e", F.round(F.col("a") - F.col("bg"), 9))
    o = c.filter("rep = 0").select(F.col("a").alias("oa"), F.col("bg").alias("ob"), F.col("e").alias("oe"))
    j = c.filter("rep > 0").join(F.broadcast(o))
    return j.agg(r6(F.max("oa"), "agree_top"), r6(F.max("ob"), "agree_background"), r6(F.max("oe"), "delta"), r6((1 + F.sum((F.col("e") >= F.col("oe")).cast("int"))) / (1 + F.count(F.lit(1))), "p"), r6(F.avg("a"), "null_agree"))


@query(f"WITH {_LFC}, {_BULK}, c AS (SELECT rep, round(avg((sign(d) = s)::INT), 9) AS a FROM l JOIN b ON l.feature = b.feature GROUP BY rep), o AS (SELECT a AS oa FROM c WHERE rep = 0) SELECT round(any_value(oa), 6) AS concordance, round((1 + sum((a >= oa)::INT)) / (1 + count(*)), 6) AS p, round(avg(a), 6) AS null_mean FROM c, o WHERE rep > 0")
def sign_concordance_permutation(t):
    c = _lfc(t).join(F.broadcast(_bulk(t)), "feature").groupBy("rep").agg(F.round(F.avg((F.signum("d") == F.col("s")).cast("double")), 9).alias("a"))
    j = c.filter("rep > 0").join(F.broadcast(c.filter("rep = 0").select(F.col("a").alias("oa"))))
    return j.agg(r6(F.max("oa"), "concordance"), r6((1 + F.sum((F.col("a") >= F.col("oa")).cast("int"))) / (1 + F.count(F.lit(1))), "p"), r6(F.avg("a"), "null_mean"))


_NATIONS = "v AS (SELECT n_nationkey AS id, n_regionkey AS grp, avg(c_acctbal) AS v, sum(c_acctbal) AS f, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 0 END) AS part, (sum((c_mktsegment = 'BUILDING')::INT) + 0.5::DOUBLE) / (count(*) + 1) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def _nations(t):
    """Nations as donors: mean balance, total and one segment's balance, and that segment's smoothed share."""
    hit = F.col("c_mktsegment") == "BUILDING"
    c = t.customer.groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("v"), F.sum("c_acctbal").alias("f"), F.sum(F.when(hit, F.col("c_acctbal")).otherwise(0.0)).alias("part"), ((F.sum(hit.cast("int")) + 0.5) / (F.count(F.lit(1)) + 1)).alias("share"))
    return c.join(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("grp")), "id")


@query(f"WITH {_NATIONS}, c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS i, sum(v) OVER (PARTITION BY grp) AS s, count(*) OVER (PARTITION BY grp) AS n FROM v), p AS (SELECT x.grp, x.i AS i, y.i AS j, round((x.v + y.v) / 2 - (x.s - x.v - y.v) / (x.n - 2), 6) AS d FROM c x JOIN c y ON x.grp = y.grp AND x.i < y.i WHERE x.n > 2), o AS (SELECT grp, d AS obs FROM p WHERE i = 1 AND j = 2) SELECT p.grp, count(*) AS splits, round(any_value(obs), 4) AS delta, round(avg((abs(d) >= abs(obs))::INT), 6) AS p FROM p JOIN o ON p.grp = o.grp GROUP BY 1")
def exact_permutation(t):
    """All assignments of two donors to the first arm are enumerated where there are few; the observed one counts."""
    w = W.partitionBy("grp")
    c = _nations(t).withColumn("i", F.row_number().over(w.orderBy("id"))).withColumn("s", F.sum("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).filter("n > 2")
    x, y = c.select("grp", "i", "s", "n", F.col("v").alias("a")), c.select("grp", F.col("i").alias("j"), F.col("v").alias("b"))
    both = F.col("a") + F.col("b")
    p = x.join(y, "grp").filter("i < j").select("grp", "i", "j", F.round(both / 2 - (F.col("s") - both) / (F.col("n") - 2), 6).alias("d"))
    o = p.filter("i = 1 AND j = 2").select("grp", F.col("d").alias("obs"))
    return p.join(o, "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("splits"), F.round(F.max("obs"), 4).alias("delta"), r6(F.avg((F.abs("d") >= F.abs("obs")).cast("double")), "p"))


_DRAWN = f"i AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY arm) AS m FROM e), b AS (SELECT arm, rep, floor({_u('donor', 'rep', 'arm', 'i')} * m)::BIGINT AS pick FROM i, (SELECT unnest(range(1, {N_BOOT + 1})) AS rep))"


def _drawn(e):
    """Bootstrap draws of donors within arms: (rep, arm and the drawn donor's columns)."""
    w = W.partitionBy("arm")
    c = e.withColumn("i", (F.row_number().over(w.orderBy("id")) - 1).cast("long")).withColumn("m", F.count(F.lit(1)).over(w))
    pick = F.floor(T.unit_random("donor", F.col("rep"), F.col("arm"), F.col("i")) * F.col("m")).cast("long")
    return _reps(c.select("arm", "i", "m"), N_BOOT).select("arm", "rep", pick.alias("i")).join(F.broadcast(c.drop("m")), ["arm", "i"])  # donors: a bounded list


@query(f"WITH {_NATIONS}, e AS (SELECT v.id, 0::BIGINT AS arm, v.v - s.v AS d FROM v JOIN (SELECT s_nationkey AS id, avg(s_acctbal) AS v FROM supplier GROUP BY 1) s ON v.id = s.id), {_DRAWN}, r AS (SELECT rep, avg(d) AS m FROM b JOIN i ON b.arm = i.arm AND pick = i GROUP BY rep) SELECT (SELECT count(*) FROM e) AS n_cells, (SELECT round(avg(d), 4) FROM e) AS mean, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi, (SELECT round(avg((d > 0)::INT), 6) FROM e) AS win_rate FROM r")
def cell_bootstrap_win_rate(t):
    """Mean difference over evaluation cells with a bootstrap interval, and the share of cells won."""
    s = t.supplier.groupBy(F.col("s_nationkey").alias("id")).agg(F.avg("s_acctbal").alias("sv"))
    e = _nations(t).join(s, "id").select("id", F.lit(0).cast("long").alias("arm"), (F.col("v") - F.col("sv")).alias("d"))
    r = _drawn(e).groupBy("rep").agg(F.avg("d").alias("m")).agg(F.round(F.percentile("m", F.lit(0.025)), 4).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("hi"))
    return e.agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("d"), 4).alias("mean"), r6(F.avg((F.col("d") > 0).cast("double")), "win_rate")).join(F.broadcast(r))


@query(f"WITH {_NATIONS}, e AS (SELECT id, (grp < 2)::BIGINT AS arm, f, part FROM v), {_DRAWN}, r AS (SELECT rep, (avg(part) FILTER (WHERE b.arm = 1) - avg(part) FILTER (WHERE b.arm = 0)) / (avg(f) FILTER (WHERE b.arm = 1) - avg(f) FILTER (WHERE b.arm = 0)) AS share FROM b JOIN i ON b.arm = i.arm AND pick = i GROUP BY rep) SELECT (SELECT round((avg(part) FILTER (WHERE arm = 1) - avg(part) FILTER (WHERE arm = 0)) / (avg(f) FILTER (WHERE arm = 1) - avg(f) FILTER (WHERE arm = 0)), 5) FROM e) AS share_of_full, round(quantile_cont(share, 0.025), 4) AS lo, round(quantile_cont(share, 0.975), 4) AS hi FROM r")
def donor_bootstrap_share(t):
    """Share of a group difference that one component makes up, donors drawn again within each group."""
    e = _nations(t).select("id", (F.col("grp") < 2).cast("long").alias("arm"), "f", "part")
    gap = lambda c: F.avg(F.when(F.col("arm") == 1, F.col(c))) - F.avg(F.when(F.col("arm") == 0, F.col(c)))
    r = _drawn(e).groupBy("rep").agg((gap("part") / gap("f")).alias("s")).agg(F.round(F.percentile("s", F.lit(0.025)), 4).alias("lo"), F.round(F.percentile("s", F.lit(0.975)), 4).alias("hi"))
    return e.agg(F.round(gap("part") / gap("f"), 5).alias("share_of_full")).join(F.broadcast(r))


@query(f"WITH {_NATIONS}, e AS (SELECT id, (grp < 2)::BIGINT AS arm, ln(share / (1 - share)) AS x FROM v), n AS (SELECT sum(arm) AS n1 FROM e), d AS (SELECT rep, x, (row_number() OVER (PARTITION BY rep ORDER BY {_u('abund', 'rep', 'id')}, id) <= (SELECT n1 FROM n))::BIGINT AS arm FROM e, (SELECT unnest(range(1, {N_PERM + 1})) AS rep) UNION ALL SELECT 0, x, arm FROM e), g AS (SELECT rep, round((1 - 3.0::DOUBLE / (4 * count(*) - 9)) * (avg(x) FILTER (WHERE arm = 1) - avg(x) FILTER (WHERE arm = 0)) / sqrt(((count(*) FILTER (WHERE arm = 1) - 1) * var_samp(x) FILTER (WHERE arm = 1) + (count(*) FILTER (WHERE arm = 0) - 1) * var_samp(x) FILTER (WHERE arm = 0)) / (count(*) - 2)), 9) AS g FROM d GROUP BY rep), o AS (SELECT g AS og FROM g WHERE rep = 0), cl AS (SELECT avg(sign(a.x - b.x)) AS c FROM e a JOIN e b ON a.arm = 1 AND b.arm = 0) SELECT round(any_value(og), 6) AS g, round(any_value(c), 6) AS cliffs_delta, round((1 + sum((abs(g) >= abs(og))::INT)) / (1 + count(*)), 6) AS p FROM g, o, cl WHERE rep > 0")
def abundance_test(t):
    """Logit shares of donors: Hedges g, Cliff's delta and a two-sided label permutation."""
    e = _nations(t).select("id", (F.col("grp") < 2).cast("long").alias("arm"), F.ln(F.col("share") / (1 - F.col("share"))).alias("x"))
    k = F.row_number().over(W.partitionBy("rep").orderBy(T.unit_random("abund", F.col("rep"), F.col("id")), "id"))
    n = e.agg(F.sum("arm").alias("n1"))
    d = _reps(e.drop("arm"), N_PERM).withColumn("k", k).join(F.broadcast(n)).select("rep", "x", (F.col("k") <= F.col("n1")).cast("long").alias("arm")).union(e.select(F.lit(0).cast("long"), "x", "arm"))
    g = T.hedges_g(T.arms(d, "rep", F.col("arm"), "x")).select("rep", F.round("g", 9).alias("g"))
    a, b = e.filter("arm = 1").select(F.col("x").alias("a")), e.filter("arm = 0").select(F.col("x").alias("b"))
    cl = a.join(F.broadcast(b)).agg(F.avg(F.signum(F.col("a") - F.col("b"))).alias("c"))  # donors: a bounded list
    j = g.filter("rep > 0").join(F.broadcast(g.filter("rep = 0").select(F.col("g").alias("og"))))
    return j.agg(r6(F.max("og"), "g"), r6((1 + F.sum((F.abs("g") >= F.abs("og")).cast("int"))) / (1 + F.count(F.lit(1))), "p")).join(F.broadcast(cl)).select("g", "p", r6("c", "cliffs_delta"))


_G2 = "(1 - 3.0::DOUBLE / (4 * count(*) - 9)) * (avg(x) FILTER (WHERE {0} = 1) - avg(x) FILTER (WHERE {0} = 0)) / (sqrt(((count(*) FILTER (WHERE {0} = 1) - 1) * var_samp(x) FILTER (WHERE {0} = 1) + (count(*) FILTER (WHERE {0} = 0) - 1) * var_samp(x) FILTER (WHERE {0} = 0)) / (count(*) - 2)) + 1e-12)"


@query(f"WITH {_NATIONS}, e AS (SELECT id, (grp < 2)::BIGINT AS arm, ln(share / (1 - share)) AS x FROM v), {_DRAWN}, r AS (SELECT rep, {_G2.format('b.arm')} AS g FROM b JOIN i ON b.arm = i.arm AND pick = i GROUP BY rep), k AS (SELECT arm, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rk FROM e), u AS (SELECT sum(rk) FILTER (WHERE arm = 1) - sum(arm) * (sum(arm) + 1) / 2 AS u, sum(arm)::DOUBLE AS p, (count(*) - sum(arm))::DOUBLE AS q FROM k), z AS (SELECT u, (u - p * q / 2) / sqrt(p * q * (p + q + 1) / 12) AS z FROM u) SELECT (SELECT round({_G2.format('arm')}, 6) FROM e) AS g, round(quantile_cont(r.g, 0.025), 4) AS lo, round(quantile_cont(r.g, 0.975), 4) AS hi, round(any_value(u), 1) AS u, round(any_value({_TAIL.format('(abs(z) / sqrt(2.0::DOUBLE))')}), 5) AS p_rank FROM r, z")
def abundance_interval(t):
    """Logit shares of donors: Hedges g with a bootstrap interval (donors drawn again within arms) and the rank test."""
    e = _nations(t).select("id", (F.col("grp") < 2).cast("long").alias("arm"), F.ln(F.col("share") / (1 - F.col("share"))).alias("x"))
    g = lambda d, keys: T.hedges_g(T.arms(d, keys, F.col("arm"), "x"), least=1, eps=1e-12)
    seen = g(e.withColumn("all", F.lit(1)), "all").select(r6("g"))
    drawn = g(_drawn(e), "rep").agg(F.round(F.percentile("g", F.lit(0.025)), 4).alias("lo"), F.round(F.percentile("g", F.lit(0.975)), 4).alias("hi"))
    a = T.auroc(e.withColumn("all", F.lit(1)), "all", "arm", "x")
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    ranked = a.select(F.round(F.col("auroc") * p * q, 1).alias("u"), F.round(_tail((F.col("auroc") - 0.5) * p * q / F.sqrt(p * q * (p + q + 1) / 12)), 5).alias("p_rank"))
    return seen.join(F.broadcast(drawn)).join(F.broadcast(ranked))


@query("SELECT p_brand, count(*) AS n, round(regr_r2(p_retailprice, p_size), 6) AS r2, round(1 - (1 - regr_r2(p_retailprice, p_size)) * (count(*) - 1) / (count(*) - 2), 6) AS r2_adjusted FROM part GROUP BY 1 HAVING count(*) > 2")
def r2_adjusted(t):
    r2, n = F.regr_r2(F.col("p_retailprice"), F.col("p_size")), F.count(F.lit(1))
    return t.part.groupBy("p_brand").agg(n.alias("n"), r6(r2, "r2"), r6(1 - (1 - r2) * (n - 1) / (n - 2), "r2_adjusted")).filter("n > 2")


_HALVES = f"{ASSAY}, h AS (SELECT feature, avg(value) FILTER (WHERE label = 1 AND odd) - avg(value) FILTER (WHERE label = 0 AND odd) AS xa, avg(value) FILTER (WHERE label = 1 AND NOT odd) - avg(value) FILTER (WHERE label = 0 AND NOT odd) AS xb, avg(value) FILTER (WHERE label = 2 AND odd) - avg(value) FILTER (WHERE label = 0 AND odd) AS ya, avg(value) FILTER (WHERE label = 2 AND NOT odd) - avg(value) FILTER (WHERE label = 0 AND NOT odd) AS yb FROM (SELECT *, {_u('rel', 'sample')} < 0.5 AS odd FROM assay) GROUP BY 1)"


@query(f"WITH {_HALVES}, c AS (SELECT corr(xa, xb) AS rx, corr(ya, yb) AS ry, corr(xa + xb, ya + yb) AS r, covar_samp(xa, xb) AS cx, covar_samp(ya, yb) AS cy, (covar_samp(xa, yb) + covar_samp(xb, ya)) / 2 AS cxy FROM h) SELECT round(r * r, 6) AS r2, round(2 * rx / (1 + rx), 6) AS rel_x, round(2 * ry / (1 + ry), 6) AS rel_y, round(r * r / ((2 * rx / (1 + rx)) * (2 * ry / (1 + ry))), 4) AS r2_corrected, round(cxy * cxy / (cx * cy), 4) AS shared_share FROM c")
def reliability_corrected_r2(t):
    """R2 of two contrasts divided by their split-half reliabilities, and the replicable share of signal that they have in common."""
    v = t.assay.withColumn("odd", T.unit_random("rel", F.col("sample")) < 0.5)
    side = lambda k, odd: F.avg(F.when((F.col("label") == k) & (F.col("odd") == odd), F.col("value")))
    h = v.groupBy("feature").agg(*((side(k, odd) - side(0, odd)).alias(n) for n, k, odd in (("xa", 1, True), ("xb", 1, False), ("ya", 2, True), ("yb", 2, False))))
    c = h.agg(F.corr("xa", "xb").alias("rx"), F.corr("ya", "yb").alias("ry"), F.corr(F.col("xa") + F.col("xb"), F.col("ya") + F.col("yb")).alias("r"), F.covar_samp("xa", "xb").alias("cx"), F.covar_samp("ya", "yb").alias("cy"), ((F.covar_samp("xa", "yb") + F.covar_samp("xb", "ya")) / 2).alias("cxy"))
    rel = lambda x: 2 * F.col(x) / (1 + F.col(x))
    return c.select(r6(F.col("r") * F.col("r"), "r2"), r6(rel("rx"), "rel_x"), r6(rel("ry"), "rel_y"), F.round(F.col("r") * F.col("r") / (rel("rx") * rel("ry")), 4).alias("r2_corrected"), F.round(F.col("cxy") * F.col("cxy") / (F.col("cx") * F.col("cy")), 4).alias("shared_share"))


@query(f"WITH {_DL}, wt AS (SELECT cohort, feature, g, row_number() OVER (PARTITION BY cohort ORDER BY abs(g) DESC, feature) <= 10 AS top FROM g WHERE g IS NOT NULL) SELECT a.cohort AS a, b.cohort AS b, round(corr(a.g, b.g), 6) AS r, round(avg((sign(a.g) = sign(b.g))::INT), 6) AS same_sign, round(sum((a.top AND b.top)::INT) / sum((a.top OR b.top)::INT), 6) AS jaccard_top FROM wt a JOIN wt b ON a.feature = b.feature AND a.cohort < b.cohort GROUP BY 1, 2")
def weight_stability(t):
    """Agreement of feature weights between every two cohorts: correlation, common signs, overlap of the ten largest."""
    g = _g(t).filter("g IS NOT NULL").select("cohort", "feature", "g")
    x = g.join(top_n(g, "cohort", [F.desc(F.abs("g")), F.col("feature")], 10).select("cohort", "feature", F.lit(True).alias("top")), ["cohort", "feature"], "left").withColumn("top", F.coalesce("top", F.lit(False)))
    p = x.select(F.col("cohort").alias("a"), "feature", F.col("g").alias("ga"), F.col("top").alias("ta")).join(x.select(F.col("cohort").alias("b"), "feature", F.col("g").alias("gb"), F.col("top").alias("tb")), "feature").filter("a < b")
    return p.groupBy("a", "b").agg(r6(F.corr("ga", "gb"), "r"), r6(F.avg((F.signum("ga") == F.signum("gb")).cast("double")), "same_sign"), r6(F.count_if(F.col("ta") & F.col("tb")) / F.count_if(F.col("ta") | F.col("tb")), "jaccard_top"))


@query("WITH " + _AUC.format(CASES, "cohort", "score", "cases") + ", rk2 AS (SELECT cohort, y, rank() OVER (PARTITION BY cohort ORDER BY covariate) + (count(*) OVER (PARTITION BY cohort, covariate) - 1) / 2 AS rk FROM cases), auc2 AS (SELECT cohort, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS b FROM rk2 GROUP BY 1) SELECT auc.cohort, round(auroc, 6) AS model_a, round(b, 6) AS model_b, round(auroc - b, 6) AS delta, CASE WHEN auroc > b THEN 'a' WHEN auroc < b THEN 'b' ELSE 'tie' END AS winner FROM auc JOIN auc2 ON auc.cohort = auc2.cohort")
def model_comparison(t):
    """Two scores side by side per cohort."""
    a = T.auroc(t.cases, "cohort", out="a").select("cohort", "a")
    b = T.auroc(t.cases, "cohort", score="covariate", out="b").select("cohort", "b")
    d = F.col("a") - F.col("b")
    return a.join(b, "cohort").select("cohort", r6("a", "model_a"), r6("b", "model_b"), r6(d, "delta"), F.when(d > 0, "a").when(d < 0, "b").otherwise("tie").alias("winner"))


@query(f"WITH {CASES}, s AS (SELECT cohort, sample, y, seed, score * (0.9 + 0.2 * {_u('seed', 'seed', 'sample')}) AS v FROM cases, (SELECT unnest(range(1, 6)) AS seed)), t AS (SELECT cohort, avg(m) AS cut FROM (SELECT cohort, seed, avg(v) AS m FROM s GROUP BY 1, 2) GROUP BY 1), e AS (SELECT cohort, sample, y, avg(v) AS v FROM s GROUP BY 1, 2, 3) SELECT e.cohort, round(any_value(cut), 4) AS cut, round(avg((round(v - cut, 6) >= 0)::INT), 5) AS called, round(avg((round(v - cut, 6) >= 0)::INT) FILTER (WHERE y = 1), 5) AS sensitivity FROM e JOIN t ON e.cohort = t.cohort GROUP BY 1")
def seed_ensemble(t):
    """Scores of five seeds averaged by sample, their thresholds by cohort."""
    s = t.cases.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("v", F.col("score") * (0.9 + 0.2 * T.unit_random("seed", F.col("seed"), F.col("sample"))))
    cut = s.groupBy("cohort", "seed").agg(F.avg("v").alias("m")).groupBy("cohort").agg(F.avg("m").alias("cut"))
    e = s.groupBy("cohort", "sample", "y").agg(F.avg("v").alias("v")).join(F.broadcast(cut), "cohort")  # one row a cohort
    hit = (F.round(F.col("v") - F.col("cut"), 6) >= 0).cast("double")
    return e.groupBy("cohort").agg(F.round(F.max("cut"), 4).alias("cut"), F.round(F.avg(hit), 5).alias("called"), F.round(F.avg(F.when(F.col("y") == 1, hit)), 5).alias("sensitivity"))


_NEWTON = ", ".join(
    f"n{k} AS (SELECT c.cohort, count(*) AS n, sum(w) AS a, sum(w * x) AS b, sum(w * x * x) AS d, sum(y - p) AS g, sum((y - p) * x) AS h FROM (SELECT c.cohort, y, x, p, p * (1 - p) AS w FROM (SELECT c.cohort, y, x, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM c JOIN t{k} ON c.cohort = t{k}.cohort) c) c GROUP BY 1), t{k + 1} AS (SELECT n{k}.cohort, b0 + (d * g - b * h) / (a * d - b * b) AS b0, b1 + (a * h - b * g) / (a * d - b * b) AS b1 FROM n{k} JOIN t{k} ON n{k}.cohort = t{k}.cohort)"
    for k in range(6)
)


@query(f"WITH {CASES}, c AS (SELECT cohort, y, ln(s / (1 - s)) AS x FROM (SELECT cohort, y, least(greatest(score / 600000, 0.0001), 0.9999) AS s FROM cases)), t0 AS (SELECT DISTINCT cohort, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM c), {_NEWTON} SELECT cohort, round(b1, 4) AS slope, round(b0, 4) AS intercept FROM t6")
def calibration(t):
    """Slope and intercept of y on the logit of a probability, by six Newton steps; a step is one sum over the rows and two numbers a cohort."""
    s = F.least(F.greatest(F.col("score") / 600000, F.lit(0.0001)), F.lit(0.9999))
    c = t.cases.select("cohort", "y", F.ln(s / (1 - s)).alias("x"))
    b = c.select("cohort").distinct().withColumn("b0", F.lit(0.0)).withColumn("b1", F.lit(0.0))
    for _ in range(6):
        x = F.col("x")
        p = c.join(F.broadcast(b), "cohort").withColumn("p", 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * x)))).withColumn("w", F.col("p") * (1 - F.col("p")))
        one = lambda e, n: F.sum(e).alias(n)
        m = p.groupBy("cohort").agg(F.max("b0").alias("b0"), F.max("b1").alias("b1"), one(F.col("w"), "a"), one(F.col("w") * x, "b"), one(F.col("w") * x * x, "d"), one(F.col("y") - F.col("p"), "g"), one((F.col("y") - F.col("p")) * x, "h"))
        det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
        b = m.select("cohort", (F.col("b0") + (F.col("d") * F.col("g") - F.col("b") * F.col("h")) / det).alias("b0"), (F.col("b1") + (F.col("a") * F.col("h") - F.col("b") * F.col("g")) / det).alias("b1"))
    return b.select("cohort", F.round("b1", 4).alias("slope"), F.round("b0", 4).alias("intercept"))


@query(f"WITH {_NATIONS}, e AS (SELECT id, v AS x, share AS y FROM v), d AS (SELECT rep, id, x, row_number() OVER (PARTITION BY rep ORDER BY id) AS i, row_number() OVER (PARTITION BY rep ORDER BY {_u('r2', 'rep', 'id')}, id) AS k, y FROM e, (SELECT unnest(range(1, {N_PERM + 1})) AS rep)), m AS (SELECT a.rep, a.x, b.y FROM d a JOIN d b ON a.rep = b.rep AND a.i = b.k UNION ALL SELECT 0, x, y FROM e), r AS (SELECT rep, round(corr(x, y) * corr(x, y), 9) AS r2 FROM m GROUP BY rep), o AS (SELECT r2 AS o2 FROM r WHERE rep = 0) SELECT round(any_value(o2), 6) AS r2, round((1 + sum((r2 >= o2)::INT)) / (1 + count(*)), 6) AS p FROM r, o WHERE rep > 0")
def r2_permutation(t):
    """R2 between donors' two columns against a permuted second one."""
    e = _nations(t).select("id", F.col("v").alias("x"), F.col("share").alias("y"))
    w = W.partitionBy("rep")
    d = _reps(e, N_PERM).withColumn("i", F.row_number().over(w.orderBy("id"))).withColumn("k", F.row_number().over(w.orderBy(T.unit_random("r2", F.col("rep"), F.col("id")), "id")))
    m = d.select("rep", "i", "x").join(d.select("rep", F.col("k").alias("i"), "y"), ["rep", "i"]).select("rep", "x", "y").union(e.select(F.lit(0).cast("long"), "x", "y"))
    r = m.groupBy("rep").agg(F.round(F.corr("x", "y") * F.corr("x", "y"), 9).alias("r2"))
    j = r.filter("rep > 0").join(F.broadcast(r.filter("rep = 0").select(F.col("r2").alias("o2"))))
    return j.agg(r6(F.max("o2"), "r2"), r6((1 + F.sum((F.col("r2") >= F.col("o2")).cast("int"))) / (1 + F.count(F.lit(1))), "p"))
