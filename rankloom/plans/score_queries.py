"""Held-out axes, signature scores and decision tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import ranks as R
from rankloom.operators import signatures as S
from rankloom.operators import statistics as T
from rankloom.plans.base import query, r6
from rankloom.plans.resample_queries import _u
from rankloom.sources.relations import ASSAY, COUNTS, RANKED

K = 10
_EFFECTS = f"{ASSAY}, {RANKED}, arm AS (SELECT cohort, feature, (label <> 0)::INT AS a, count(*) AS n, avg(r) AS m, var_samp(r) AS v FROM ranks GROUP BY 1, 2, 3), eff AS (SELECT x.cohort, x.feature, CASE WHEN x.n >= 3 AND y.n >= 3 THEN (x.m - y.m) / (sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)) + 1e-6) END AS effect FROM arm x JOIN arm y ON x.cohort = y.cohort AND x.feature = y.feature AND x.a = 1 AND y.a = 0)"
_AXIS = f"{_EFFECTS}, axis AS (SELECT e.cohort AS evaluated, f.feature, avg(f.effect) AS axis FROM (SELECT DISTINCT cohort FROM eff) e JOIN eff f ON f.cohort <> e.cohort WHERE f.effect IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= ceil(((SELECT count(DISTINCT cohort) FROM eff) - 1) * 0.5))"
_TOP = f"{_AXIS}, top AS (SELECT evaluated, feature, 1 AS sign FROM (SELECT *, row_number() OVER (PARTITION BY evaluated ORDER BY axis DESC, feature) AS k FROM axis) WHERE k <= {K} UNION ALL SELECT evaluated, feature, -1 FROM (SELECT *, row_number() OVER (PARTITION BY evaluated ORDER BY axis, feature) AS k FROM axis) WHERE k <= {K})"
_SCORES = f"{_TOP}, scores AS (SELECT sample, cohort, label, avg(CASE WHEN sign = 1 THEN r END) - avg(CASE WHEN sign = -1 THEN r END) AS score, count(*) AS n_present FROM ranks JOIN top ON cohort = evaluated AND ranks.feature = top.feature GROUP BY 1, 2, 3)"


def _cohorts(t):
    return t.embeddings.select((F.col("vec_id") % 4).alias("cohort"))


def _effects(t):
    return S.cohort_effects(S.full_ranks(t.assay))


def _scores(t, k=K):
    ranks = S.full_ranks(t.assay)
    top = S.top_and_bottom(S.heldout_axis(S.cohort_effects(ranks), _cohorts(t)), k).withColumnRenamed("evaluated", "cohort")
    return S.signed_score(ranks, top, ["cohort", "feature"], ["sample", "cohort", "label"])


@query(f"WITH {_EFFECTS} SELECT cohort, feature, round(effect, 6) AS effect FROM eff")
def effect_by_cohort(t):
    return _effects(t).select("cohort", "feature", r6("effect"))


@query(f"WITH {_AXIS} SELECT evaluated, feature, round(axis, 6) AS axis FROM axis")
def heldout_axis(t):
    return S.heldout_axis(_effects(t), _cohorts(t)).select("evaluated", "feature", r6("axis"))


@query(f"WITH {_SCORES}, z AS (SELECT cohort, (label <> 0)::INT AS y, round(score, 9) + 0 AS score FROM scores), n AS (SELECT cohort, y, rank() OVER (PARTITION BY cohort ORDER BY score) + (count(*) OVER (PARTITION BY cohort, score) - 1) / 2 AS rk FROM z), a AS (SELECT cohort, sum(y) AS p, count(*) - sum(y) AS q, sum(rk * y) AS s FROM n GROUP BY 1) SELECT cohort, p::BIGINT AS n_pos, q::BIGINT AS n_neg, round((s - p * (p + 1) / 2) / (p * q), 6) AS auroc FROM a")
def heldout_axis_score(t):
    """Flagship: AUROC of the signature score, the signature learned without the evaluated cohort."""
    scored = _scores(t).select("cohort", (F.col("label") != 0).cast("int").alias("y"), (F.round("score", 9) + F.lit(0.0)).alias("score"))  # ties stay ties in any order of summing
    return T.auroc(scored, "cohort").select("cohort", "n_pos", "n_neg", r6("auroc"))


@query(f"WITH {_SCORES} SELECT sample, n_present, round(score, 6) AS score FROM scores")
def signed_set_score(t):
    return _scores(t).select("sample", "n_present", r6("score"))


@query(f"WITH {ASSAY}, {RANKED}, o AS (SELECT feature, CASE WHEN avg(CASE WHEN label = 1 THEN r END) - avg(CASE WHEN label = 0 THEN r END) >= 0 THEN 1 ELSE -1 END AS sign FROM ranks WHERE cohort = 0 AND feature <= 12 GROUP BY 1) SELECT sample, round(sum(sign * r) / count(*), 6) AS score FROM ranks JOIN o ON ranks.feature = o.feature WHERE cohort <> 0 GROUP BY 1")
def oriented_signature_score(t):
    ranks = S.full_ranks(t.assay)
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("r")))
    o = ranks.filter("cohort = 0 AND feature <= 12").groupBy("feature").agg(F.when(side(1) - side(0) >= 0, 1).otherwise(-1).alias("sign"))
    return ranks.filter("cohort <> 0").join(F.broadcast(o), "feature").groupBy("sample").agg(r6(F.sum(F.col("sign") * F.col("r")) / F.count(F.lit(1)), "score"))


@query(f"WITH {_EFFECTS} SELECT feature, round(avg(effect), 6) AS mean_effect FROM eff GROUP BY feature HAVING count(effect) = (SELECT count(DISTINCT cohort) FROM eff) AND (min(effect) > 0 OR max(effect) < 0)")
def core_rule(t):
    """Same sign in every source cohort."""
    e = _effects(t)
    n = e.agg(F.countDistinct("cohort").alias("_n"))
    g = e.groupBy("feature").agg(F.avg("effect").alias("m"), F.count("effect").alias("k"), F.min("effect").alias("lo"), F.max("effect").alias("hi"))
    return g.join(F.broadcast(n), F.col("k") == F.col("_n")).filter("lo > 0 OR hi < 0").select("feature", r6("m", "mean_effect"))


@query(f"WITH {_EFFECTS}, l AS (SELECT d.cohort AS left_out, feature, avg(effect) AS m, min(effect) AS lo, max(effect) AS hi FROM eff JOIN (SELECT DISTINCT cohort FROM eff) d ON d.cohort <> eff.cohort GROUP BY 1, 2), s AS (SELECT * FROM l WHERE lo > 0 OR hi < 0), k AS (SELECT *, row_number() OVER (PARTITION BY left_out ORDER BY m DESC, feature) AS up, row_number() OVER (PARTITION BY left_out ORDER BY m, feature) AS down FROM s) SELECT left_out, feature, CASE WHEN up <= 5 THEN 1 ELSE -1 END AS sign FROM k WHERE up <= 5 OR down <= 5")
def loo_gene_sets(t):
    """Leave-one-out sets: every cohort left out at once by a fan-out join on a table of cohorts."""
    e = _effects(t)
    out = e.select(F.col("cohort").alias("left_out")).distinct()
    m = e.join(F.broadcast(out), F.col("left_out") != F.col("cohort")).groupBy("left_out", "feature").agg(F.avg("effect").alias("m"), F.min("effect").alias("lo"), F.max("effect").alias("hi"))
    s = R.ordinal_rank(m.filter("lo > 0 OR hi < 0"), "left_out", [F.desc("m"), F.col("feature")], "up")
    s = R.ordinal_rank(s, "left_out", [F.col("m"), F.col("feature")], "down")
    return s.filter("up <= 5 OR down <= 5").select("left_out", "feature", F.when(F.col("up") <= 5, 1).otherwise(-1).alias("sign"))


@query(f"WITH {ASSAY}, d AS (SELECT cohort, feature, avg(CASE WHEN label = 1 THEN value END) - avg(CASE WHEN label = 0 THEN value END) AS a, avg(CASE WHEN label > 1 THEN value END) - avg(CASE WHEN label = 0 THEN value END) AS b FROM assay GROUP BY 1, 2) SELECT cohort, round(sum(a * b) * sum(a * b) / (sum(a * a) * sum(b * b)), 6) AS share, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine FROM d GROUP BY cohort")
def shift_share_cosine(t):
    v = F.col("value")
    mean = lambda c: F.avg(F.when(c, v))
    ctrl = mean(F.col("label") == 0)
    d = t.assay.groupBy("cohort", "feature").agg((mean(F.col("label") == 1) - ctrl).alias("a"), (mean(F.col("label") > 1) - ctrl).alias("b"))
    s = d.groupBy("cohort").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.select("cohort", r6(F.col("ab") * F.col("ab") / (F.col("aa") * F.col("bb")), "share"), r6(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), "cosine"))


_SPEC = f"{COUNTS}, m AS (SELECT kind, feature, avg(n) AS x FROM counts GROUP BY 1, 2)"


def _profile(t):
    return t.counts.groupBy("kind", "feature").agg(F.avg("n").alias("x"))


@query(f"WITH {_SPEC} SELECT kind, feature, round((x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-9), 6) AS z FROM m WINDOW w AS (PARTITION BY feature)")
def specificity_z(t):
    return R.zscore(_profile(t), "feature", "x", eps=1e-9).select("kind", "feature", r6("z"))


@query(f"WITH {_SPEC}, w AS (SELECT *, max(x) OVER (PARTITION BY feature) AS hi FROM m) SELECT feature, round(sum(1 - x / hi) / (count(*) - 1), 6) AS tau, round(max(x) / sum(x), 6) AS top_share, arg_max(kind, x) AS top FROM w GROUP BY feature HAVING count(*) > 1")
def tau_top_share(t):
    g = _profile(t).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.max("x").alias("hi"), F.max_by("kind", "x").alias("top")).filter("n > 1")
    return g.select("feature", r6((F.col("n") - F.col("s") / F.col("hi")) / (F.col("n") - 1), "tau"), r6(F.col("hi") / F.col("s"), "top_share"), "top")


@query(f"WITH {_SPEC}, k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x DESC, kind) AS k FROM m) SELECT feature, max(CASE WHEN k = 1 THEN kind END) AS marker_of, round(log2((max(CASE WHEN k = 1 THEN x END) + 1) / (max(CASE WHEN k = 2 THEN x END) + 1)), 6) AS lr FROM k WHERE k <= 2 GROUP BY feature")
def marker_log_ratio(t):
    k = R.ordinal_rank(_profile(t), "feature", [F.desc("x"), F.col("kind")], "k").filter("k <= 2")
    at = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    return k.groupBy("feature").agg(at(1, "kind").alias("marker_of"), r6(F.log2((at(1, "x") + 1) / (at(2, "x") + 1)), "lr"))


@query(f"WITH {COUNTS}, m AS (SELECT donor % 2 AS ds, kind, feature, avg(n) AS x FROM counts GROUP BY 1, 2, 3), z AS (SELECT *, (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-9) AS z FROM m WINDOW w AS (PARTITION BY ds, feature)), p AS (SELECT kind, feature, sum(z) AS z FROM z WHERE z > 0 GROUP BY 1, 2 HAVING count(*) = 2) SELECT kind, feature, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(z, 9) DESC, feature) AS k FROM p) WHERE k <= 3")
def markers_intersect(t):
    m = t.counts.groupBy((F.col("donor") % 2).alias("ds"), "kind", "feature").agg(F.avg("n").alias("x"))
    z = R.zscore(m, ["ds", "feature"], "x", eps=1e-9).filter("z > 0")
    p = z.groupBy("kind", "feature").agg(F.sum("z").alias("z"), F.count(F.lit(1)).alias("c")).filter("c = 2")
    return R.top_n(p, "kind", [F.desc(F.round("z", 9)), F.col("feature")], 3).select("kind", "feature", r6("z"))


@query(f"WITH {_EFFECTS}, c AS (SELECT feature, avg(effect) AS m, stddev_samp(effect) AS s, count(effect) AS n FROM eff GROUP BY 1) SELECT feature, CASE WHEN feature % 2 = 0 THEN 1 ELSE -1 END AS expected, round(m / (s / sqrt(n)), 6) AS z, CASE WHEN m / (s / sqrt(n)) > 1 THEN 1 WHEN m / (s / sqrt(n)) < -1 THEN -1 ELSE 0 END = CASE WHEN feature % 2 = 0 THEN 1 ELSE -1 END AS holds FROM c")
def claims_table(t):
    z = F.col("m") / (F.col("s") / F.sqrt("n"))
    c = _effects(t).groupBy("feature").agg(F.avg("effect").alias("m"), F.stddev_samp("effect").alias("s"), F.count("effect").alias("n"))
    want = F.when(F.col("feature") % 2 == 0, 1).otherwise(-1)
    return c.select("feature", want.alias("expected"), r6(z, "z"), (F.when(z > 1, 1).when(z < -1, -1).otherwise(0) == want).alias("holds"))


@query("SELECT c_custkey, (c_acctbal > 5000)::INT + (c_mktsegment = 'BUILDING')::INT + (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))::INT AS chains FROM customer")
def evidence_rollup(t):
    p = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("p", F.lit(1))
    j = t.customer.join(p, "c_custkey", "left")
    return j.select("c_custkey", ((F.col("c_acctbal") > 5000).cast("int") + (F.col("c_mktsegment") == "BUILDING").cast("int") + F.coalesce("p", F.lit(0))).alias("chains"))


@query(f"WITH {_AXIS}, k AS (SELECT *, row_number() OVER (PARTITION BY evaluated ORDER BY axis DESC, feature) AS up, row_number() OVER (PARTITION BY evaluated ORDER BY axis, feature) AS down FROM axis), g AS (SELECT unnest([3, 5, 10]) AS k) SELECT g.k, sample, round(avg(CASE WHEN up <= g.k THEN r END) - avg(CASE WHEN down <= g.k THEN r END), 6) AS score FROM ranks JOIN k ON cohort = evaluated AND ranks.feature = k.feature JOIN g ON up <= g.k OR down <= g.k GROUP BY 1, 2")
def topk_sensitivity(t):
    ranks = S.full_ranks(t.assay)
    axis = S.heldout_axis(S.cohort_effects(ranks), _cohorts(t))
    k = R.ordinal_rank(R.ordinal_rank(axis, "evaluated", [F.desc("axis"), F.col("feature")], "up"), "evaluated", [F.col("axis"), F.col("feature")], "down")
    grid = k.filter("up <= 10 OR down <= 10").select(F.col("evaluated").alias("cohort"), "feature", "up", "down", F.explode(F.array(*map(F.lit, (3, 5, 10)))).alias("k")).filter("up <= k OR down <= k")
    side = lambda c: F.avg(F.when(F.col(c) <= F.col("k"), F.col("r")))
    return ranks.join(grid, ["cohort", "feature"]).groupBy("k", "sample").agg(r6(side("up") - side("down"), "score"))


@query(f"WITH {ASSAY}, {RANKED}, s AS (SELECT sample, max(CASE WHEN feature = 1 THEN r END) - avg(CASE WHEN feature IN (2, 3, 4) THEN r END) AS d FROM ranks GROUP BY 1) SELECT sample, CASE WHEN d > 0.2 THEN 'F' WHEN d < -0.2 THEN 'M' ELSE 'NA' END AS sex FROM s")
def sex_inference(t):
    f = F.col("feature")
    s = S.full_ranks(t.assay.filter("feature IS NOT NULL")).groupBy("sample").agg((F.max(F.when(f == 1, F.col("r"))) - F.avg(F.when(f.isin(2, 3, 4), F.col("r")))).alias("d"))
    return s.select("sample", F.when(F.col("d") > 0.2, "F").when(F.col("d") < -0.2, "M").otherwise("NA").alias("sex"))


@query(f"WITH {ASSAY}, d AS (SELECT cohort, feature, avg(CASE WHEN label = 1 THEN value END) - avg(CASE WHEN label = 0 THEN value END) AS d FROM assay GROUP BY 1, 2) SELECT feature, CASE WHEN min(d) > 0 THEN 'both_up' WHEN max(d) < 0 THEN 'both_down' WHEN avg(d) > 0.05 THEN 'mostly_up' WHEN avg(d) < -0.05 THEN 'mostly_down' ELSE 'unresolved' END AS class FROM d GROUP BY feature")
def gene_class_decision(t):
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("value")))
    d = t.assay.groupBy("cohort", "feature").agg((side(1) - side(0)).alias("d")).groupBy("feature").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.avg("d").alias("m"))
    return d.select("feature", F.when(F.col("lo") > 0, "both_up").when(F.col("hi") < 0, "both_down").when(F.col("m") > 0.05, "mostly_up").when(F.col("m") < -0.05, "mostly_down").otherwise("unresolved").alias("class"))


@query("WITH s AS (SELECT doc_id, string_split(text, ' ') AS g, string_split(lang || ';' || source, ';') AS d FROM documents) SELECT doc_id, i AS pos, g[i] AS gene, CASE WHEN len(d) = len(g) THEN d[i] ELSE 'NA' END AS direction FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM s WHERE len(g) >= 2)")
def signature_direction_parse(t):
    """Listed genes with their directions, which count only where there are as many as genes; a signature has two genes at least."""
    s = t.documents.select("doc_id", F.split("text", " ").alias("g"), F.split(F.concat_ws(";", "lang", "source"), ";").alias("d")).filter(F.size("g") >= 2)
    e = s.select("doc_id", F.when(F.size("d") == F.size("g"), F.col("d")).alias("d"), F.posexplode("g").alias("p", "gene"))
    return e.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "gene", F.coalesce(F.get("d", F.col("p")), F.lit("NA")).alias("direction"))


_HALVES = f"{COUNTS}, h AS (SELECT rep, donor, {_u('markers', 'rep', 'donor')} < 0.5 AS first FROM (SELECT DISTINCT donor FROM counts), (SELECT unnest(range(1, 11)) AS rep)), m AS (SELECT rep, first, kind, feature, avg(n) AS x FROM counts JOIN h ON counts.donor = h.donor GROUP BY 1, 2, 3, 4), z AS (SELECT *, (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6) AS z FROM m WINDOW w AS (PARTITION BY rep, first, feature)), k AS (SELECT *, row_number() OVER (PARTITION BY rep, first, kind ORDER BY round(z, 9) DESC, feature) AS k FROM z WHERE z IS NOT NULL), s AS (SELECT kind, feature, count(*) / 20.0::DOUBLE AS stability FROM k WHERE k <= 6 GROUP BY 1, 2), a AS (SELECT kind, feature, avg(n) AS x FROM counts GROUP BY 1, 2), az AS (SELECT *, (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6) AS z FROM a WINDOW w AS (PARTITION BY feature))"


@query(f"WITH {_HALVES}, j AS (SELECT az.kind, az.feature, z, stability, row_number() OVER (PARTITION BY az.kind ORDER BY round(z, 9) DESC, az.feature) AS rank FROM az JOIN s ON az.kind = s.kind AND az.feature = s.feature WHERE stability >= 0.4 AND z IS NOT NULL) SELECT kind, feature, rank, round(z, 6) AS z, round(stability, 6) AS stability FROM j WHERE rank <= 3")
def stable_markers(t, resamples: int = 10, top: int = 3):
    """Markers by specificity z that also lead in halves of the donors: the share of 20 half-samples in which a feature is among the first six."""
    spec = lambda m, keys: R.zscore(m, [*keys, "feature"], "x", eps=1e-6).filter("z IS NOT NULL")
    reps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(resamples).cast("long")))
    halved = t.counts.withColumn("rep", reps).withColumn("first", T.unit_random("markers", F.col("rep"), F.col("donor")) < 0.5)
    half = spec(halved.groupBy("rep", "first", "kind", "feature").agg(F.avg("n").alias("x")), ["rep", "first"])
    lead = R.top_n(half, ["rep", "first", "kind"], [F.desc(F.round("z", 9)), F.col("feature")], 2 * top)
    stable = lead.groupBy("kind", "feature").agg((F.count(F.lit(1)) / (2.0 * resamples)).alias("stability")).filter("stability >= 0.4")
    each = spec(_profile(t), []).join(stable, ["kind", "feature"])
    ranked = R.ordinal_rank(each, "kind", [F.desc(F.round("z", 9)), F.col("feature")], "rank")
    return ranked.filter(F.col("rank") <= top).select("kind", "feature", "rank", r6("z"), r6("stability"))


_PROGRAMS = "p AS (SELECT unnest(range(1, 65)) AS feature), q AS (SELECT feature, feature % 4 AS program, (feature // 4) % 2 AS down, feature % 7 = 0 AS shared FROM p)"


@query(f"WITH {ASSAY}, {RANKED}, {_PROGRAMS}, u AS (SELECT sample, program, v AS variant, avg(r) FILTER (WHERE down = 0) AS up, avg(r) FILTER (WHERE down = 0) - avg(r) FILTER (WHERE down = 1) AS score, count(*) FILTER (WHERE down = 0) AS n_up, count(*) FILTER (WHERE down = 1) AS n_down FROM ranks JOIN q ON ranks.feature = q.feature, (VALUES ('full'), ('without_shared')) AS t(v) WHERE v = 'full' OR NOT shared GROUP BY 1, 2, 3) SELECT sample, program, variant, round(score, 6) AS score, round(up, 6) AS up FROM u WHERE n_up >= 5 AND n_down >= 5")
def program_scores(t, least: int = 5):
    """Programs on ranks, up minus down, with all their features and without those that they share with the core set; sides under `least` measured features give none."""
    f = F.col("feature")
    variants = F.explode(F.when(f % 7 == 0, F.array(F.lit("full"))).otherwise(F.array(F.lit("full"), F.lit("without_shared")))).alias("variant")
    each = S.full_ranks(t.assay).select("sample", (f % 4).alias("program"), (F.floor(f / 4) % 2).alias("down"), "r", variants)
    side = lambda k, agg=F.avg: agg(F.when(F.col("down") == k, F.col("r")))
    s = each.groupBy("sample", "program", "variant").agg(side(0).alias("up"), (side(0) - side(1)).alias("score"), side(0, F.count).alias("n_up"), side(1, F.count).alias("n_down"))
    return s.filter((F.col("n_up") >= least) & (F.col("n_down") >= least)).select("sample", "program", "variant", r6("score"), r6("up"))
