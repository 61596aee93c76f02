"""Models fitted on the rows of training folds: principal and contrastive components, penalised regression, metacells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rankloom.operators import logistic as L
from rankloom.operators import matrix as M
from rankloom.operators import pca
from rankloom.operators import statistics as T
from rankloom.operators.metacells import metacells as _metacells
from rankloom.operators.ordering import binned_prefix
from rankloom.plans.base import query, r6
from rankloom.sources.relations import ASSAY

COHORTS = 4
#: Strengths that the inner folds choose from, and replicates of the null of a score's share of variance.
C_GRID, N_NULL = (0.001, 0.01, 0.1, 1.0), 1000


def vectors(t, missing: bool = False):
    """sample, cohort, label, x: every sample's vector; with missing, one value in ten is taken out by a rule."""
    e = t.embeddings.select(F.col("vec_id").alias("sample"), (F.col("vec_id") % COHORTS).alias("cohort"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    if missing:
        e = e.withColumn("x", F.transform("x", lambda v, i: F.when((F.col("sample") * 7 + i * 3) % 10 != 0, v)))
    return e


def _training(rows):
    """Each row once for every fold whose held-out cohort it is not in."""
    return rows.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COHORTS - 1).cast("long")))).filter("fold <> cohort")


@query()
def pca_fold_scores(t, components: int = 5):
    """Held-out scores: medians, means and components come from the other cohorts, every row of every cohort is scored."""
    rows = vectors(t, missing=True)
    models = pca.fit(_training(rows).select("fold", "x"), "fold", components)
    out = pca.transform(rows.select("sample", F.col("cohort").alias("fold"), "x"), models, "fold")
    return out.select("fold", "sample", *(F.round(F.col("pc")[k], 6).alias(f"pc{k + 1}") for k in range(components)))


@query(f"WITH {ASSAY}, z0 AS (SELECT sample, cohort, avg(value) FILTER (WHERE feature <= 6) - avg(value) FILTER (WHERE feature BETWEEN 7 AND 12) AS z FROM assay GROUP BY 1, 2), s AS (SELECT a.cohort, feature, covar_pop(value, z) AS c, var_pop(z) AS v, var_pop(value) AS f FROM assay a JOIN z0 ON a.sample = z0.sample GROUP BY 1, 2) SELECT cohort, round(sum(c * c / v) / sum(f), 6) AS share FROM s GROUP BY 1")
def score_variance_explained(t):
    """Share of each cohort's total variance along one signed score, from sums over its rows."""
    side = lambda a, b: F.aggregate(F.slice("x", a, b - a + 1), F.lit(0.0), lambda s, v: s + v) / (b - a + 1)
    each = vectors(t).select("cohort", (side(1, 6) - side(7, 12)).alias("z"), F.posexplode("x").alias("f", "v"))
    s = each.groupBy("cohort", "f").agg(F.covar_pop("v", "z").alias("c"), F.var_pop("z").alias("vz"), F.var_pop("v").alias("vf"))
    return s.groupBy("cohort").agg(r6(F.sum(F.col("c") * F.col("c") / F.col("vz")) / F.sum("vf"), "share"))


@query()
def pca_spectrum(t, components: int = 5, half: int = 6):
    """Each cohort's spectrum, its components' rank correlation with a signed score, and that score's share of variance against random signed sets.

    The null of 1,000 random sets needs no pass over the rows: each one's share follows from the covariance.
    """
    rows = vectors(t)
    models = pca.fit(rows.select("cohort", "x"), "cohort", components, missing=False)
    wide = M.width_of(rows)
    blocks = M.products(rows, ["cohort"], wide)

    def null(g: pd.DataFrame) -> pd.DataFrame:
        s = M.assemble(g, wide)
        mean = s[0, 1:] / s[0, 0]
        cov = s[1:, 1:] / s[0, 0] - np.outer(mean, mean)
        rng = np.random.default_rng(int(g["cohort"].iloc[0]))
        weights = np.zeros((wide, N_NULL + 1))
        weights[:half, 0], weights[half : 2 * half, 0] = 1 / half, -1 / half
        for k in range(1, N_NULL + 1):
            pick = rng.choice(wide, 2 * half, replace=False)
            weights[pick[:half], k], weights[pick[half:], k] = 1 / half, -1 / half
        share = pca.spread_of_score(cov, weights)
        return pd.DataFrame({"cohort": g["cohort"].iloc[:1], "share": [share[0].round(6)], "null_median": [np.median(share[1:]).round(6)], "null_q95": [np.quantile(share[1:], 0.95).round(6)], "p": [((1 + (share[1:] >= share[0]).sum()) / (1 + N_NULL)).round(6)]})

    tested = blocks.groupBy("cohort").applyInPandas(null, "cohort long, share double, null_median double, null_q95 double, p double")
    side = lambda a, b: F.aggregate(F.slice("x", a, b - a + 1), F.lit(0.0), lambda s, v: s + v) / (b - a + 1)
    scored = pca.transform(rows, models, "cohort").select("cohort", (side(1, half) - side(half + 1, 2 * half)).alias("z"), F.posexplode("pc").alias("k", "pc"))
    rho = T.spearman(scored, ["cohort", "k"], "pc", "z").select("cohort", "k", F.round(F.abs("rho"), 6).alias("rho"))
    best = rho.groupBy("cohort").agg(F.max_by("k", F.struct("rho", -F.col("k"))).alias("best"), F.max("rho").alias("best_rho"))
    share = t.spark.createDataFrame([(int(c), m.rows, *(round(float(v), 6) for v in m.share[:components])) for c, m in models.items()], f"cohort long, n_samples long, {', '.join(f'pc{k + 1}_share double' for k in range(components))}")
    return share.join(tested, "cohort").join(best.select("cohort", (F.col("best") + 1).cast("long").alias("pc_best"), "best_rho"), "cohort")


@query()
def contrastive_components(t, alphas: tuple = (0.5, 1.0, 2.0), components: int = 2):
    """Loadings of the directions in which cases (label 1) vary more than controls (label 0), each centred within its cohort."""
    rows = vectors(t).filter("label IN (0, 1)")
    wide = M.width_of(rows)
    sums = M.products(rows, ["label", "cohort"], wide).filter("bi = 0 AND bj = 0").select("label", "cohort", F.slice("v", 1, wide + 1).alias("v")).collect() if wide < 256 else None
    if sums is None:
        sums = M.sum_arrays(rows.select("label", "cohort", F.concat(F.array(F.lit(1.0)), "x").alias("v")), ["label", "cohort"]).collect()
    mean = {(r["label"], r["cohort"]): np.array(r["v"][1:]) / r["v"][0] for r in sums}  # labels times cohorts

    def centre(batches):
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "x": [v - mean[k] for k, v in zip(zip(b["label"], b["cohort"]), M.stacked(b["x"]))]})

    found = pca.contrastive(rows.mapInPandas(centre, "label long, x array<double>"), "label", 1, 0, list(alphas), components)
    out = [(float(a), k + 1, f + 1, round(float(w[k]), 6), round(float(v[f, k]), 6)) for a, (w, v) in found.items() for k in range(components) for f in range(wide)]
    return t.spark.createDataFrame(out, "alpha double, component long, feature long, eigenvalue double, loading double")


def nested_cv(rows, grid=C_GRID, penalties=("l1", "l2"), passes: int = 200, folds: dict | None = None):
    """(blocks, models, chosen): leave-one-cohort-out with an inner leave-one-cohort-out that picks the strength.

    rows: cohort, y, x. folds: outer cohort -> the cohorts of its fold, itself among them; all cohorts without it. All models of all outer and inner folds train at once on all their rows; chosen has penalty,
    outer, c, inner_auc and the threshold of best Youden index on the inner held-out scores.
    """
    blocks = L.packed(rows, "cohort", "y", "x")
    moments = L.moments_by_class(rows, "cohort", "y", "x")
    cohorts = sorted({k[0] for k in moments})
    folds = folds or {o: cohorts for o in cohorts}
    models = [L.Model(p, c, o, i, [k for k in own if k not in (o, i)]) for p in penalties for c in grid for o, own in folds.items() for i in (*[k for k in own if k != o], None)]
    L.fit_all(blocks, moments, models, passes)
    inner = L.scored(blocks, [m for m in models if m.inner is not None], "inner")
    keys = ["penalty", "c", "outer"]
    auc = T.auroc(inner, keys).select(*keys, F.round("auroc", 6).alias("inner_auc"))
    best = auc.groupBy("penalty", "outer").agg(F.max_by(F.struct("c", "inner_auc"), F.struct(F.coalesce("inner_auc", F.lit(-1.0)), -F.col("c"))).alias("b")).select("penalty", "outer", "b.*")
    oof = inner.join(best.drop("inner_auc"), ["penalty", "outer", "c"])
    values = oof.groupBy("penalty", "outer", "score").agg(F.sum("y").cast("double").alias("p"), (F.count(F.lit(1)) - F.sum("y")).cast("double").alias("q"))
    total = values.groupBy("penalty", "outer").agg(F.sum("p").alias("ap"), F.sum("q").alias("aq"))
    cut = binned_prefix(values, ["penalty", "outer"], "score", ["p", "q"]).join(total, ["penalty", "outer"])
    j = (F.col("ap") - F.col("before_p")) / F.col("ap") - (F.col("aq") - F.col("before_q")) / F.col("aq")
    youden = cut.groupBy("penalty", "outer").agg(F.max_by("score", F.struct(F.round(j, 12), "score")).alias("threshold"))
    return blocks, models, best.join(youden, ["penalty", "outer"])


@query()
def logistic_nested_cv(t):
    """L1 and L2 logistic by leave-one-cohort-out, strength chosen by inner folds, every row trains and every held-out row is scored."""
    rows = vectors(t).select("cohort", F.when(F.col("label") <= 4, 1).otherwise(0).alias("y"), "x")
    blocks, models, chosen = nested_cv(rows)
    picked = [r.asDict() for r in chosen.collect()]  # penalties times cohorts
    keep = [m for m in models if m.inner is None and any((m.penalty, m.outer, m.c) == (r["penalty"], r["outer"], r["c"]) for r in picked)]
    size = t.spark.createDataFrame([(m.penalty, int(m.outer), int((np.abs(m.w[1:]) > 1e-10).sum())) for m in keep], "penalty string, outer long, n_selected long")
    held = T.auroc(L.scored(blocks, keep, "outer"), ["penalty", "outer"]).select("penalty", "outer", (F.col("n_pos") + F.col("n_neg")).alias("n"), F.round("auroc", 4).alias("auroc"))
    return chosen.join(size, ["penalty", "outer"]).join(held, ["penalty", "outer"]).select("penalty", F.col("outer").alias("fold"), "c", F.round("inner_auc", 4).alias("inner_auc"), F.round("threshold", 3).alias("threshold"), "n_selected", "n", "auroc")


@query()
def metacells(t, components: int = 8):
    """Metacells of every cohort and label in the space of the leading components: size, and spread of its samples."""
    rows = vectors(t)
    models = pca.fit(rows.select(F.lit(0).cast("long").alias("all"), "x"), "all", components, missing=False)
    placed = pca.transform(rows.select("sample", (F.col("cohort") * 100 + F.col("label")).alias("grp"), F.lit(0).cast("long").alias("all"), "x"), models, "all")
    assigned, _ = _metacells(placed.select("grp", "sample", F.col("pc").alias("x")), "grp", "sample", size=10, most=20, least=4)
    return assigned.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 4).alias("spread")).select(F.floor(F.col("grp") / 100).alias("cohort"), (F.col("grp") % 100).alias("label"), F.col("cell").cast("long").alias("cell"), "n", "spread")


def _sum(a: int, b: int):
    """Mean of the features a..b, 1-based."""
    return F.aggregate(F.slice("x", a, b - a + 1), F.lit(0.0), lambda s, v: s + v) / (b - a + 1)


@query()
def baselines(t, components: int = 8, alphas: tuple = (0.5, 2.0)):
    """Held-out AUROC of seven baselines by leave-one-cohort-out: a signed score, programs, LASSO, ridge, ridge on centred features, on components and on contrastive components.

    Cases are label 1, the other patients labels 2 to 4, controls label 0. What is fitted (signs, components, strengths)
    comes from the fold's other cohorts; every fold's rows carry its own name, so all folds train in the same passes.
    """
    rows = vectors(t).filter("label <= 4").withColumn("y", (F.col("label") == 1).cast("int"))
    wide = M.width_of(rows)
    cohorts = list(range(COHORTS))
    means = {r["cohort"]: (np.array(r["v"]) / r["n"]) for r in M.sum_arrays(rows.filter("label > 0").select("cohort", F.concat(F.array(F.lit(1.0)), "x").alias("v")), ["cohort"]).select("cohort", F.col("v")[0].alias("n"), F.slice("v", 2, 1 << 30).alias("v")).collect()}
    controls = {r["cohort"]: (np.array(r["v"]) / r["n"]) for r in M.sum_arrays(rows.filter("label = 0").select("cohort", F.concat(F.array(F.lit(1.0)), "x").alias("v")), ["cohort"]).select("cohort", F.col("v")[0].alias("n"), F.slice("v", 2, 1 << 30).alias("v")).collect()}
    programs = np.zeros((wide, components))
    for k in range(wide):
        programs[k, k * components // wide] = 1 / max(1, -(-wide // components))
    each = _training(rows).select("fold", "x")
    lead = {o: m.loadings for o, m in pca.fit(each, "fold", components, missing=False).items()}
    centre = {o: m.mean for o, m in pca.fit(each, "fold", 1, missing=False).items()}

    def centred(batches):
        for b in batches:
            yield b.assign(x=[v - (controls if lab == 0 else means)[c] for c, lab, v in zip(b["cohort"], b["label"], M.stacked(b["x"]))])

    apart = rows.select("cohort", "label", "x").mapInPandas(centred, "cohort long, label long, x array<double>").withColumn("arm", (F.col("label") > 0).cast("int"))
    turned = {(a, o): v for o in cohorts for a, (_, v) in pca.contrastive(apart.filter(F.col("cohort") != o), "arm", 1, 0, list(alphas), components).items()}

    def small(batches):
        """The fold's transform of each row of a baseline with few features: programs, components, contrastive ones."""
        for b in batches:
            x, out = M.stacked(b["x"]), []
            for c, y, v in zip(b["cohort"], b["y"], x):
                for o in cohorts:
                    own = v if c == o else v - means[c]
                    out += [(f"program|{o}|{c}", y, own @ programs), (f"pca|{o}|{c}", y, (v - centre[o]) @ lead[o])]
                    out += [(f"cpca {a}|{o}|{c}", y, own @ turned[a, o]) for a in alphas]
            yield pd.DataFrame(out, columns=["cohort", "y", "x"])

    def large(batches):
        for b in batches:
            out = []
            for c, y, v in zip(b["cohort"], b["y"], M.stacked(b["x"])):
                out += [(f"{name}|{o}|{c}", y, v if name == "plain" or c == o else v - means[c]) for name in ("plain", "unit centred") for o in cohorts]
            yield pd.DataFrame(out, columns=["cohort", "y", "x"])

    patients = rows.filter("label > 0").select("cohort", "y", "x")
    fold = lambda name: {f"{name}|{o}|{o}": [f"{name}|{o}|{c}" for c in cohorts] for o in cohorts}
    many = lambda names: {k: v for n in names for k, v in fold(n).items()}
    found = []
    for f, names, penalties in ((small, ["program", "pca", *(f"cpca {a}" for a in alphas)], ("l2",)), (large, ["plain", "unit centred"], ("l1", "l2"))):
        blocks, models, chosen = nested_cv(patients.mapInPandas(f, "cohort string, y int, x array<double>"), penalties=penalties, folds=many(names))
        best = {(r["penalty"], r["outer"]): (r["c"], r["inner_auc"]) for r in chosen.collect()}  # penalties times folds
        keep = [m for m in models if m.inner is None and best.get((m.penalty, m.outer), (None,))[0] == m.c]
        auc = T.auroc(L.scored(blocks, keep, "outer"), ["penalty", "outer"]).collect()
        found += [(r["penalty"], *r["outer"].split("|")[:2], *best[r["penalty"], r["outer"]], r["auroc"]) for r in auc]
    names = {("l2", "program"): "programs ridge", ("l2", "pca"): "components ridge", ("l1", "plain"): "lasso", ("l2", "plain"): "ridge", ("l2", "unit centred"): "unit-centred ridge"}
    lines = [(names[p, n], int(o), c, i, a) for p, n, o, c, i, a in found if (p, n) in names]
    for o in cohorts:  # the alpha of best inner AUROC
        options = [(i if i is not None else -1.0, -float(n.split()[1]), c, i, a) for _, n, k, c, i, a in found if n.startswith("cpca") and int(k) == o]
        if options:
            *_, c, i, a = max(options)
            lines.append(("contrastive ridge", o, c, i, a))
    scores = rows.filter("label > 0").select("cohort", "y", (_sum(1, 6) - _sum(7, 12)).alias("score"))
    sides = _training(scores).groupBy("fold").agg((F.avg(F.when(F.col("y") == 1, F.col("score"))) - F.avg(F.when(F.col("y") == 0, F.col("score")))).alias("d"))
    signed = scores.withColumnRenamed("cohort", "fold").join(sides, "fold").withColumn("score", F.col("score") * F.when(F.col("d") < 0, -1.0).otherwise(1.0))
    plain = T.auroc(signed, "fold").select(F.lit("signed score").alias("baseline"), "fold", F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("inner_auc"), F.round("auroc", 4).alias("auroc"))
    fitted = t.spark.createDataFrame([(n, o, c, None if i is None else round(i, 4), None if a is None else round(a, 4)) for n, o, c, i, a in lines], "baseline string, fold long, c double, inner_auc double, auroc double")
    return fitted.union(plain)
