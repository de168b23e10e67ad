"""Subject-level study summaries and tests: sections are repeated measurements, subjects are the units."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.distributions import normal_p_value, t_critical, t_p_value
from ..functions.numeric import Z_975
from .ranking import benjamini_hochberg

FAMILY_PARTS = 32
_SUBJECT = ("subject_id", "condition", "metric")


def subject_means(records: DataFrame, sections: DataFrame) -> DataFrame:
    """Equal-weight mean over a subject's sections per condition, ROI class, metric, units and version."""
    keys = ["subject_id", "condition", "roi_class", "metric", "units", "method_version"]
    return (records.join(sections.select("section_id", "subject_id", "condition", "roi_class"), "section_id")
            .groupBy(*keys).agg(F.avg("value").alias("mean_of_section_summaries"), F.count("*").alias("section_count")))


def missing_sections(records: DataFrame, sections: DataFrame, metrics: DataFrame) -> DataFrame:
    """Declared section x metric cells without a record, for a declared family of any size.

    Only sections that lack some metric are laid out against the family, which is dealt to ``FAMILY_PARTS`` parts.
    """
    family = metrics.select("metric").distinct()
    recorded = records.join(family, "metric", "left_semi").select("section_id", "metric").distinct()
    whole = recorded.groupBy("section_id").agg(F.count("*").alias("n")).filter(F.col("n") == family.count())
    dealt = family.withColumn("part", F.pmod(F.hash("metric"), F.lit(FAMILY_PARTS)))
    declared = (sections.select("section_id", "subject_id", "condition").join(whole, "section_id", "left_anti")
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FAMILY_PARTS - 1)))).join(dealt, "part").drop("part"))
    return declared.join(recorded, ["section_id", "metric"], "left_anti")


def confounding(sections: DataFrame) -> DataFrame:
    per_batch = sections.groupBy("batch").agg(F.count_distinct("condition").alias("k"), F.min("condition").alias("c0"), F.max("condition").alias("c1"))
    return per_batch.agg(F.bool_and(F.col("k") == 1).alias("_single"), (F.min("c0") != F.max("c1")).alias("_several")).select(
        (F.col("_single") & F.col("_several")).alias("condition_batch_complete_confounding"))


def subjects_per_condition(sections: DataFrame) -> DataFrame:
    return sections.groupBy("condition").agg(F.count_distinct("subject_id").alias("subjects"))


def complete_records(records: DataFrame, missing: DataFrame, policy: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(usable records, metrics that cannot be tested) under reject or complete_subjects."""
    if policy == "reject":
        blocked = missing.select("metric").distinct()
        return records.join(blocked, "metric", "left_anti"), blocked
    if policy != "complete_subjects":
        raise ValueError("missing policy must be reject or complete_subjects")
    return records.join(missing.select("metric", "subject_id").distinct(), ["metric", "subject_id"], "left_anti"), missing.select("metric").limit(0)


def _arm(records: DataFrame, control: str, case: str) -> DataFrame:
    means = records.filter(F.col("condition").isin(control, case)).groupBy(*_SUBJECT).agg(F.avg("value").alias("v"))
    return means.withColumn("is_case", F.col("condition") == case)


def _batches(records: DataFrame, control: str, case: str) -> DataFrame:
    """Batches per metric; a t test over several batches is refused, not run unadjusted."""
    batch = F.col("batch") if "batch" in records.columns else F.lit("")
    return records.filter(F.col("condition").isin(control, case)).groupBy("metric").agg(F.count_distinct(batch).alias("_batches"))


def _finish(tests: DataFrame, metrics: DataFrame | None) -> DataFrame:
    tested = F.col("statistic").isNotNull()
    half = F.when(tested, t_critical("degrees_of_freedom")) * F.col("standard_error")
    out = tests.withColumns({
        "p_value": F.when(tested, t_p_value("statistic", "degrees_of_freedom")), "ci_low": F.col("effect") - half, "ci_high": F.col("effect") + half})
    if metrics is not None:  # a metric that lost all its records still belongs to the family
        out = metrics.select("metric").distinct().join(out, "metric", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("statistic").isNull(), F.lit("missing_declared_sections"))))
    out = out.withColumn("status", F.when(F.col("p_value").isNotNull(), "tested").otherwise("not_tested"))
    return benjamini_hochberg(out, failed_as_one=True)


def welch(records: DataFrame, control: str, case: str, metrics: DataFrame | None = None) -> DataFrame:
    """Welch test of subject means per metric (records: subject_id, condition, metric, value)."""
    arms = _arm(records, control, case)
    overlap = arms.groupBy("metric", "subject_id").agg(F.count_distinct("condition").alias("k")).groupBy("metric").agg(F.max("k").alias("k"))
    g = lambda side, f: f(F.when(F.col("is_case") == side, F.col("v")))
    s = arms.groupBy("metric").agg(
        g(False, F.count).alias("n0"), g(True, F.count).alias("n1"), g(False, F.avg).alias("m0"), g(True, F.avg).alias("m1"),
        g(False, F.var_samp).alias("s0"), g(True, F.var_samp).alias("s1")).join(overlap, "metric").join(_batches(records, control, case), "metric")
    a, b = F.col("s0") / F.col("n0"), F.col("s1") / F.col("n1")
    reason = (F.when(F.least("n0", "n1") < 3, "fewer_than_three_subjects_per_condition")
              .when(F.col("_batches") > 1, "several_batches_need_a_mixed_model")
              .when(F.col("k") > 1, "subjects_occur_in_both_conditions").when(~((a + b) > 0), "zero_variance"))
    s = s.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return _finish(s.select(
        "metric", "n0", "n1", "reason", F.when(ok, F.col("m1") - F.col("m0")).alias("effect"), F.when(ok, F.sqrt(a + b)).alias("standard_error"),
        F.when(ok, (F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("statistic"),
        F.when(ok, (a + b) * (a + b) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))).alias("degrees_of_freedom")), metrics)


def paired_t(records: DataFrame, control: str, case: str, metrics: DataFrame | None = None) -> DataFrame:
    """Paired t of subject means; the same subjects must occur in both arms."""
    arms = _arm(records, control, case)
    pairs = arms.groupBy("metric", "subject_id").agg(F.max(F.when(~F.col("is_case"), F.col("v"))).alias("v0"), F.max(F.when(F.col("is_case"), F.col("v"))).alias("v1"))
    diff = F.col("v1") - F.col("v0")
    s = pairs.groupBy("metric").agg(F.count("*").alias("_all"), F.count(diff).alias("n"), F.avg(diff).alias("d"), F.stddev_samp(diff).alias("sd"))
    s = s.join(_batches(records, control, case), "metric")
    reason = (F.when(F.col("n") < F.col("_all"), "unmatched_subjects").when(F.col("n") < 3, "fewer_than_three_subjects_per_condition")
              .when(F.col("_batches") > 1, "several_batches_need_a_mixed_model")
              .when(F.coalesce("sd", F.lit(0.0)) <= 1e-14, "zero_residual_variance"))
    s = s.withColumn("reason", reason)
    ok, se = F.col("reason").isNull(), F.col("sd") / F.sqrt("n")
    return _finish(s.select("metric", F.col("n").alias("n0"), F.col("n").alias("n1"), "reason", F.when(ok, F.col("d")).alias("effect"),
                            F.when(ok, se).alias("standard_error"), F.when(ok, F.col("d") / se).alias("statistic"),
                            F.when(ok, (F.col("n") - 1).cast("double")).alias("degrees_of_freedom")), metrics)


# --- random-intercept mixed model ------------------------------------------------------------

def _reml(stats: list[dict], p: int) -> dict:
    """Profile REML of a random intercept from sufficient statistics grouped by cluster size."""
    n_obs = sum(s["n"] * s["k"] for s in stats)
    xx = sum(s["xx"] for s in stats)
    xy = sum(s["xy"] for s in stats)
    yy = sum(s["yy"] for s in stats)

    def fit(lam: float):
        a, b, c, logdet = xx.copy(), xy.copy(), yy, 0.0
        for s in stats:
            shrink = lam / (1 + s["n"] * lam)
            a -= shrink * s["ss"]
            b -= shrink * s["st"]
            c -= shrink * s["tt"]
            logdet += s["k"] * np.log1p(s["n"] * lam)
        beta = np.linalg.solve(a, b)
        scale = (c - b @ beta) / (n_obs - p)
        value = logdet + np.linalg.slogdet(a)[1] + (n_obs - p) * np.log(max(scale, 1e-300))
        return value, beta, scale, a

    grid = np.linspace(-25, 15, 81)
    values = [fit(np.exp(g))[0] for g in grid]
    best = int(np.argmin(values))
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    golden = (np.sqrt(5) - 1) / 2
    u, v = high - golden * (high - low), low + golden * (high - low)
    for _ in range(100):
        if fit(np.exp(u))[0] < fit(np.exp(v))[0]:
            high, v = v, u
            u = high - golden * (high - low)
        else:
            low, u = u, v
            v = low + golden * (high - low)
    lam = float(np.exp((low + high) / 2))
    _, beta, scale, a = fit(lam)
    return {"beta": beta, "scale": float(scale), "variance": lam * float(scale), "cov": scale * np.linalg.inv(a)}


def mixed_model(records: DataFrame, control: str, case: str, batches: Sequence[str], covariates: Sequence[str] = (),
                metrics: DataFrame | None = None) -> DataFrame:
    """Random-intercept REML per metric (records: subject_id, condition, batch, metric, value, covariates).

    Spark reduces sections to per-subject sums and then to one row per distinct cluster size, so the
    optimiser of a metric sees a handful of small matrices however many subjects there are.
    """
    used = records.filter(F.col("condition").isin(control, case))
    scales = used.groupBy("metric").agg(F.count("*").alias("_rows"), *[f(c).alias(f"_{t}_{c}") for c in covariates for t, f in (("m", F.avg), ("s", F.stddev_pop))]) if covariates else None
    if covariates:
        used = used.join(scales, "metric")
    terms = [F.lit(1.0), (F.col("condition") == case).cast("double"), *[(F.col("batch") == b).cast("double") for b in list(batches)[1:]],
             *[(F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in covariates]]
    p = len(terms)
    x = used.select("metric", "subject_id", F.col("value").alias("y"), *[t.alias(f"x{i}") for i, t in enumerate(terms)])
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    per_subject = x.groupBy("metric", "subject_id").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("t"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"xy{i}") for i in range(p)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx{i}_{j}") for i, j in upper])
    by_size = per_subject.groupBy("metric", "n").agg(
        F.count("*").alias("k"), F.sum("yy").alias("yy"), F.sum(F.col("t") * F.col("t")).alias("tt"),
        *[F.sum(f"xy{i}").alias(f"xy{i}") for i in range(p)], *[F.sum(F.col(f"s{i}") * F.col("t")).alias(f"st{i}") for i in range(p)],
        *[F.sum(f"xx{i}_{j}").alias(f"xx{i}_{j}") for i, j in upper], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"ss{i}_{j}") for i, j in upper])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        def symmetric(row, name):
            m = np.zeros((p, p))
            for i, j in upper:
                m[i, j] = m[j, i] = row[f"{name}{i}_{j}"]
            return m

        stats = [{"n": r["n"], "k": r["k"], "yy": r["yy"], "tt": r["tt"], "xx": symmetric(r, "xx"), "ss": symmetric(r, "ss"),
                  "xy": np.array([r[f"xy{i}"] for i in range(p)]), "st": np.array([r[f"st{i}"] for i in range(p)])} for _, r in pdf.iterrows()]
        subjects, rows = sum(s["k"] for s in stats), sum(s["n"] * s["k"] for s in stats)
        out = {"metric": pdf["metric"].iloc[0], "subject_count": int(subjects), "section_count": int(rows), "effect": None, "standard_error": None,
               "z": None, "random_intercept_variance": None, "residual_variance": None, "reason": None}
        if subjects < 6 or subjects == rows:
            out["reason"] = "needs_six_subjects_and_repeats"
        elif rows <= p or np.linalg.matrix_rank(sum(s["xx"] for s in stats)) < p:
            out["reason"] = "rank_deficient_design"
        else:
            f = _reml(stats, p)
            se = float(np.sqrt(f["cov"][1, 1]))
            out.update(random_intercept_variance=f["variance"], residual_variance=f["scale"])
            if f["variance"] <= 1e-8 * max(f["scale"], 1e-12):
                out["reason"] = "singular_random_intercept"
            else:
                out.update(effect=float(f["beta"][1]), standard_error=se, z=float(f["beta"][1]) / se)
        return pd.DataFrame([out])

    schema = ("metric string, subject_count bigint, section_count bigint, effect double, standard_error double, z double, "
              "random_intercept_variance double, residual_variance double, reason string")
    fits = by_size.groupBy("metric").applyInPandas(solve, schema)  # one row per distinct sections-per-subject count
    if metrics is not None:
        fits = metrics.select("metric").distinct().join(fits, "metric", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("section_count").isNull(), F.lit("missing_declared_sections"))))
    half = F.lit(Z_975) * F.col("standard_error")
    out = fits.withColumns({"p_value": F.when(F.col("z").isNotNull(), normal_p_value("z")), "ci_low": F.col("effect") - half, "ci_high": F.col("effect") + half})
    return benjamini_hochberg(out.withColumn("status", F.when(F.col("z").isNotNull(), "tested").otherwise("not_tested")), failed_as_one=True)
