"""Expected-species rates (C11) and empirical-Bayes shrinkage (C12).

The reference fills a full grid per block (every checklist × species × month,
``complete``) and then averages. The grid has checklists × species × months
rows per block; here the same numbers come from real rows only:

    rows(b, s, m)          = C_b - D(b, s, m) + R(b, s, m)
    observations(b, s, m)  = O(b, s, m)
    checklist_count(b,s,m) = C_b

with C_b the distinct checklists of the block, R / D / O the real rows,
distinct checklists and non-missing counts of (b, s, m). The observations are
read once: one aggregate to (block, species, checklist, month), then GROUPING
SETS ((block, species), (block, checklist)) give R, D, O and C_b from one
expansion of that small table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwise.functions.semantics import MONTH_ABB, parse_number, r_div
from blockwise.operators.joins import join_on
from blockwise.plans.lookups import BREEDING, SEASON_MONTHS
from blockwise.session import materialize


def expected_species(
    obs: DataFrame,
    months: Sequence[str] = tuple(SEASON_MONTHS[BREEDING]),
    block: str = "pba3_block",
    species: str = "common_name",
    checklist: str = "checklist_id",
    count_col: str = "observation_count",
    month_num_col: str = "observation_month_num",
) -> DataFrame:
    """Per (block, species, month): observations, checklist_count, observed_pct over the full grid."""
    nums = [MONTH_ABB.index(m) + 1 for m in months]
    b = obs.where(F.col(month_num_col).isin(nums)).select(
        block, species, checklist, F.col(month_num_col).alias("month_num"), parse_number(count_col).alias("cnt")
    )
    base = b.groupBy(block, species, checklist, "month_num").agg(F.count(F.lit(1)).alias("r"), F.count("cnt").alias("o"))
    at = [F.col("month_num") == n for n in nums]
    sums = [a for i, m in enumerate(at) for a in (F.sum(F.when(m, F.col("r"))).alias(f"R{i}"), F.count_if(m).alias(f"D{i}"), F.sum(F.when(m, F.col("o"))).alias(f"O{i}"))]
    sets = base.groupingSets([[F.col(block), F.col(species)], [F.col(block), F.col(checklist)]], block, species, checklist)
    # grouping_id: 1 for (block, species), 2 for (block, checklist); the latter are only counted by block.
    per = sets.agg(F.grouping_id().alias("g"), *sums).groupBy(block, species, "g")
    per = per.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(len(nums)) for c in "RDO"])
    # At most a row per species and one for the checklists share a block.
    checklists = F.max(F.when(F.col("g") == 2, F.col("n"))).over(Window.partitionBy(block))
    g = per.withColumn("checklist_count", checklists).where("g = 1")
    months = F.array(*[F.struct(F.lit(n).alias("month_num"), *[F.col(f"{c}{i}").alias(c) for c in "RDO"]) for i, n in enumerate(nums)])
    g = g.select(block, species, "checklist_count", F.inline(months))
    rows = F.col("checklist_count") - F.coalesce(F.col("D"), F.lit(0)) + F.coalesce(F.col("R"), F.lit(0))
    obs_n = F.coalesce(F.col("O"), F.lit(0))
    label = F.when(
        F.col("month_num").isNotNull(), F.element_at(F.array(*[F.lit(m) for m in MONTH_ABB]), F.col("month_num"))
    )
    return g.select(
        block,
        species,
        label.alias("observation_month"),
        "month_num",
        obs_n.cast("long").alias("observations"),
        F.col("checklist_count").cast("long"),
        (obs_n / rows).alias("observed_pct"),
    )


def expected_species_total(es: DataFrame, species: str = "common_name") -> DataFrame:
    """Per species: summed checklists and observations over blocks and months."""
    return es.groupBy(species).agg(
        F.sum("checklist_count").alias("checklist_count"), F.sum("observations").alias("observations")
    )


def beta_moments(es: DataFrame, x: str = "observations", n: str = "checklist_count") -> DataFrame:
    """Beta prior by the method of moments on x / n (rows with n > 0): one row (alpha, beta, mean)."""
    p = F.col(x) / F.col(n)
    m = es.where(F.col(n) > 0).agg(F.avg(p).alias("mu"), F.var_samp(p).alias("v"))
    total = F.col("mu") * (1 - F.col("mu")) / F.col("v") - 1
    return m.select(
        (F.col("mu") * total).alias("alpha"), ((1 - F.col("mu")) * total).alias("beta"), F.col("mu").alias("mean")
    )


def _polygamma(z: Column) -> tuple[Column, Column]:
    """Digamma and trigamma of a positive column: shifted by 8 by their recurrences, then the asymptotic series."""
    first = second = F.lit(0.0)
    for k in range(8):
        first, second = first - 1 / (z + k), second + 1 / ((z + k) * (z + k))
    y = z + 8
    r = 1 / (y * y)
    digamma = F.ln(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))
    trigamma = 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))
    return first + digamma, second + trigamma


#: Sum of the parameters beyond which a prior is as good as a constant.
_RUNAWAY = 1e6


def _newton(a: Column, b: Column, sums: dict[str, Column]) -> tuple[Column, Column]:
    """Step of the logarithms of (a, b) from sums over the data: Newton where the surface is concave, else uphill; at most 1."""
    trig_a, trig_b, trig_ab = (_polygamma(c)[1] for c in (a, b, a + b))
    psi_a, psi_b, psi_ab = (_polygamma(c)[0] for c in (a, b, a + b))
    c = sums["c"]
    ga = sums["x0"] - sums["n0"] + c * (psi_ab - psi_a)
    gb = sums["f0"] - sums["n0"] + c * (psi_ab - psi_b)
    haa = sums["x1"] - sums["n1"] + c * (trig_ab - trig_a)
    hbb = sums["f1"] - sums["n1"] + c * (trig_ab - trig_b)
    hab = c * trig_ab - sums["n1"]
    # derivatives by the logarithms
    da, db, paa, pbb, pab = a * ga, b * gb, a * a * haa + a * ga, b * b * hbb + b * gb, a * b * hab
    det = paa * pbb - pab * pab
    concave = (paa < 0) & (det > 0)
    clip = lambda s: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))
    sa = F.when(concave, -(da * pbb - db * pab) / det).otherwise(da / (F.abs(paa) + F.abs(pab)))
    sb = F.when(concave, -(db * paa - da * pab) / det).otherwise(db / (F.abs(pbb) + F.abs(pab)))
    return clip(sa), clip(sb)


def beta_binomial_priors(
    es: DataFrame, group: str, x: str = "observations", n: str = "checklist_count", tol: float = 1e-6, max_steps: int = 60
) -> DataFrame:
    """Beta-binomial maximum likelihood priors per ``group`` (NULL is a group): (group, alpha, beta, mean, steps, converged).

    Newton steps on the logarithms of the parameters, for all groups at once. The
    distinct (group, x, n) with their counts are stored once; a step is one
    aggregate of them, joined by the group's present parameters, and groups that
    have converged drop out of it. Starts from the moment estimates. A group
    whose likelihood has no finite maximum (all rates equal, say: the parameters run
    away beyond a million) ends unconverged.
    """
    rates = es.where(F.col(n) > 0).select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(n).cast("double").alias("n"))
    base = materialize(rates.groupBy("g", "x", "n").agg(F.count(F.lit(1)).cast("double").alias("c")), "prior-base")
    p, c = F.col("x") / F.col("n"), F.col("c")
    mom = base.groupBy("g").agg(F.sum(c).alias("rows"), (F.sum(c * p) / F.sum(c)).alias("mu"), F.sum(c * p * p).alias("pp"))
    v = (F.col("pp") - F.col("rows") * F.col("mu") * F.col("mu")) / (F.col("rows") - 1)
    total = F.when((F.col("rows") > 1) & (v > 0), F.col("mu") * (1 - F.col("mu")) / v - 1)
    start = lambda share: F.when(total * share > 0, total * share).otherwise(F.lit(1.0))
    state = materialize(mom.select("g", start(F.col("mu")).alias("a"), start(1 - F.col("mu")).alias("b"), F.lit(0).alias("steps"), F.lit(False).alias("converged"), F.lit(False).alias("done")), "prior-state")
    a, b = F.col("a"), F.col("b")
    for _ in range(max_steps):
        moving = state.where("not done")
        if moving.isEmpty():
            break
        at = {"x": _polygamma(F.col("x") + a), "f": _polygamma(F.col("n") - F.col("x") + b), "n": _polygamma(F.col("n") + a + b)}
        sums = [F.sum(c).alias("c"), *[F.sum(c * at[k][d]).alias(f"{k}{d}") for k in at for d in (0, 1)]]
        added = join_on(base, moving, ["g"], null_safe=True).groupBy("g", "a", "b", "steps").agg(*sums)
        sa, sb = _newton(a, b, {k: F.col(k) for k in ("c", "x0", "x1", "f0", "f1", "n0", "n1")})
        moved = added.select("g", "a", "b", "steps", sa.alias("sa"), sb.alias("sb"))
        moved = moved.select("g", (a * F.exp("sa")).alias("a"), (b * F.exp("sb")).alias("b"), (F.col("steps") + 1).alias("steps"), (F.greatest(F.abs("sa"), F.abs("sb")) < tol).alias("small"))
        runaway = a + b > _RUNAWAY
        moved = moved.select("g", "a", "b", "steps", (F.col("small") & ~runaway).alias("converged"), (F.col("small") | runaway).alias("done"))
        state = materialize(state.where("done").unionByName(moved), "prior-state")
    return state.select(F.col("g").alias(group), a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"), "steps", "converged")


def beta_binomial_mle(
    es: DataFrame, x: str = "observations", n: str = "checklist_count", tol: float = 1e-6, max_steps: int = 60
) -> tuple[float, float]:
    """Beta-binomial maximum likelihood prior of the whole table (one group); raises when the steps do not converge."""
    prior = beta_binomial_priors(es.withColumn("__all", F.lit(0)), "__all", x, n, tol, max_steps).first()
    if prior is None:
        return float("nan"), float("nan")
    if not prior["converged"]:
        raise ArithmeticError(f"the prior did not converge in {max_steps} steps (alpha {prior['alpha']}, beta {prior['beta']})")
    return prior["alpha"], prior["beta"]


def eb_shrink(
    es: DataFrame,
    alpha: float,
    beta: float,
    x: str = "observations",
    n: str = "checklist_count",
) -> DataFrame:
    """Add raw and shrunken rates: raw = x/n, fitted = (x+alpha)/(n+alpha+beta), and posterior parameters."""
    if not (math.isfinite(alpha) and math.isfinite(beta)):
        raise ValueError("prior parameters must be finite")
    return es.withColumns(
        {
            "alpha1": F.col(x) + F.lit(alpha),
            "beta1": F.col(n) - F.col(x) + F.lit(beta),
            "raw": r_div(x, n),
            "fitted": (F.col(x) + F.lit(alpha)) / (F.col(n) + F.lit(alpha + beta)),
            "prior_mean": F.lit(alpha / (alpha + beta)),
        }
    )


def eb_shrink_moments(es: DataFrame, x: str = "observations", n: str = "checklist_count") -> DataFrame:
    """Shrink with the moment prior (one scalar aggregate, then column maths)."""
    p = beta_moments(es, x, n).first()
    return eb_shrink(es, float(p["alpha"]), float(p["beta"]), x, n)


def weighted_rate(es: DataFrame) -> DataFrame:
    """``observed_pct * checklist_count`` (the map variable of the reference)."""
    return es.withColumn("observed_pct_weighted", F.col("observed_pct") * F.col("checklist_count"))
