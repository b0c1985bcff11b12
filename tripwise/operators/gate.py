"""Welfare gate: chance of a net benefit and expected regret of ranked places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions import normal_cdf, normal_pdf
from tripwise.functions.text import lookup

MODES = ("standard", "pup", "rm", "pup_rm")


def score_to_utility(score: Column, subtype: Column, mode: str = "subtype_base_plus_score",
                     scale: float = P.GATE["score_scale"]) -> Column:
    """Ranking score on the scale of activity utility."""
    positive = F.greatest(F.lit(0.0), score)
    if mode == "identity":
        return positive
    if mode == "subtype_base_plus_score":
        return lookup({s: v["utility"] for s, v in P.SEGMENTS.items()}, subtype, 0.0) + scale * positive
    raise ValueError(f"unknown score-to-utility mode: {mode}")


def travel_cost_estimate(distance_km: Column, vot: Column, speed_kmh: float = P.GATE["speed_kmh"],
                         cost_per_km: float = P.GATE["cost_per_km"]) -> Column:
    """Cost of a trip at the user's value of time (the default for unknown users)."""
    v = F.coalesce(vot, F.lit(P.GATE["default_vot"]))
    return v * (distance_km / max(1.0, speed_kmh)) + distance_km * cost_per_km


def user_uncertainty(n: Column) -> Column:
    """Falls with the root of the observations; 1 without any."""
    seen = F.greatest(F.lit(P.GATE["sigma_floor"]), 1.0 / F.sqrt(n.cast("double")))
    return F.when(n > 0, seen).otherwise(F.lit(1.0))


def pup(value: Column, cost: Column, sigma: Column) -> Column:
    """Probability that the net utility is not negative."""
    step = F.when(value >= cost, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(sigma <= 0, step).otherwise(normal_cdf((value - cost) / sigma))


def expected_regret(value: Column, cost: Column, sigma: Column, best: float = 0.0) -> Column:
    """Expected shortfall against the best known alternative."""
    mu = value - cost
    z = (mu - best) / sigma
    spread = sigma * normal_pdf(z) + (best - mu) * normal_cdf(-z)
    return F.when(sigma <= 1e-8, F.greatest(F.lit(0.0), best - mu)).otherwise(spread)


def annotate(answers: DataFrame, state: DataFrame, alpha: Column | float = P.GATE["pup_alpha"],
             epsilon: Column | float = P.GATE["rm_epsilon"], score_mode: str = "subtype_base_plus_score") -> DataFrame:
    """Ranked rows (user_id, subtype, score, distance_km) with their welfare estimates.
    ``state``: user_id, n, vot."""
    rows = answers.join(state.select("user_id", F.col("n").alias("_n"), F.col("vot").alias("_vot")), "user_id", "left")
    rows = rows.select(
        *answers.columns, score_to_utility(F.col("score"), F.col("subtype"), score_mode).alias("v_hat"),
        travel_cost_estimate(F.col("distance_km"), F.col("_vot")).alias("c_hat"),
        user_uncertainty(F.coalesce("_n", F.lit(0))).alias("sigma"),
    )
    rows = rows.withColumns({
        "pup": pup(F.col("v_hat"), F.col("c_hat"), F.col("sigma")),
        "expected_regret": expected_regret(F.col("v_hat"), F.col("c_hat"), F.col("sigma")),
    })
    return rows.withColumns({"passed_pup": F.col("pup") >= alpha, "passed_rm": F.col("expected_regret") <= epsilon})


def welfare_gate(answers: DataFrame, state: DataFrame, mode: Column | str = "pup", **limits) -> DataFrame:
    """Annotated rows that pass the gate.  It filters the finished top-k lists, so a
    list may become empty; it never looks further down the ranking."""
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    rows = annotate(answers, state, **limits)
    ok = (
        F.when(mode == "pup", F.col("passed_pup")).when(mode == "rm", F.col("passed_rm"))
        .when(mode == "pup_rm", F.col("passed_pup") & F.col("passed_rm")).otherwise(F.lit(True))
    )
    return rows.where(ok)


def abstentions(opportunities: DataFrame, passed: DataFrame, keys: list[str]) -> DataFrame:
    """Opportunities with no surviving recommendation."""
    return opportunities.join(passed.select(*keys).distinct(), keys, "left_anti")


def gate_sweep(annotated: DataFrame, requests: DataFrame, alphas, ceilings: DataFrame) -> DataFrame:
    """Net value and abstention per (gate, threshold, seed) of annotated answers (rid, seed,
    rank and estimates): every probability threshold of ``alphas``, and every regret
    ceiling of the table (pct, epsilon), in one pass over the answers.

    A request is served by its best-ranked answer that passes; ``requests`` (rid, seed) has
    those without any answer too.  Without a served request the mean is 0.
    """
    kind = "array<struct<gate:string,threshold:double,limit:double>>"
    fixed = F.array(*[F.struct(F.lit("pup").alias("gate"), F.lit(float(a)).alias("threshold"), F.lit(float(a)).alias("limit")) for a in alphas]).cast(kind)
    found = ceilings.agg(F.collect_list(F.struct(F.lit("rm").alias("gate"), F.col("pct").cast("double").alias("threshold"), F.col("epsilon").alias("limit"))).alias("c"))
    grid = F.concat(fixed, found.scalar().cast(kind))
    cells = requests.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.explode(grid)).select("seed", "_n", "_g.gate", "_g.threshold")
    passing = F.filter("_grid", lambda g: F.when(g["gate"] == "pup", F.col("pup") >= g["limit"]).otherwise(F.col("expected_regret") <= g["limit"]))
    rows = annotated.withColumn("_grid", grid).select("rid", "seed", "rank", (F.col("v_hat") - F.col("c_hat")).alias("net"), F.explode(passing).alias("_g"))
    served = rows.groupBy("rid", "seed", "_g.gate", "_g.threshold").agg(F.min_by("net", "rank").alias("net"))
    per_seed = served.groupBy("gate", "threshold", "seed").agg(F.avg("net").alias("_mean"), F.count(F.lit(1)).alias("_served"))
    joined = cells.join(per_seed, ["gate", "threshold", "seed"], "left")
    return joined.select(
        "gate", "threshold", "seed", F.coalesce("_mean", F.lit(0.0)).alias("mean_utility"),
        (1.0 - F.coalesce("_served", F.lit(0)) / F.col("_n")).alias("abstention_rate"))
