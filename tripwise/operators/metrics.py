"""Welfare measures of runs, paired comparisons, threshold sweeps.

A run is a (treatment, seed) pair; both are columns, so one job covers all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators.ordering import exact_percentiles, ranked_counts, value_counts
from tripwise.session import cut


RUN = ["treatment", "seed"]


def net_utility(activity: Column, gen_cost: Column) -> Column:
    """Realised net utility of a leisure trip: benefit minus scaled travel cost."""
    return activity - gen_cost / P.UTILITY["cost_denominator"]


def last_day_leisure(trips: DataFrame) -> DataFrame:
    """Leisure trips of each run's evaluation (last) day, with their net utility."""
    last = trips.groupBy(*RUN).agg(F.max("day").alias("day"))
    leisure = trips.where(F.col("purpose") == "leisure").join(last, RUN + ["day"], "left_semi")
    return leisure.withColumn("u", net_utility(F.col("activity_utility"), F.col("gen_cost")))


def agent_mean_utility(trips: DataFrame) -> DataFrame:
    """Mean net utility per agent over its evaluation-day leisure trips; agents
    without such a trip are absent."""
    return last_day_leisure(trips).groupBy(*RUN, "agent_id").agg(F.avg("u").alias("mean_u"))


def gini(df: DataFrame, keys: list[str], value: str, out: str = "gini") -> DataFrame:
    """Gini coefficient per key; nulls are left out.

    Negative domains are shifted to start at zero; fewer than two values, or a
    zero sum, give 0.
    """
    return gini_of_counts(value_counts(df, keys, value), keys, value, out)


def gini_of_counts(values: DataFrame, keys: list[str], value: str, out: str = "gini") -> DataFrame:
    """Gini coefficient from distinct values with their counts: the n equal values after
    ``before`` smaller ones have the ranks before + 1 to before + n."""
    low = values.groupBy(*keys).agg(F.least(F.min(value), F.lit(0.0)).alias("_lo"))
    ranked = ranked_counts(values, keys, value).join(low, keys)
    x, n, b = F.col(value) - F.col("_lo"), F.col("n"), F.col("before")
    totals = ranked.groupBy(*keys).agg(
        F.sum("n").alias("_n"), F.sum(x * n).alias("_s"), F.sum(x * (b.cast("double") * n + n * (n + 1) / 2.0)).alias("_rs"))
    n, s = F.col("_n"), F.col("_s")
    value_ = (2.0 * F.col("_rs") - (n + 1) * s) / (n * s)
    return totals.select(*keys, F.when((n < 2) | (s == 0), F.lit(0.0)).otherwise(value_).alias(out))


def opportunity_rates(opportunities: DataFrame) -> DataFrame:
    """Abstentions per run: opportunities where no recommendation was left."""
    return opportunities.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n_opportunities"),
        F.avg(F.col("abstained").cast("double")).alias("abstention_rate"),
    )


def table1(trips: DataFrame, opportunities: DataFrame) -> DataFrame:
    """One row per run: mean net utility, negative share, Gini, abstention, counts."""
    # the trips are read for their last days and runs, and once more for the values;
    # mean, share, count and Gini all come from the counted values
    values = value_counts(last_day_leisure(trips), RUN, "u")
    n = F.col("n")
    base = values.groupBy(*RUN).agg(
        (F.sum(F.col("u") * n) / F.sum(n)).alias("mean_utility"),
        (F.sum(F.when(F.col("u") < 0, n).otherwise(0)) / F.sum(n)).alias("neg_rate"),
        F.sum(n).alias("n_leisure_trips"),
    )
    runs = trips.select(*RUN).distinct()
    return (
        runs.join(base, RUN, "left").join(gini_of_counts(values, RUN, "u"), RUN, "left")
        .join(opportunity_rates(opportunities), RUN, "left")
        .na.fill(0.0, ["mean_utility", "neg_rate", "gini", "abstention_rate"])
        .na.fill(0, ["n_leisure_trips", "n_opportunities"])
    )


def paired(df: DataFrame, value: str, keys: list[str], baseline: str = "no_rs") -> DataFrame:
    """Every treatment next to the baseline, matched on ``keys``: columns
    ``treatment``, keys, ``u_t``, ``u_b``.  One join serves all treatments."""
    base = df.where(F.col("treatment") == baseline).select(*keys, F.col(value).alias("u_b"))
    rest = df.where(F.col("treatment") != baseline).select("treatment", *keys, F.col(value).alias("u_t"))
    return rest.join(base, keys)


def table2(trips: DataFrame, baseline: str = "no_rs") -> DataFrame:
    """Harm and gain against the matched baseline run: shares over agents seen in
    both, mean loss over the harmed only."""
    pairs = paired(agent_mean_utility(trips), "mean_u", ["seed", "agent_id"], baseline)
    d = F.col("u_t") - F.col("u_b")
    found = pairs.groupBy(*RUN).agg(
        F.avg((d < 0).cast("double")).alias("harmed_pct"),
        F.avg((d > 0).cast("double")).alias("improved_pct"),
        F.coalesce(F.avg(F.when(d < 0, -d)), F.lit(0.0)).alias("mean_orc"),
        F.count(F.lit(1)).alias("n_matched"),
    )
    runs = trips.where(F.col("treatment") != baseline).select(*RUN).distinct()
    return (
        runs.join(found, RUN, "left")
        .na.fill(0.0, ["harmed_pct", "improved_pct", "mean_orc"]).na.fill(0, ["n_matched"])
    )


def table1_over_seeds(t1: DataFrame) -> DataFrame:
    """Mean over seeds; sigma is the population deviation of the per-seed means."""
    return t1.groupBy("treatment").agg(
        F.avg("mean_utility").alias("mean_utility"), F.stddev_pop("mean_utility").alias("sigma_u"),
        F.avg("neg_rate").alias("neg_rate"), F.avg("abstention_rate").alias("abstention_rate"),
        F.avg("gini").alias("gini"), F.sum("n_leisure_trips").alias("n_leisure_trips"),
    )


def table2_over_seeds(t2: DataFrame) -> DataFrame:
    return t2.groupBy("treatment").agg(
        F.avg("harmed_pct").alias("harmed_pct"), F.avg("improved_pct").alias("improved_pct"),
        F.avg("mean_orc").alias("mean_orc"), F.sum("n_matched").alias("n_matched"),
    )


def headline(t1: DataFrame, t2: DataFrame, summaries: DataFrame) -> DataFrame:
    """Key figures of a study; the paired ones are null for the baseline itself."""
    extra = summaries.groupBy("treatment").agg(
        F.avg("acceptance_rate").alias("acceptance_rate"), F.avg("avg_travel_time_min").alias("avg_travel_time_min"),
    )
    return (
        t1.select("treatment", "mean_utility", "sigma_u", "neg_rate")
        .join(t2.select("treatment", "harmed_pct", "improved_pct", "mean_orc"), "treatment", "left")
        .join(extra, "treatment", "left")
    )


def agent_totals(trips: DataFrame) -> DataFrame:
    """Total utility of all trips per run and agent."""
    return trips.groupBy(*RUN, "agent_id").agg(F.sum("utility").alias("total_u"))


def orc_all_agents(totals: DataFrame, baseline: str = "no_rs") -> DataFrame:
    """Mean loss over all matched agents (not only the harmed ones)."""
    pairs = paired(totals, "total_u", ["seed", "agent_id"], baseline)
    return pairs.groupBy("treatment").agg(
        F.avg(F.greatest(F.lit(0.0), F.col("u_b") - F.col("u_t"))).alias("orc"),
        F.count(F.lit(1)).alias("n_matched"),
    )


def compare_all(totals: DataFrame, keys: list[str] | None = None, baseline: str = "no_rs") -> DataFrame:
    """Gain of every treatment over the baseline on matched agents: mean, median,
    improved and harmed share, both Ginis, mean loss."""
    keys = keys or ["seed", "agent_id"]
    pairs = paired(totals, "total_u", keys, baseline).withColumn("gain", F.col("u_t") - F.col("u_b"))
    # written once: four measures read it
    pairs = cut(pairs.select("treatment", "u_t", "u_b", "gain"))
    base = pairs.groupBy("treatment").agg(
        F.avg("gain").alias("mean_gain"),
        F.avg((F.col("gain") > 0).cast("double")).alias("pct_improved"),
        F.avg((F.col("gain") < 0).cast("double")).alias("pct_harmed"),
        F.avg(F.greatest(F.lit(0.0), -F.col("gain"))).alias("orc"),
    )
    median = exact_percentiles(pairs, ["treatment"], "gain", [0.5]).select(
        "treatment", F.col("percentile").alias("median_gain"))
    return (
        base.join(median, "treatment")
        .join(gini(pairs, ["treatment"], "u_t", "gini_treatment"), "treatment")
        .join(gini(pairs, ["treatment"], "u_b", "gini_baseline"), "treatment")
    )


def welfare_gain(totals: DataFrame, treatment: str, baseline: str = "no_rs") -> DataFrame:
    """One treatment against the baseline."""
    return compare_all(totals.where(F.col("treatment").isin(treatment, baseline)), baseline=baseline)


def run_metrics(trips: DataFrame) -> DataFrame:
    """Per run over the total utility of leisure trips; abstention is one minus
    the acceptance rate here."""
    leisure = trips.where(F.col("purpose") == "leisure")
    base = leisure.groupBy(*RUN).agg(
        F.avg("utility").alias("mean_utility"),
        F.avg((F.col("utility") < 0).cast("double")).alias("neg_rate"),
        (1.0 - F.avg(F.col("accepted").cast("double"))).alias("abstention_rate"),
        F.count(F.lit(1)).alias("n_trips"),
    )
    runs = trips.select(*RUN).distinct()
    return (
        runs.join(base, RUN, "left").join(gini(leisure, RUN, "utility"), RUN, "left")
        .na.fill(0.0, ["mean_utility", "neg_rate", "gini"]).na.fill(1.0, ["abstention_rate"]).na.fill(0, ["n_trips"])
    )


def agent_rollup(members: DataFrame, trips: DataFrame) -> DataFrame:
    """Per run and agent: mean (0 without trips), total and count of leisure utility.
    ``members`` lists who takes part in which run."""
    stats = trips.where(F.col("purpose") == "leisure").groupBy(*RUN, "agent_id").agg(
        F.avg("utility").alias("mean_utility"), F.sum("utility").alias("total_utility"),
        F.count(F.lit(1)).alias("num_leisure_trips"),
    )
    return (
        members.join(stats, RUN + ["agent_id"], "left")
        .na.fill(0.0, ["mean_utility", "total_utility"]).na.fill(0, ["num_leisure_trips"])
    )


def calibrate_epsilon(regrets: DataFrame, value: str, percentile: float = 75.0, default: float = 0.3) -> DataFrame:
    """Regret ceiling at a percentile of the observed regret; ``default`` when there is none."""
    found = exact_percentiles(regrets, [], value, [percentile / 100.0])
    return found.agg(F.coalesce(F.max("percentile"), F.lit(default)).alias("epsilon"))


def regret_proxy(trips: DataFrame, treatment: str = "standard", percentiles=P.PERCENTILES) -> DataFrame:
    """Regret against the mean trip utility of one treatment, at several percentiles."""
    u = trips.where((F.col("treatment") == treatment) & (F.col("purpose") == "leisure")).select("utility")
    mean = u.agg(F.avg("utility").alias("m"))
    proxy = u.select(F.greatest(F.lit(0.0), mean.scalar() - F.col("utility")).alias("regret"))
    found = exact_percentiles(proxy, [], "regret", [p / 100.0 for p in percentiles])
    return found.select(F.round(F.col("share") * 100.0, 0).cast("int").alias("pct"), F.col("percentile").alias("epsilon"))


def threshold_frontier(per_seed: DataFrame) -> DataFrame:
    """Per gate and threshold: mean and deviation over seeds of utility and abstention, and
    whether it is the gate's best threshold (the first one on ties, to six digits)."""
    curve = per_seed.groupBy("gate", "threshold").agg(
        F.avg("mean_utility").alias("mu"), F.stddev_pop("mean_utility").alias("mu_std"),
        F.avg("abstention_rate").alias("abst"), F.stddev_pop("abstention_rate").alias("abst_std"),
    )
    best = curve.groupBy("gate").agg(F.max_by("threshold", F.struct(F.round("mu", 6), -F.col("threshold"))).alias("_best"))
    return curve.join(best, "gate").withColumn("is_best", F.col("threshold") == F.col("_best")).drop("_best")


def condition_table(runs: DataFrame) -> DataFrame:
    """One row per condition: means over seeds, population deviation of the mean."""
    return runs.groupBy("treatment").agg(
        F.avg("mean_utility").alias("mean_u"), F.stddev_pop("mean_utility").alias("sigma_u"),
        F.avg("neg_rate").alias("neg_rate"), F.avg("abstention_rate").alias("abstention"), F.avg("gini").alias("gini"),
    )


def paradigm_heatmap(rollup: DataFrame, baseline: str = "no_rs") -> DataFrame:
    """Mean of agent means by paradigm and treatment, minus the baseline's; cells without
    agents have mean 0."""
    means = rollup.groupBy("paradigm", "treatment").agg(F.avg("mean_utility").alias("m"))
    # every paradigm meets every condition: a cell without agents counts as 0
    conditions = means.where(F.col("treatment") != baseline).agg(F.collect_set("treatment").alias("t"))
    base = means.groupBy("paradigm").agg(F.max(F.when(F.col("treatment") == baseline, F.col("m"))).alias("b"))
    cells = base.withColumn("treatment", F.explode(conditions.scalar())).join(means, ["paradigm", "treatment"], "left")
    return cells.select("paradigm", "treatment", (F.coalesce("m", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("delta"))


def orc_table(totals: DataFrame, baseline: str = "no_rs") -> DataFrame:
    """Harm on total utility: per seed with a neutral band, then mean ± deviation as text."""
    pairs = paired(totals, "total_u", ["seed", "agent_id"], baseline)
    d = F.col("u_t") - F.col("u_b")
    harmed = F.sum((d < -P.NEUTRAL).cast("long"))
    per_seed = pairs.groupBy(*RUN).agg(
        F.avg((d < -P.NEUTRAL).cast("double")).alias("h"), F.avg((d > P.NEUTRAL).cast("double")).alias("i"),
        F.when(harmed > 0, F.sum(F.greatest(F.lit(0.0), -d)) / harmed).otherwise(F.lit(0.0)).alias("o"),
    )
    return per_seed.groupBy("treatment").agg(
        F.format_string("%.1f%%", 100.0 * F.avg("h")).alias("harmed"),
        F.format_string("%.1f%%", 100.0 * F.avg("i")).alias("improved"),
        F.format_string("%.3f ± %.3f", F.avg("o"), F.stddev_pop("o")).alias("mean_orc"),
    )


def matched_seeds(studies: DataFrame, base: str = "seed", count: str = "num_seeds") -> DataFrame:
    """Seed list of every study: as many consecutive seeds from the base as it asks for
    (one at least); ``out_of_range`` reports counts outside 1 to 12."""
    studies = studies.withColumn("out_of_range", ~F.col(count).between(1, P.MAX_SEEDS))
    n = F.greatest(F.col(count), F.lit(1))
    seeds = F.sequence(F.col(base).cast("long"), F.col(base).cast("long") + n - 1)
    return studies.withColumn("run_seed", F.explode(seeds))


def unmatched_runs(trips: DataFrame, baseline: str = "no_rs") -> DataFrame:
    """Treatment runs that lack a baseline twin of the same seed."""
    runs = trips.select(*RUN).distinct()
    twins = runs.where(F.col("treatment") == baseline).select("seed")
    return runs.where(F.col("treatment") != baseline).join(twins, "seed", "left_anti")


def treatment_grid(seeds: DataFrame, treatments=P.TREATMENTS) -> DataFrame:
    """All conditions of a study for every seed: name, gate mode and both thresholds."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("treatment"), F.lit(m).alias("mode"), F.lit(a).alias("pup_alpha"), F.lit(e).alias("rm_epsilon"))
        for n, m, a, e in treatments
    ])
    return seeds.withColumn("_t", F.explode(rows)).select(*seeds.columns, "_t.*")
