"""Welfare measures and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators import metrics as M
from tripwise.plans.registry import query, rounded

LAST = """l AS (SELECT t.*, activity_utility - gen_cost / 8e0 AS u FROM f_trips t
  JOIN (SELECT treatment, seed, max(day) AS day FROM f_trips GROUP BY ALL) d USING (treatment, seed, day) WHERE purpose = 'leisure')"""
AGENT = f"""{LAST}, a AS (SELECT treatment, seed, agent_id, avg(u) AS mean_u FROM l GROUP BY ALL)"""


def sql_gini(source: str, keys: str, value: str, name: str) -> str:
    return f"""{name} AS (SELECT {keys}, CASE WHEN count(*) < 2 OR sum(x) = 0 THEN 0e0
   ELSE (2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)) END AS g FROM (
   SELECT {keys}, {value} - least(0e0, min({value}) OVER (PARTITION BY {keys})) AS x,
     row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS i FROM {source}) GROUP BY {keys})"""


T1 = f"""{LAST}, {sql_gini('l', 'treatment, seed', 'u', 'gg')},
o AS (SELECT treatment, seed, count(*) AS n_opportunities, avg(CASE WHEN abstained THEN 1e0 ELSE 0e0 END) AS abstention_rate FROM f_opportunities GROUP BY ALL),
b AS (SELECT treatment, seed, avg(u) AS mean_utility, avg(CASE WHEN u < 0 THEN 1e0 ELSE 0e0 END) AS neg_rate, count(*) AS n_leisure_trips FROM l GROUP BY ALL),
t1 AS (SELECT treatment, seed, coalesce(mean_utility, 0e0) AS mean_utility, coalesce(neg_rate, 0e0) AS neg_rate,
  coalesce(n_leisure_trips, 0) AS n_leisure_trips, coalesce(g, 0e0) AS gini, coalesce(n_opportunities, 0) AS n_opportunities,
  coalesce(abstention_rate, 0e0) AS abstention_rate
 FROM (SELECT DISTINCT treatment, seed FROM f_trips) r LEFT JOIN b USING (treatment, seed) LEFT JOIN gg USING (treatment, seed) LEFT JOIN o USING (treatment, seed))"""
T2 = f"""{AGENT}, p AS (SELECT t.treatment, t.seed, t.mean_u - b.mean_u AS d FROM a t JOIN a b ON t.seed = b.seed AND t.agent_id = b.agent_id
  AND b.treatment = 'no_rs' AND t.treatment <> 'no_rs'),
q AS (SELECT treatment, seed, avg(CASE WHEN d < 0 THEN 1e0 ELSE 0e0 END) AS harmed_pct, avg(CASE WHEN d > 0 THEN 1e0 ELSE 0e0 END) AS improved_pct,
  coalesce(avg(CASE WHEN d < 0 THEN -d END), 0e0) AS mean_orc, count(*) AS n_matched FROM p GROUP BY ALL),
t2 AS (SELECT treatment, seed, coalesce(harmed_pct, 0e0) AS harmed_pct, coalesce(improved_pct, 0e0) AS improved_pct, coalesce(mean_orc, 0e0) AS mean_orc,
  coalesce(n_matched, 0) AS n_matched FROM (SELECT DISTINCT treatment, seed FROM f_trips WHERE treatment <> 'no_rs') r LEFT JOIN q USING (treatment, seed))"""
T1S = """SELECT treatment, round(avg(mean_utility), 6) AS mean_utility, round(stddev_pop(mean_utility), 6) AS sigma_u, round(avg(neg_rate), 6) AS neg_rate,
 round(avg(abstention_rate), 6) AS abstention_rate, round(avg(gini), 6) AS gini, CAST(sum(n_leisure_trips) AS BIGINT) AS n_leisure_trips FROM t1 GROUP BY treatment"""
TOTALS = "w AS (SELECT treatment, seed, agent_id, sum(utility) AS total_u FROM f_trips GROUP BY ALL)"
PAIRS = f"""{TOTALS}, p AS (SELECT t.treatment, t.seed, t.agent_id, t.total_u AS u_t, b.total_u AS u_b, t.total_u - b.total_u AS gain
 FROM w t JOIN w b ON t.seed = b.seed AND t.agent_id = b.agent_id AND b.treatment = 'no_rs' AND t.treatment <> 'no_rs')"""


@query("net_utility", "SELECT trip_key, round(activity_utility - gen_cost / 8e0, 6) AS u FROM f_trips WHERE purpose = 'leisure'")
def net_utility(t):
    leisure = t.trips.where(F.col("purpose") == "leisure")
    return rounded(leisure.select("trip_key", M.net_utility(F.col("activity_utility"), F.col("gen_cost")).alias("u")))


@query("agent_mean_utility", f"WITH {AGENT} SELECT treatment, seed, agent_id, round(mean_u, 6) AS mean_u FROM a")
def agent_mean_utility(t):
    return rounded(M.agent_mean_utility(t.trips))


@query("gini", f"WITH {LAST}, {sql_gini('l', 'treatment, seed', 'u', 'gg')} SELECT treatment, seed, round(g, 6) AS gini FROM gg")
def gini(t):
    return rounded(M.gini(M.last_day_leisure(t.trips), M.RUN, "u"))


@query("table1", f"""WITH {T1} SELECT treatment, seed, round(mean_utility, 6) AS mean_utility, round(neg_rate, 6) AS neg_rate, n_leisure_trips,
 round(gini, 6) AS gini, n_opportunities, round(abstention_rate, 6) AS abstention_rate FROM t1""")
def table1(t):
    return rounded(M.table1(t.trips, t.opportunities))


@query("table2", f"""WITH {T2} SELECT treatment, seed, round(harmed_pct, 6) AS harmed_pct, round(improved_pct, 6) AS improved_pct,
 round(mean_orc, 6) AS mean_orc, n_matched FROM t2""")
def table2(t):
    return rounded(M.table2(t.trips))


@query("table1_over_seeds", f"WITH {T1} {T1S}")
def table1_over_seeds(t):
    return rounded(M.table1_over_seeds(M.table1(t.trips, t.opportunities)))


@query("table2_over_seeds", f"""WITH {T2} SELECT treatment, round(avg(harmed_pct), 6) AS harmed_pct, round(avg(improved_pct), 6) AS improved_pct,
 round(avg(mean_orc), 6) AS mean_orc, CAST(sum(n_matched) AS BIGINT) AS n_matched FROM t2 GROUP BY treatment""")
def table2_over_seeds(t):
    return rounded(M.table2_over_seeds(M.table2(t.trips)))


def run_summaries(t):
    leisure = F.col("purpose") == "leisure"
    return t.trips.groupBy(*M.RUN).agg(
        (F.sum(F.when(leisure & F.col("accepted"), 1.0).otherwise(0.0)) / F.sum(F.when(leisure, 1.0).otherwise(0.0))).alias("acceptance_rate"),
        F.avg(F.col("travel_min").cast("double")).alias("avg_travel_time_min"),
    )


@query("headline", f"""WITH {T1}, {T2.replace(LAST + ',', '')}, s AS (SELECT treatment, avg(ar) AS ar, avg(tt) AS tt FROM (SELECT treatment, seed,
  sum(CASE WHEN purpose = 'leisure' AND accepted THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN purpose = 'leisure' THEN 1e0 ELSE 0e0 END) AS ar, avg(travel_min) AS tt
  FROM f_trips GROUP BY ALL) GROUP BY treatment),
x AS (SELECT treatment, avg(mean_utility) AS mu, stddev_pop(mean_utility) AS sd, avg(neg_rate) AS nr FROM t1 GROUP BY treatment),
y AS (SELECT treatment, avg(harmed_pct) AS h, avg(improved_pct) AS i, avg(mean_orc) AS o FROM t2 GROUP BY treatment)
SELECT treatment, round(mu, 6) AS mean_utility, round(sd, 6) AS sigma_u, round(nr, 6) AS neg_rate, round(h, 6) AS harmed_pct, round(i, 6) AS improved_pct,
 round(o, 6) AS mean_orc, round(ar, 6) AS acceptance_rate, round(tt, 6) AS avg_travel_time_min FROM x LEFT JOIN y USING (treatment) LEFT JOIN s USING (treatment)""")
def headline(t):
    t1 = M.table1_over_seeds(M.table1(t.trips, t.opportunities))
    t2 = M.table2_over_seeds(M.table2(t.trips))
    return rounded(M.headline(t1, t2, run_summaries(t)))


@query("orc_all_agents", f"""WITH {PAIRS} SELECT treatment, round(avg(greatest(0e0, u_b - u_t)), 6) AS orc, count(*) AS n_matched FROM p GROUP BY treatment""")
def orc_all_agents(t):
    return rounded(M.orc_all_agents(M.agent_totals(t.trips)))


COMPARE = f"""{PAIRS}, {sql_gini('p', 'treatment', 'u_t', 'g1')}, {sql_gini('p', 'treatment', 'u_b', 'g2')},
c AS (SELECT treatment, avg(gain) AS a, median(gain) AS m, avg(CASE WHEN gain > 0 THEN 1e0 ELSE 0e0 END) AS i, avg(CASE WHEN gain < 0 THEN 1e0 ELSE 0e0 END) AS h,
  avg(greatest(0e0, -gain)) AS o FROM p GROUP BY treatment)
SELECT treatment, round(a, 6) AS mean_gain, round(m, 6) AS median_gain, round(i, 6) AS pct_improved, round(h, 6) AS pct_harmed, round(o, 6) AS orc,
 round(g1.g, 6) AS gini_treatment, round(g2.g, 6) AS gini_baseline FROM c JOIN g1 USING (treatment) JOIN g2 USING (treatment)"""


@query("welfare_gain", f"WITH {COMPARE} WHERE treatment = 'standard'")
def welfare_gain(t):
    return rounded(M.welfare_gain(M.agent_totals(t.trips), "standard"))


@query("compare_all", f"WITH {COMPARE}")
def compare_all(t):
    return rounded(M.compare_all(M.agent_totals(t.trips)))


RUNS = f"""z AS (SELECT * FROM f_trips WHERE purpose = 'leisure'), {sql_gini('z', 'treatment, seed', 'utility', 'gz')},
rm AS (SELECT treatment, seed, avg(utility) AS mean_utility, avg(CASE WHEN utility < 0 THEN 1e0 ELSE 0e0 END) AS neg_rate,
 1 - avg(CASE WHEN accepted THEN 1e0 ELSE 0e0 END) AS abstention_rate, count(*) AS n_trips, any_value(g) AS gini FROM z JOIN gz USING (treatment, seed) GROUP BY treatment, seed)"""


@query("run_metrics", f"""WITH {RUNS} SELECT treatment, seed, round(mean_utility, 6) AS mean_utility, round(neg_rate, 6) AS neg_rate,
 round(abstention_rate, 6) AS abstention_rate, n_trips, round(gini, 6) AS gini FROM rm""")
def run_metrics(t):
    return rounded(M.run_metrics(t.trips))


def members(t):
    return t.trips.select(*M.RUN, "agent_id", "paradigm").distinct()


ROLLUP = """r AS (SELECT treatment, seed, agent_id, paradigm, coalesce(avg(utility) FILTER (purpose = 'leisure'), 0e0) AS mean_utility,
 coalesce(sum(utility) FILTER (purpose = 'leisure'), 0e0) AS total_utility, count(*) FILTER (purpose = 'leisure') AS num_leisure_trips FROM f_trips GROUP BY ALL)"""


@query("agent_rollup", f"""WITH {ROLLUP} SELECT treatment, seed, agent_id, paradigm, round(mean_utility, 6) AS mean_utility,
 round(total_utility, 6) AS total_utility, num_leisure_trips FROM r""")
def agent_rollup(t):
    return rounded(M.agent_rollup(members(t), t.trips))


@query("calibrate_epsilon", """WITH l AS (SELECT activity_utility - gen_cost / 8e0 AS u FROM f_trips WHERE treatment = 'standard' AND purpose = 'leisure')
 SELECT round(quantile_cont(greatest(0e0, 0.3e0 - u), 0.75), 6) AS epsilon FROM l""")
def calibrate_epsilon(t):
    leisure = t.trips.where((F.col("treatment") == "standard") & (F.col("purpose") == "leisure"))
    regret = F.greatest(F.lit(0.0), F.lit(0.3) - M.net_utility(F.col("activity_utility"), F.col("gen_cost")))
    return rounded(M.calibrate_epsilon(leisure.select(regret.alias("regret")), "regret"))


@query("regret_proxy", """WITH u AS (SELECT utility FROM f_trips WHERE treatment = 'standard' AND purpose = 'leisure'),
 x AS (SELECT greatest(0e0, (SELECT avg(utility) FROM u) - utility) AS g FROM u)
 SELECT p.pct, round(quantile_cont(g, [0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9])[p.i], 6) AS epsilon FROM x,
  (VALUES (50, 1), (60, 2), (65, 3), (70, 4), (75, 5), (80, 6), (90, 7)) p(pct, i) GROUP BY p.pct, p.i""")
def regret_proxy(t):
    return rounded(M.regret_proxy(t.trips))


@query("condition_table", f"""WITH {RUNS} SELECT treatment, round(avg(mean_utility), 6) AS mean_u, round(stddev_pop(mean_utility), 6) AS sigma_u,
 round(avg(neg_rate), 6) AS neg_rate, round(avg(abstention_rate), 6) AS abstention, round(avg(gini), 6) AS gini FROM rm GROUP BY treatment""")
def condition_table(t):
    return rounded(M.condition_table(M.run_metrics(t.trips)))


@query("paradigm_heatmap", f"""WITH {ROLLUP}, c AS (SELECT paradigm, treatment, avg(mean_utility) AS m FROM r GROUP BY ALL)
 SELECT p.paradigm, t.treatment, round(coalesce(c.m, 0e0) - coalesce(b.m, 0e0), 6) AS delta FROM (SELECT DISTINCT paradigm FROM c) p, (SELECT DISTINCT treatment FROM c WHERE treatment <> 'no_rs') t
 LEFT JOIN c ON c.paradigm = p.paradigm AND c.treatment = t.treatment LEFT JOIN c b ON b.paradigm = p.paradigm AND b.treatment = 'no_rs'""")
def paradigm_heatmap(t):
    return rounded(M.paradigm_heatmap(M.agent_rollup(members(t), t.trips)))


@query("orc_table", f"""WITH {PAIRS}, s AS (SELECT treatment, seed, avg(CASE WHEN gain < -1e-9 THEN 1e0 ELSE 0e0 END) AS h, avg(CASE WHEN gain > 1e-9 THEN 1e0 ELSE 0e0 END) AS i,
  CASE WHEN count(*) FILTER (gain < -1e-9) > 0 THEN sum(greatest(0e0, -gain)) / count(*) FILTER (gain < -1e-9) ELSE 0e0 END AS o FROM p GROUP BY ALL)
 SELECT treatment, printf('%.1f%%', 100 * avg(h)) AS harmed, printf('%.1f%%', 100 * avg(i)) AS improved,
  printf('%.3f ± %.3f', avg(o), stddev_pop(o)) AS mean_orc FROM s GROUP BY treatment""")
def orc_table(t):
    return M.orc_table(M.agent_totals(t.trips))


@query("matched_seeds", """SELECT c_nationkey AS study, s.seed0 + u.i AS run_seed, s.n NOT BETWEEN 1 AND 12 AS out_of_range, count(*) AS n FROM (SELECT c_nationkey, c_custkey % 5 AS seed0, c_custkey % 15 AS n FROM customer) s,
 (SELECT range AS i FROM range(0, 20)) u WHERE u.i < greatest(1, s.n) GROUP BY ALL""")
def matched_seeds(t):
    studies = t.customer.select(
        F.col("c_nationkey").alias("study"), (F.col("c_custkey") % 5).alias("seed"), (F.col("c_custkey") % 15).alias("num_seeds"))
    return M.matched_seeds(studies).groupBy("study", "run_seed", "out_of_range").agg(F.count(F.lit(1)).alias("n"))


@query("unmatched_runs", """WITH r AS (SELECT DISTINCT treatment, agent_id AS seed FROM f_trips)
 SELECT treatment, seed FROM r WHERE treatment <> 'no_rs' AND seed NOT IN (SELECT seed FROM r WHERE treatment = 'no_rs')""")
def unmatched_runs(t):
    """Agents stand for seeds here, so that some lack a twin."""
    return M.unmatched_runs(t.trips.select("treatment", F.col("agent_id").alias("seed")))


@query("treatment_grid", """SELECT seed, treatment, mode, pup_alpha, rm_epsilon FROM (SELECT DISTINCT seed FROM f_trips), (VALUES
 ('no_rs', 'no_rs', 0.6e0, 0.3e0), ('standard', 'standard', 0.6e0, 0.3e0), ('pup_03', 'pup', 0.3e0, 0.3e0), ('pup_07', 'pup', 0.7e0, 0.3e0),
 ('rm', 'rm', 0.6e0, 0.2721e0), ('oracle', 'oracle', 0.6e0, 0.3e0)) v(treatment, mode, pup_alpha, rm_epsilon)""")
def treatment_grid(t):
    return M.treatment_grid(t.trips.select("seed").distinct())
