"""Welfare gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators import gate as G
from tripwise.operators import metrics as M
from tripwise.operators import ranking as R
from tripwise.plans.ranking_queries import BASE, OT, POP, SEG, place_affinity, keyword_affinity, places, requests
from tripwise.plans.registry import query, rounded
from tripwise.plans.scalars_queries import sql_cdf


def answers(t):
    """Popularity lists of three places per user."""
    return R.rank_popularity(requests(t), places(t), 3, place_affinity(t), keyword_affinity(t))


def state(t):
    """Observed travel costs of some users."""
    return t.feedback.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.lit(10.0) + F.avg("money") / 5.0).alias("vot"))


STATE = "st AS (SELECT user_id, count(*) AS n, 10 + avg(money) / 5 AS vot FROM f_feedback GROUP BY user_id)"
GATED = f"""{BASE}, {POP}, {OT}, {STATE}, a0 AS (SELECT o.rid, o.subtype, o.place_id, o.rank, base + 0.7e0 * greatest(0e0, o.score) AS v_hat,
  coalesce(st.vot, 15e0) * o.distance_km / 20 + o.distance_km * 0.15e0 AS c_hat, CASE WHEN coalesce(st.n, 0) > 0 THEN greatest(0.15e0, 1 / sqrt(st.n)) ELSE 1e0 END AS sigma
  FROM orr o JOIN {SEG} USING (subtype) LEFT JOIN st ON st.user_id = o.rid WHERE o.rank <= 3),
 a1 AS (SELECT *, (v_hat - c_hat) / sigma AS z FROM a0),
 a2 AS (SELECT *, {sql_cdf('z')} AS pup, sigma * exp(-0.5e0 * z * z) / sqrt(2 * pi()) - (v_hat - c_hat) * {sql_cdf('(-z)')} AS er FROM a1)"""


@query("score_to_utility", f"SELECT trip_key, round(base + 0.7e0 * greatest(0e0, utility), 9) AS v_hat, round(greatest(0e0, utility), 9) AS plain FROM f_trips JOIN {SEG} USING (subtype)")
def score_to_utility(t):
    leisure = t.trips.where(F.col("purpose") == "leisure")
    return rounded(leisure.select("trip_key", G.score_to_utility(F.col("utility"), F.col("subtype")).alias("v_hat"),
                                  G.score_to_utility(F.col("utility"), F.col("subtype"), "identity").alias("plain")), 9)


@query("travel_cost_estimate", f"WITH {STATE} SELECT trip_key, round(coalesce(st.vot, 15e0) * distance_km / 20 + 0.15e0 * distance_km, 12) AS c_hat FROM f_trips LEFT JOIN st ON st.user_id = agent_id")
def travel_cost_estimate(t):
    rows = t.trips.join(state(t).withColumnRenamed("user_id", "agent_id"), "agent_id", "left")
    return rounded(rows.select("trip_key", G.travel_cost_estimate(F.col("distance_km"), F.col("vot")).alias("c_hat")), 12)


@query("user_uncertainty", f"WITH {STATE} SELECT c_custkey AS user_id, round(CASE WHEN n > 0 THEN greatest(0.15e0, 1 / sqrt(n)) ELSE 1e0 END, 9) AS sigma FROM customer LEFT JOIN st ON st.user_id = c_custkey")
def user_uncertainty(t):
    rows = t.customer.select(F.col("c_custkey").alias("user_id")).join(state(t), "user_id", "left")
    return rounded(rows.select("user_id", G.user_uncertainty(F.coalesce("n", F.lit(0))).alias("sigma")), 9)


def sigma_rows(t):
    c = F.col
    return t.trips.select("trip_key", c("activity_utility").alias("v"), (c("gen_cost") / 8).alias("c"), ((c("trip_key") % 8) * 0.15).alias("sigma"))


SIG = "x AS (SELECT trip_key, activity_utility AS v, gen_cost / 8 AS c, (trip_key % 8) * 0.15e0 AS sigma FROM f_trips), z AS (SELECT *, CASE WHEN sigma > 0 THEN (v - c) / sigma ELSE 0e0 END AS z FROM x)"


@query("pup", f"WITH {SIG} SELECT trip_key, round(CASE WHEN sigma <= 0 THEN CASE WHEN v >= c THEN 1e0 ELSE 0e0 END ELSE {sql_cdf('z')} END, 9) AS pup FROM z")
def pup(t):
    return rounded(sigma_rows(t).select("trip_key", G.pup(F.col("v"), F.col("c"), F.col("sigma")).alias("pup")), 9)


@query("expected_regret", f"""WITH {SIG} SELECT trip_key, round(CASE WHEN sigma <= 1e-8 THEN greatest(0e0, c - v) ELSE sigma * exp(-0.5e0 * z * z) / sqrt(2 * pi()) - (v - c) * {sql_cdf('(-z)')} END, 9) AS regret FROM z""")
def expected_regret(t):
    return rounded(sigma_rows(t).select("trip_key", G.expected_regret(F.col("v"), F.col("c"), F.col("sigma")).alias("regret")), 9)


#: The conditions of the study that gate answers, and both gates at once.
CONDITIONS = [x for x in P.TREATMENTS if x[1] in G.MODES] + [("pup_rm", "pup_rm", 0.3, 0.2721)]
GRID = "(VALUES ('standard', 'standard', 0.6e0, 0.3e0), ('pup_03', 'pup', 0.3e0, 0.3e0), ('pup_07', 'pup', 0.7e0, 0.3e0), ('rm', 'rm', 0.6e0, 0.2721e0), ('pup_rm', 'pup_rm', 0.3e0, 0.2721e0)) g(treatment, mode, a, e)"
PASS = "(mode = 'standard' OR (mode = 'pup' AND pup >= a) OR (mode = 'rm' AND er <= e) OR (mode = 'pup_rm' AND pup >= a AND er <= e))"


@query("welfare_gate", f"""WITH {GATED} SELECT rid, treatment, place_id, rank, round(v_hat, 6) AS v_hat, round(c_hat, 6) AS c_hat, round(pup, 6) AS pup, round(er, 6) AS expected_regret FROM a2, {GRID} WHERE {PASS}""")
def welfare_gate(t):
    """All conditions in one pass, the thresholds being columns."""
    kept = gated(t)
    return rounded(kept.select("rid", "treatment", "place_id", "rank", "v_hat", "c_hat", "pup", "expected_regret"))


def gated(t):
    grid = M.treatment_grid(answers(t), CONDITIONS)
    return G.welfare_gate(grid, state(t), F.col("mode"), alpha=F.col("pup_alpha"), epsilon=F.col("rm_epsilon"))


@query("abstention", f"WITH {GATED} SELECT u.user_id AS rid, treatment FROM f_users u, {GRID} WHERE NOT EXISTS (SELECT 1 FROM a2 WHERE a2.rid = u.user_id AND {PASS})")
def abstention(t):
    cells = M.treatment_grid(requests(t).select("rid"), CONDITIONS).select("rid", "treatment")
    return G.abstentions(cells, gated(t), ["rid", "treatment"])


PCTS = ", ".join(f"({p}, {i})" for i, p in enumerate(P.PERCENTILES, 1))
SWEEP = f"""{GATED}, u AS (SELECT utility FROM f_trips WHERE treatment = 'standard' AND purpose = 'leisure'),
 x AS (SELECT greatest(0e0, (SELECT avg(utility) FROM u) - utility) AS g FROM u),
 ep AS (SELECT p.pct, quantile_cont(g, [{", ".join(str(p / 100) for p in P.PERCENTILES)}])[p.i] AS e FROM x, (VALUES {PCTS}) p(pct, i) GROUP BY p.pct, p.i),
 grid AS (SELECT 'pup' AS gate, a AS threshold, a AS lim FROM (VALUES {", ".join(f"({a}e0)" for a in P.ALPHAS)}) v(a) UNION ALL SELECT 'rm', CAST(pct AS DOUBLE), e FROM ep),
 k AS (SELECT gate, threshold, rid, arg_min(v_hat - c_hat, rank) AS net FROM a2, grid WHERE (gate = 'pup' AND pup >= lim) OR (gate = 'rm' AND er <= lim) GROUP BY ALL),
 rq AS (SELECT user_id % 5 AS seed, count(*) AS n FROM f_users GROUP BY ALL),
 s AS (SELECT g.gate, g.threshold, rq.seed, coalesce(avg(net), 0e0) AS mu, 1 - count(net) / rq.n AS ab FROM grid g CROSS JOIN rq
  LEFT JOIN k ON k.gate = g.gate AND k.threshold = g.threshold AND k.rid % 5 = rq.seed GROUP BY g.gate, g.threshold, rq.seed, rq.n),
 c AS (SELECT gate, threshold, avg(mu) AS mu, stddev_pop(mu) AS ms, avg(ab) AS ab, stddev_pop(ab) AS sb FROM s GROUP BY ALL)"""


@query("threshold_frontier", f"""WITH {SWEEP} SELECT c.gate, round(threshold, 6) AS threshold, round(mu, 6) AS mu, round(ms, 6) AS mu_std, round(ab, 6) AS abst, round(sb, 6) AS abst_std,
 threshold = b.best AS is_best FROM c JOIN (SELECT gate, arg_max(threshold, round(mu, 6) - threshold * 1e-9) AS best FROM c GROUP BY gate) b USING (gate)""")
def threshold_frontier(t):
    """Both gates over the ranked answers: probability thresholds, and regret ceilings at
    calibrated percentiles.  Users stand for five seeds."""
    ceilings = M.regret_proxy(t.trips)
    asked = requests(t).select("rid", (F.col("rid") % 5).alias("seed"))
    annotated = G.annotate(answers(t), state(t)).join(asked, "rid")
    return rounded(M.threshold_frontier(G.gate_sweep(annotated, asked, P.ALPHAS, ceilings)))
