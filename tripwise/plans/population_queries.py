"""Personas, traits and behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators import population as N
from tripwise.plans.registry import query, rounded
from tripwise.plans.scalars_queries import sql_u


def personas(t):
    return t.personas.withColumnRenamed("Group_", "Group").where(F.col("PersonaID") != "")


def q(s: str) -> str:
    return f"'{s}'"


INC = ("CASE trim(Income) WHEN '<35k' THEN {0} WHEN '35-75k' THEN {1} WHEN '75k-125k' THEN {2} WHEN '125k+' THEN {3} ELSE {4} END")
AGE = "CASE trim(Age) WHEN 'teen' THEN {0} WHEN 'young adult' THEN {1} WHEN 'mid adult' THEN {2} WHEN 'old adult' THEN {3} WHEN 'senior' THEN {4} ELSE {5} END"


@query("persona_to_agent", f"""WITH a AS (SELECT *, {INC.format(20000, 35000, 75000, 125000, 35000)} AS i0, {INC.format(34000, 74000, 124000, 180000, 74000)} AS i1,
  {AGE.format(18, 20, 35, 55, 70, 30)} AS a0, {AGE.format(19, 34, 54, 69, 85, 55)} AS a1,
  greatest(0.01e0, 2e0 / 5.7e0 + CASE WHEN PrimaryInterest IN ('food', 'cultural') THEN 0.15e0 ELSE 0e0 END) AS md,
  greatest(0.01e0, 1.5e0 / 5.7e0 + CASE WHEN PrimaryInterest IN ('nightlife', 'nature') THEN 0.18e0 ELSE 0e0 END) AS mi,
  greatest(0.01e0, 1.2e0 / 5.7e0 + CASE WHEN Group_ = 'solo' THEN 0.1e0 ELSE 0e0 END) AS me,
  greatest(0.01e0, 1e0 / 5.7e0 + CASE WHEN lower(TopRated) = 'yes' THEN 0.14e0 ELSE 0e0 END) AS mp FROM f_personas WHERE PersonaID <> '')
 SELECT PersonaID AS persona_id, CAST(i0 + floor({sql_u('PersonaID', q('income'), q('42'))} * (i1 - i0 + 1)) AS BIGINT) AS income,
  CAST(a0 + floor({sql_u('PersonaID', q('age'), q('42'))} * (a1 - a0 + 1)) AS BIGINT) AS age, CarAccess AS car_access, CarAccess = 'own car' AS car_ownership,
  CASE CarAccess WHEN 'own car' THEN 0e0 WHEN 'carshare' THEN 0.9e0 ELSE 2.2e0 END AS car_penalty,
  CASE TransitAccess WHEN 'high' THEN 0.85e0 WHEN 'medium' THEN 0.55e0 WHEN 'low' THEN 0.25e0 ELSE 0.55e0 END AS transit_level,
  greatest(5, least(45, CAST(WalkTolerance AS INT))) AS walk_tolerance, MobilityNeeds AS mobility_needs, PrimaryInterest AS primary_interest, TimeWindow AS time_window,
  CASE RiskSalience WHEN 'high' THEN 1.1e0 ELSE 0.95e0 END AS feedback_sensitivity, CASE EnvConscious WHEN 'high' THEN 0.75e0 ELSE 0.25e0 END AS pref_green,
  CASE Budget WHEN 'low' THEN 1.2e0 WHEN 'high' THEN 0.85e0 ELSE 1e0 END AS pref_cost, CASE TimeWindow WHEN 'weekday evening' THEN 1.1e0 ELSE 0.95e0 END AS pref_time,
  CASE WHEN Group_ = 'family' THEN 0.5e0 ELSE 0.65e0 END AS travel_affinity, CASE PrimaryInterest WHEN 'nightlife' THEN 0.7e0 ELSE 0.4e0 END AS status_seeking,
  CASE WHEN lower(TopRated) = 'yes' THEN 0.7e0 ELSE 0.45e0 END AS practice_conformity,
  round(md / (md + mi + me + mp), 9) AS derived, round(mi / (md + mi + me + mp), 9) AS intrinsic, round(me / (md + mi + me + mp), 9) AS escape, round(mp / (md + mi + me + mp), 9) AS positionality FROM a""")
def persona_to_agent(t):
    return rounded(N.persona_to_agent(personas(t), car_only=False, derived_only=False), 9)


MEASURED = {
    "openness": "try_cast(openness AS DOUBLE)", "extraversion": "try_cast(trim(bigfive_extraversion) AS DOUBLE)", "trust_platforms": "try_cast(lv_trust_platforms AS DOUBLE)",
    "spontaneity_share": "try_cast(q14_spontaneity AS DOUBLE)", "review_posting": "CASE q6_4a_review WHEN 'Yes' THEN 1e0 WHEN 'no' THEN 0e0 END",
    "advice_goal_directed": "CASE q22_advice_preference WHEN 'It depends' THEN 0.5e0 WHEN 'Option A' THEN 1e0 END",
    "budget_tightness": "CASE Budget WHEN 'low' THEN 0.85e0 WHEN 'medium' THEN 0.5e0 WHEN 'high' THEN 0.2e0 ELSE 0.5e0 END",
    "follow_through_ai": "CASE WillingnessAI WHEN 'high' THEN 0.8e0 WHEN 'med' THEN 0.55e0 ELSE 0.25e0 END",
    "follow_through_platform": "CASE WillingnessAI WHEN 'high' THEN 0.8e0 WHEN 'med' THEN 0.55e0 ELSE 0.25e0 END",
    "popularity_herding": "CASE WHEN lower(TopRated) = 'yes' THEN 0.75e0 ELSE 0.4e0 END", "city_familiarity": "0.65e0",
}
PROFILE = "SELECT PersonaID, " + ", ".join(f"{MEASURED.get(x, 'CAST(NULL AS DOUBLE)')} AS {x}" for x in P.TRAITS) + " FROM f_personas WHERE PersonaID <> ''"


@query("survey_profile", PROFILE)
def survey_profile(t):
    return N.survey_profile(personas(t))


def sql_score(c: str) -> str:
    lo, hi = P.ITEM_SCALES.get(c, (1.0, 7.0))
    return f"round(coalesce(CASE WHEN {c} BETWEEN 0 AND 1 THEN {c} ELSE greatest(0e0, least(1e0, ({c} - {lo}e0) / {hi - lo}e0)) END, 0.5e0), 9)"


SCORE = "WITH p AS (" + PROFILE + ") SELECT PersonaID, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 0.5e0 ELSE {sql_score(c)} END AS {c}" for c in P.TRAITS) + " FROM p"


@query("apply_survey_profile", SCORE)
def apply_survey_profile(t):
    return rounded(N.apply_survey_profile(N.survey_profile(personas(t))), 9)


def sql_term(n: str) -> str:
    if n == "@incentives":
        return "(incentive_coupon + incentive_sponsored + incentive_loyalty) / 3"
    return f"(1 - {n[1:]})" if n[0] == "~" else n


def sql_sum(weights: dict) -> str:
    return " + ".join(f"{w}e0 * {sql_term(n)}" for n, w in weights.items())


COEF = "b AS (SELECT *, " + ", ".join(f"greatest(0e0, least(1e0, {sql_sum(w)})) AS {c}" for c, w in P.COEFFICIENTS.items()) + " FROM f_agents)"
ROUNDED_COEF = ", ".join(f"round({c}, 9) AS {c}" for c in P.COEFFICIENTS)


@query("behavior_coefficients", f"WITH {COEF} SELECT agent_id, {ROUNDED_COEF} FROM b")
def behavior_coefficients(t):
    return rounded(N.behavior_coefficients(t.agents).select("agent_id", *P.COEFFICIENTS), 9)


def sql_overlay(target: str) -> str:
    drivers, lo, hi = P.OVERLAY[target]
    value = target + " ".join(f" + {w}e0 * ({d} - 0.5e0)" for d, w in drivers)
    return f"greatest({lo}e0, {value})" if hi is None else f"greatest({lo}e0, least({hi}e0, {value}))"


MOT = ", ".join(f"greatest(0.01e0, {m} + {w}e0 * ({d} - 0.5e0)) AS m_{m}" for m, (d, w) in P.MOTIVE_OVERLAY.items())
ALLM = "(" + " + ".join(f"m_{m}" for m in P.MOTIVES) + ")"


@query("behavior_overlay", f"WITH {COEF}, v AS (SELECT agent_id, " + ", ".join(f"round({sql_overlay(x)}, 9) AS {x}" for x in P.OVERLAY)
       + f", {MOT} FROM b) SELECT agent_id, " + ", ".join(P.OVERLAY) + ", " + ", ".join(f"round(m_{m} / {ALLM}, 9) AS {m}" for m in P.MOTIVES) + " FROM v")
def behavior_overlay(t):
    done = N.behavior_overlay(N.behavior_coefficients(t.agents), derived_only=False)
    return rounded(done.select("agent_id", *P.OVERLAY, *P.MOTIVES), 9)


WEIGHTS = ", ".join(f"1 + {sql_sum(w)} AS w_{p}" for p, w in P.PARADIGM_WEIGHTS.items())


@query("paradigm_scores", f"""WITH {COEF}, w AS (SELECT agent_id, {WEIGHTS}, {sql_u('CAST(agent_id AS VARCHAR)', q('paradigm'))} AS u FROM b)
 SELECT agent_id, {', '.join(f'round(w_{p}, 9) AS w_{p}' for p in P.PARADIGMS)}, CASE WHEN w_utility > u * s THEN 'utility' WHEN w_utility + w_regret > u * s THEN 'regret'
  WHEN w_utility + w_regret + w_prospect > u * s THEN 'prospect' WHEN w_utility + w_regret + w_prospect + w_satisficing > u * s THEN 'satisficing' ELSE 'habit' END AS drawn_paradigm
 FROM (SELECT *, {' + '.join(f'w_{p}' for p in P.PARADIGMS)} AS s FROM w)""")
def paradigm_scores(t):
    done = N.paradigm_scores(N.behavior_coefficients(t.agents))
    return rounded(done.select("agent_id", *[f"w_{p}" for p in P.PARADIGMS], "drawn_paradigm"), 9)


def sql_bias(mode: str) -> str:
    value = " + ".join(f"{w}e0 * ({d} - 0.5e0)" for d, w in P.MODE_BIAS[mode].items())
    return f"round(greatest(-0.4e0, least(0.4e0, {value})), 9) AS bias_{mode}"


@query("mode_bias", f"WITH {COEF} SELECT agent_id, {', '.join(sql_bias(m) for m in P.MODES)} FROM b")
def mode_bias(t):
    return rounded(N.mode_bias(N.behavior_coefficients(t.agents)).select("agent_id", *[f"bias_{m}" for m in P.MODES]), 9)


def liked(t):
    prefs = {f"pref_{s}": F.lit(0.7) + ((F.col("c_custkey") * (i + 3)) % 7) * 0.1 for i, s in enumerate(P.SUBTYPES)}
    return t.customer.select("c_custkey", *[v.alias(k) for k, v in prefs.items()])


KEYWORD_ROWS = ", ".join(f"({i}, '{s}', [{', '.join(q(w) for w in P.SUBTYPE_KEYWORDS[s])}])" for i, s in enumerate(P.SUBTYPES))


@query("interest_keywords", f"""WITH r AS (SELECT c_custkey, i, ws, row_number() OVER (PARTITION BY c_custkey ORDER BY (c_custkey * (i + 3)) % 7 DESC, i) AS rn FROM customer, (VALUES {KEYWORD_ROWS}) k(i, s, ws)),
 w AS (SELECT c_custkey, rn, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM r WHERE rn <= 3),
 f AS (SELECT c_custkey, word, min(rn * 10 + j) AS o FROM w GROUP BY ALL) SELECT c_custkey, string_agg(word, '/' ORDER BY o) AS words FROM f GROUP BY c_custkey""")
def interest_keywords(t):
    return N.interest_keywords(liked(t), "kw").select("c_custkey", F.array_join("kw", "/").alias("words"))


NODE_ORDER = "n AS (SELECT lat, lon, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(node_id AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT), CAST(node_id AS VARCHAR)) - 1 AS i FROM {src})"


@query("relocate_personas", f"""WITH {NODE_ORDER.format(seed='homes2025', src='f_nodes')}
 SELECT PersonaID, Income, printf('%.6f', n.lat) AS start_latitude, printf('%.6f', n.lon) AS start_longitude FROM f_personas
 JOIN n ON n.i = CAST(floor({sql_u('PersonaID', q('home2025'))} * (SELECT count(*) FROM n)) AS BIGINT) WHERE PersonaID <> ''""")
def relocate_personas(t):
    return N.relocate_personas(personas(t), t.nodes).select("PersonaID", "Income", "start_latitude", "start_longitude")


def new_people(t):
    return t.supplier.select(F.col("s_suppkey").alias("idx"))


#: Columns of a persona that are drawn, with their names in the views.
DRAWN = {c: "Group_" if c == "Group" else c for c in (
    "Income", "Age", "CarAccess", "TransitAccess", "MobilityNeeds", "EnvConscious", "RiskSalience", "WalkTolerance", "Budget", "PrimaryInterest", "TimeWindow",
    "Group", "TopRated", "WillingnessAI", "openness", "bigfive_extraversion", "lv_trust_platforms", "q22_advice_preference", "q6_4a_review", "q14_spontaneity")}


def keyed_order(key: str, salt: str) -> str:
    """0-based row numbers in a keyed random order, as SQL."""
    return f"row_number() OVER (ORDER BY CAST('0x' || substr(md5({key} || ':{salt}'), 1, 8) AS BIGINT), {key}) - 1"


BOOTSTRAP = f"""ba AS (SELECT *, {keyed_order('PersonaID', 'base42')} AS i FROM f_personas WHERE PersonaID <> ''),
 nw AS (SELECT printf('SYN%04d', s_suppkey) AS id FROM supplier),
 us AS (SELECT DISTINCT round(TRY_CAST(start_latitude AS DOUBLE), 6) AS la, round(TRY_CAST(start_longitude AS DOUBLE), 6) AS lo FROM f_personas WHERE PersonaID <> ''),
 fr AS (SELECT round(lat, 6) AS la, round(lon, 6) AS lo, CAST(min(node_id) AS VARCHAR) AS nid, min(lat) AS lat, min(lon) AS lon FROM f_nodes WHERE is_base GROUP BY ALL),
 fo AS (SELECT *, {keyed_order('nid', 'free42')} AS i FROM fr WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.la = fr.la AND us.lo = fr.lo)),
 po AS (SELECT id, {keyed_order('id', 'order42')} AS k FROM nw)"""


@query("bootstrap_marginals", f"""WITH {BOOTSTRAP} SELECT po.id AS PersonaID, {', '.join(f'b{j}.{col} AS "{name}"' for j, (name, col) in enumerate(DRAWN.items()))},
 printf('%.6f', fo.lat) AS start_latitude, printf('%.6f', fo.lon) AS start_longitude FROM po JOIN fo ON fo.i = po.k % (SELECT count(*) FROM fo)
 {' '.join(f"JOIN ba b{j} ON b{j}.i = CAST(floor({sql_u(q('PersonaID'), 'po.id', q(name), q('42'))} * (SELECT count(*) FROM ba)) AS BIGINT)" for j, name in enumerate(DRAWN))}""")
def bootstrap_marginals(t):
    """New personas, every column drawn on its own."""
    return N.bootstrap_marginals(personas(t).drop("agent_id"), t.nodes, new_people(t))
