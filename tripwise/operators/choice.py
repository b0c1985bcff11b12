"""Discrete choices, scored for all agents at once.

The alternatives of a choice are an array in the row of the chooser, so scoring
and choosing need no shuffle.  Mode order is walk, bike, transit, car.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions import clamp, draw_index, draw_option, hash_int, hash_uniform, sigmoid, softmax_array
from tripwise.functions.text import lookup
from tripwise.operators.ticks import crowd_factor, road_factor

NO_WEATHER = {m: 1.0 for m in P.MODES}


def bpr_congestion(trips: DataFrame, road_capacity: float, transit_capacity: float) -> DataFrame:
    """Road and transit factors from the volumes a trip sees."""
    return trips.withColumns({
        "road_factor": road_factor(F.col("road_volume"), road_capacity),
        "crowd_factor": crowd_factor(F.col("transit_volume"), transit_capacity),
    })


def mode_available(mode: str, car_only: bool = False) -> Column:
    """Can this agent use the mode over this distance?"""
    a, c = P.AVAILABILITY, F.col
    if car_only:
        return F.lit(mode == "car")
    ada = c("mobility_needs") == "ADA/wheelchair"
    if mode == "car":
        return (
            F.when(c("car_access") == "own car", F.lit(True)).when(c("car_access") == "carshare", c("distance_km") >= a["carshare_min_km"])
            .otherwise(c("distance_km") >= a["no_car_min_km"])
        )
    if mode == "bike":
        return (c("age") <= a["bike_max_age"]) & ~ada & (c("distance_km") <= a["bike_max_km"])
    if mode == "walk":
        limit = F.greatest(F.lit(a["walk_floor_km"]), c("walk_tolerance") / a["walk_min_per_km"])
        limit = F.when(ada, F.least(limit, F.lit(a["walk_ada_km"]))).otherwise(limit)
        return (c("age") <= a["walk_max_age"]) & (c("distance_km") <= limit)
    return F.lit(True)


def mode_outcome(mode: str, pos: int, weather: str = "fair", policy: str = "none", social_norms: str = "standard") -> Column:
    """Time, money, generalised cost, emissions and utilities of one mode."""
    m, u, c = P.MODE_TABLE[mode], P.UTILITY, F.col
    km = c("distance_km")
    speed = m["speed"] * P.WEATHER_SPEED.get(weather, NO_WEATHER)[mode]
    ride = km / max(1e-3, speed) * 60.0
    ride = ride * c("road_factor") if mode == "car" else ride * c("crowd_factor") if mode == "transit" else ride
    minutes = ride + m["wait"]
    money = F.lit(m["fixed"]) + m["per_km"] * km
    if policy == "congestion_pricing" and mode == "car":
        money = money + P.CONGESTION["price_base"] + P.CONGESTION["price_km"] * km
    gen_cost = minutes / 60.0 * c("vot") * c("pref_time") + money * c("pref_cost")
    grams = m["g_km"] * km
    green = c("pref_green") * (u["green_boost"] if social_norms == "green" else 1.0)
    leisure = c("next_purpose") == "leisure"
    taste = lookup({s: t.get(mode, 0.0) for s, t in P.MODE_TASTE.items()}, c("next_subtype"), 0.0)
    zero = F.lit(0.0)
    travel = (
        -gen_cost / u["cost_denominator"] + m["comfort"] * c("pref_comfort") - green * grams / u["emissions_div"]
        - F.when(c("mandatory"), u["derived"] * c("derived") * minutes / u["derived_div"]).otherwise(zero)
        + c("intrinsic") * m["enjoyment"] * minutes / u["intrinsic_div"]
        + F.when(leisure, c("escape") * F.least(F.lit(u["escape_cap"]), km / u["escape_km"]) + taste).otherwise(zero)
        + c("positionality") * c("status_seeking") * (F.lit(m["status"]) - c("peer_status"))
        + m["community"] * c("practice_conformity") + c(f"bias_{mode}")
    )
    if mode == "car":
        travel = travel - c("car_penalty")
    base = lookup({s: v["utility"] for s, v in P.SEGMENTS.items()}, c("next_subtype"), 0.0)
    activity = F.when(
        leisure & (c("next_subtype") != ""), base + u["act_intrinsic"] * c("intrinsic") + u["act_escape"] * c("escape")).otherwise(zero)
    return F.struct(
        F.lit(mode).alias("mode"), F.lit(pos).alias("pos"), minutes.alias("minutes"), money.alias("money"), gen_cost.alias("gen_cost"),
        grams.alias("emissions_g"), travel.alias("travel_utility"), activity.alias("activity_utility"))


def evaluate_modes(trips: DataFrame, modes=P.MODES, car_only: bool = False, **context) -> DataFrame:
    """Adds ``options``: the outcomes of the available modes.  With none available,
    walking stands in, or the first mode when walking is not offered."""
    table = [
        F.struct(mode_available(m, car_only).alias("ok"), mode_outcome(m, i, **context).alias("o")) for i, m in enumerate(modes)
    ]
    rows = trips.withColumn("_all", F.array(*table))
    ok = F.transform(F.filter("_all", lambda x: x["ok"]), lambda x: x["o"])
    spare = modes.index("walk") if "walk" in modes else 0
    rows = rows.withColumn("options", F.when(F.size(ok) > 0, ok).otherwise(F.array(F.col("_all")[spare]["o"])))
    total = F.transform("options", lambda o: o.withField("utility", o["travel_utility"] + o["activity_utility"]))
    return rows.withColumn("options", total).drop("_all")


def choice_probabilities(options: Column) -> Column:
    return softmax_array(F.transform(options, lambda o: o["utility"]))


def choose_utility(options: Column, u: Column) -> Column:
    """Draw by the softmax of utilities."""
    return draw_option(options, choice_probabilities(options), u)["mode"]


def _first_best(options: Column, loss) -> Column:
    """Mode with the smallest loss, the earliest one on ties."""
    scored = F.transform(options, lambda o: F.struct(loss(o).alias("l"), o["pos"].alias("pos"), o["mode"].alias("mode")))
    return F.array_min(scored)["mode"]


def choose_regret(options: Column, corrected: bool = False) -> Column:
    """Least total regret.  As defined, a mode's regret grows with how much dearer the
    others are, which favours the dearest mode; ``corrected`` turns the sign."""
    def loss(o: Column) -> Column:
        def gap(p: Column) -> Column:
            d = o["gen_cost"] - p["gen_cost"] if corrected else p["gen_cost"] - o["gen_cost"]
            return F.greatest(F.lit(0.0), d)

        return F.aggregate(options, F.lit(0.0), lambda acc, p: acc + gap(p))

    return _first_best(options, loss)


def choose_prospect(options: Column) -> Column:
    """Utility plus gains minus weighted losses against the agent's reference time
    and cost."""
    c = F.col

    def loss(o: Column) -> Column:
        dt, dc = o["minutes"] - c("ref_time"), o["money"] - c("ref_cost")
        lost = F.greatest(F.lit(0.0), dt) / 60.0 * c("vot") + F.greatest(F.lit(0.0), dc)
        gained = F.greatest(F.lit(0.0), -dt) / 60.0 * c("vot") + F.greatest(F.lit(0.0), -dc)
        return -(o["utility"] + (gained - c("loss_aversion") * lost) / P.UTILITY["cost_denominator"])

    return _first_best(options, loss)


def choose_satisficing(options: Column, threshold: Column, u: Column) -> Column:
    """First mode that is cheap enough, else by utility."""
    good = F.filter(options, lambda o: o["gen_cost"] <= threshold)
    return F.coalesce(F.try_element_at(good, F.lit(1))["mode"], choose_utility(options, u))


def choose_habit(options: Column, habit: Column, u: Column) -> Column:
    """The habitual mode if it is available, else by utility."""
    known = F.exists(options, lambda o: o["mode"] == habit)
    return F.when(known, habit).otherwise(choose_utility(options, u))


def dispatch_paradigm(rows: DataFrame, salt: str = "mode", car_only: bool = True, corrected_regret: bool = False) -> DataFrame:
    """Chosen mode by the agent's paradigm; the car-only switch bypasses all."""
    if car_only:
        return rows.withColumn("chosen_mode", F.lit("car"))
    options, p = F.col("options"), F.col("paradigm")
    u = hash_uniform(F.col("trip_key").cast("string"), salt)
    return rows.withColumn("chosen_mode", (
        F.when(p == "regret", choose_regret(options, corrected_regret)).when(p == "prospect", choose_prospect(options))
        .when(p == "satisficing", choose_satisficing(options, F.col("satisficing_threshold"), u))
        .when(p == "habit", choose_habit(options, F.col("habit_mode"), u)).otherwise(choose_utility(options, u))
    ))


def arrival_minute(depart: Column, minutes: Column) -> Column:
    """Arrival: travel minutes are rounded up and at least one."""
    return depart + F.greatest(F.lit(1), F.ceil(minutes)).cast("long")


# ------------------------------------------------------------- leisure planning
def tpb_intention(purpose: str = "leisure", travel_norm: str = "neutral") -> Column:
    """Intention from attitude, norm and perceived control."""
    t, c = P.TPB, F.col
    attitude = c("travel_affinity") + (t["leisure"] * c("intrinsic") if purpose == "leisure" else F.lit(0.0))
    norm = {"pro_travel": t["pro"], "anti_travel": t["anti"]}.get(travel_norm, t["neutral"])
    control = (
        F.lit(t["base"]) + F.when(c("car_access") == "own car", t["own_car"]).when(c("car_access") == "carshare", t["carshare"]).otherwise(0.0)
        + t["transit"] * (c("transit_level") - 0.5) + F.when(c("age") > 75, t["age75"]).otherwise(0.0)
        + F.when(c("mobility_needs") == "ADA/wheelchair", t["ada"]).otherwise(0.0)
    )
    return sigmoid(t["attitude"] * attitude + t["norm"] * norm + t["pbc"] * clamp(control) + t["intercept"])


def explode_subtypes(agents: DataFrame, salt: str = "plan") -> DataFrame:
    """Agent rows by leisure subtype, with keyed draws of delay and duration."""
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(s).alias("subtype"), F.lit(i).alias("subtype_pos"), F.lit(v["utility"]).alias("base"),
            *[F.lit(v[k][j]).alias(f"{k}_{j}") for k in ("delay", "duration", "window") for j in (0, 1)])
        for i, (s, v) in enumerate(P.SEGMENTS.items())
    ]))
    out = agents.withColumn("_s", rows).select(*agents.columns, "_s.*")
    key = F.col("agent_id").cast("string")
    for k in ("delay", "duration"):
        out = out.withColumn(k, hash_int(F.col(f"{k}_0"), F.col(f"{k}_1"), key, F.col("subtype"), F.lit(f"{salt}-{k}")))
    return out.drop("delay_0", "delay_1", "duration_0", "duration_1")


def subtype_options(rows: DataFrame, salt: str = "plan", noise: float = P.PARTICIPATION["noise"]) -> DataFrame:
    """Feasible leisure options with start, activity utility and net utility.

    Rows: agent and coefficient columns, subtype, base, window_0/1, delay,
    duration, work_end, d_out, d_back, pref, ``pref`` being the liking of the
    subtype.  Options that would end after closing are dropped.
    """
    p, c = P.PARTICIPATION, F.col
    rows = rows.withColumn("start", F.greatest(c("work_end") + c("delay"), c("window_0")))
    rows = rows.where(c("start") + c("duration") <= c("window_1"))
    burden_ = F.lit(1.0)
    for name in ("risk_aversion", "budget_sensitivity", "variety_seeking", "platform_affinity"):
        burden_ = burden_ + P.BURDEN[name] * (c(name) - 0.5)
    outdoor = c("subtype").isin("park", "workout_or_run") & (c("walk_tolerance") >= p["outdoor_walk"])
    burden = p["km"] * (c("d_out") + c("d_back")) * clamp(burden_, P.BURDEN["lo"], P.BURDEN["hi"]) * F.when(outdoor, p["outdoor_discount"]).otherwise(1.0)
    value = (
        c("base") + p["act_intrinsic"] * c("intrinsic") + p["act_escape"] * c("escape") + p["act_affinity"] * c("travel_affinity")
        + p["act_pref"] * (c("pref") - 1.0)
    )
    for driver, weight, subtypes in P.PERSONALITY:
        value = value + F.when(c("subtype").isin(*subtypes), weight * (c(driver) - 0.5)).otherwise(0.0)
    for interest, subtypes in P.INTEREST_SUBTYPES.items():
        value = value + F.when((c("primary_interest") == interest) & c("subtype").isin(*subtypes), p["interest"]).otherwise(0.0)
    hour = c("start") / 60.0
    for window, (lo, hi, inside, outside) in P.TIME_WINDOW_BONUS.items():
        value = value + F.when(c("time_window") == window, F.when(hour.between(lo, hi), inside).otherwise(outside)).otherwise(0.0)
    jitter = (hash_uniform(c("agent_id").cast("string"), c("subtype"), F.lit(f"{salt}-noise")) * 2.0 - 1.0) * noise
    return rows.withColumn("activity_utility", value).withColumn("net_utility", c("activity_utility") - burden + jitter)


def participation(agents: DataFrame, options: DataFrame, salt: str = "plan", travel_norm: str = "neutral") -> DataFrame:
    """Per agent with options: signal, probability and draw of going out."""
    p, c = P.PARTICIPATION, F.col
    best = options.groupBy("agent_id").agg(F.max("net_utility").alias("best_net"))
    boost = (
        p["boost_intrinsic"] * c("intrinsic") + p["boost_escape"] * c("escape") + p["social"] * (c("social_orientation") - 0.5)
        + p["variety"] * (c("variety_seeking") - 0.5) + p["local"] * (c("local_leisure_frequency") - 0.5)
    )
    signal = (
        p["intercept"] + p["intention"] * tpb_intention("leisure", travel_norm) + p["motivation"] * boost + p["net"] * c("best_net")
        + p["spontaneity"] * (c("spontaneity_share") - 0.5) - p["negative"] * (c("negative_recommendation_experience") - 0.5)
        + p["familiarity"] * (c("city_familiarity") - 0.5)
    )
    rows = agents.join(best, "agent_id").withColumn("p_participate", clamp(sigmoid(signal), 0.0, p["p_max"]))
    go = (hash_uniform(c("agent_id").cast("string"), f"{salt}-go") < c("p_participate")) & (c("best_net") > p["min_net"])
    return rows.withColumn("goes_out", go)


def subtype_choice(options: DataFrame, salt: str = "plan") -> DataFrame:
    """Softmax over an agent's options (net utility times its temperature) and a draw."""
    p, c = P.PARTICIPATION, F.col
    heat = F.greatest(F.lit(p["t_min"]), p["temperature"] * (1.0 + p["t_max"] * (c("maximization") - 0.5)) * (1.0 - p["t_spont"] * (c("spontaneity_share") - 0.5)))
    option = F.struct("subtype_pos", "subtype", (c("net_utility") * heat).alias("v"))
    sets = options.groupBy("agent_id").agg(F.array_sort(F.collect_list(option)).alias("opts"))
    probs = softmax_array(F.transform("opts", lambda o: o["v"]))
    sets = sets.withColumn("probs", probs)
    u = hash_uniform(c("agent_id").cast("string"), f"{salt}-subtype")
    return sets.withColumn("chosen_subtype", c("opts")[draw_index(c("probs"), u) - 1]["subtype"])


def acceptance_eta(trust: Column, autonomy: Column, score: Column, n_accepted: Column, shift: float = 0.0) -> Column:
    """Willingness to accept: baseline, quality of the offer, memory of accepted ones."""
    e = P.ETA
    eta = (
        F.lit(e["intercept"]) + e["trust"] * (trust - 0.5) - e["autonomy"] * (autonomy - 0.5) + shift
        + e["quality"] * (score - 0.5) + e["memory"] * F.least(F.lit(e["memory_cap"]), n_accepted)
    )
    return clamp(eta, e["eta_min"], e["eta_max"])
