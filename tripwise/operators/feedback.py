"""Feedback state: public ratings, affinities, travel-cost estimates.

Affinity and value-of-time updates are clamped, so their order matters.  Every
clamped update is a map x -> min(h, max(l, m*x + s)), and such maps compose into
one map of the same form.  So the events of a key are split into consecutive
chunks, each chunk is folded into one map on its own, and the maps are composed
level by level (``ordering.up_sweep``, ``down_sweep``), a fixed number to a row:
no task and no row needs all events or all chunks of a busy key.  Buckets are
whole numbers in the order of the events, hours as a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions import clamp, hash_uniform, sigmoid
from tripwise.operators.ordering import chunk_rows, down_sweep, previous, running_total, up_sweep

HOUR = 3600


def ts_bucket(ts: str = "ts", seconds: int = HOUR) -> Column:
    """Consecutive time buckets for chunking."""
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)


# ---------------------------------------------------------------- public state
def footfall(visits: DataFrame, prior: float = P.DYNAMICS["prior_visits"]) -> DataFrame:
    """Recorded visits per place, recommended and organic; blank places are ignored."""
    known = visits.where(F.col("place_id").isNotNull() & (F.col("place_id").cast("string") != ""))
    return known.groupBy("place_id").agg(F.count(F.lit(1)).alias("visits")).withColumn("popularity", F.col("visits") + F.lit(prior))


def bayesian_rating(base: Column, likes: Column, dislikes: Column) -> Column:
    """Star rating with the base rating as a prior; untouched without feedback."""
    d = P.DYNAMICS
    blended = (base * d["prior_weight"] + d["like_star"] * likes + d["dislike_star"] * dislikes) / (d["prior_weight"] + likes + dislikes)
    return F.when((likes == 0) & (dislikes == 0), base).otherwise(clamp(blended, d["rating_min"], d["rating_max"]))


def place_dynamics(places: DataFrame, events: DataFrame) -> DataFrame:
    """Effective rating, review count and popularity of every place.  ``events``:
    place_id, kind in visit / like / dislike."""
    counts = events.groupBy("place_id").agg(*[
        F.sum((F.col("kind") == k).cast("long")).alias(f"{k}s") for k in ("visit", "like", "dislike")
    ])
    rows = places.join(counts, "place_id", "left").na.fill(0, ["visits", "likes", "dislikes"])
    return rows.withColumns({
        "live_rating": bayesian_rating(F.col("rating"), F.col("likes"), F.col("dislikes")),
        "live_reviews": F.col("review_count") + F.col("likes") + F.col("dislikes"),
        "live_popularity": F.col("visits") + F.lit(P.DYNAMICS["prior_visits"]),
    })


# ---------------------------------------------------------------- affinities
def signed_delta(liked: Column, strength: Column, rate: float = P.FEEDBACK["rate"]) -> Column:
    step = rate * clamp(strength, P.FEEDBACK["strength_min"], P.FEEDBACK["strength_max"])
    return F.when(liked, step).otherwise(-step)


def _clamped_sum(events: Column) -> Column:
    """Compose the updates x -> clamp(x + delta, -1, 1) of a chunk into (s, lo, hi)."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(events, start, lambda a, e: F.struct(
        (a["s"] + e["delta"]).alias("s"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a["lo"] + e["delta"])).alias("lo"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a["hi"] + e["delta"])).alias("hi"),
    ))


def _then_clamped(a: Column, b: Column) -> Column:
    """Clamped addition a, then b, as one."""
    def through(x: Column) -> Column:
        return F.least(b["hi"], F.greatest(b["lo"], x + b["s"]))

    return F.struct((a["s"] + b["s"]).alias("s"), through(a["lo"]).alias("lo"), through(a["hi"]).alias("hi"))


def _onto(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the earlier state of their key, if there is one; null is a key like any other."""
    state = state.withColumnsRenamed({k: f"_{k}_" for k in keys})
    return rows.join(state, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys], "left").drop(*[f"_{k}_" for k in keys])


def clamped_fold(events: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "aff",
                 initial: DataFrame | None = None) -> DataFrame:
    """Final value per key of clamped additions of ``delta``, starting from 0 or from
    the value of an earlier state table."""
    chunks = chunk_rows(events, keys, order, bucket, [F.col("delta")]).withColumn("_m", _clamped_sum(F.col("events")))
    total = up_sweep(chunks, keys, _then_clamped)[-1]
    first = F.lit(0.0)
    if initial is not None:
        total = _onto(total, initial.select(*keys, F.col(out).alias("_x0")), keys)
        first = F.coalesce("_x0", F.lit(0.0))
    value = F.least(F.col("_m.hi"), F.greatest(F.col("_m.lo"), first + F.col("_m.s")))
    return total.select(*keys, value.alias(out))


def _known(events: DataFrame, places: DataFrame, sources) -> DataFrame:
    rated = events.where(F.col("kind").isin("like", "dislike") & F.col("source").isin(*sources))
    return rated.withColumn("delta", signed_delta(F.col("kind") == "like", F.col("strength"))).join(places, "place_id")


SOURCES = tuple(dict.fromkeys(s for _, s, _ in P.SOURCE_ROUTES))


def place_affinity(events: DataFrame, places: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Affinity per (source, user, place); unknown places and sources are ignored.
    ``events``: event_id, ts, user_id, place_id, source, kind, strength."""
    rated = _known(events, places.select("place_id"), SOURCES)
    return clamped_fold(rated, ["source", "user_id", "place_id"], ["ts", "event_id"], ts_bucket() if bucket is None else bucket)


def keyword_affinity(events: DataFrame, places: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Affinity per (source, user, key word): a discounted update for every key word
    of the rated place."""
    rated = _known(events, places.select("place_id", "keywords"), SOURCES).select(
        "source", "user_id", "ts", "event_id", (F.col("delta") * P.FEEDBACK["keyword_discount"]).alias("delta"),
        F.posexplode("keywords").alias("pos", "word"),
    ).withColumn("keyword", F.lower("word"))
    return clamped_fold(rated, ["source", "user_id", "keyword"], ["ts", "event_id", "pos"], ts_bucket() if bucket is None else bucket)


# ---------------------------------------------------------------- ratings of trips
def like_probability(weather: str = "fair", social_norms: str = "standard") -> Column:
    """Chance that an accepted leisure trip is liked, from trip and agent columns."""
    f = P.FEEDBACK
    c = F.col
    context = F.lit(0.0)
    if weather in ("rain", "heat"):
        context = context + F.when(c("subtype").isin("park", "workout_or_run"), F.lit(f["outdoor_penalty"])).otherwise(F.lit(0.0))
    if social_norms == "green":
        context = context + F.when(c("subtype") == "park", F.lit(f["green_park"])).otherwise(F.lit(0.0))
    score = (
        f["activity"] * c("activity_utility") + f["travel"] * c("travel_utility") + f["pref"] * (c("pref") - 1.0)
        + f["intrinsic"] * c("intrinsic") + f["escape"] * c("escape") + f["affinity"] * c("travel_affinity")
        + f["trust"] * (c("trust_platforms") - 0.5) + f["loop"] * (c("feedback_loop_strength") - 0.5)
        - f["autonomy"] * (c("autonomy_preference") - 0.5) - f["awareness"] * (c("algorithmic_awareness") - 0.5) + context
    )
    score = score * (1.0 + f["sensitivity"] * (c("feedback_sensitivity") - 1.0))
    p = clamp(sigmoid(f["scale"] * score), f["p_min"], f["p_max"])
    return F.when((c("purpose") == "leisure") & c("accepted"), p).otherwise(F.lit(0.0))


def feedback_strength(p_like: Column, sensitivity: Column) -> Column:
    f = P.FEEDBACK
    return clamp(F.greatest(F.lit(f["strength_floor"]), F.abs(2.0 * p_like - 1.0) * sensitivity), f["strength_min"], f["strength_max"])


def continuous_feedback(trips: DataFrame) -> DataFrame:
    """Satisfaction in [-1, 1], realised travel cost and net utility of rated trips."""
    sens = clamp("feedback_sensitivity", 0.2, 2.0)
    return trips.withColumns({
        "satisfaction": clamp((2.0 * F.col("p_like") - 1.0) * sens, -1.0, 1.0),
        "realized_travel_cost": F.col("cost") + F.col("travel_min") / 60.0 * P.TRAVEL_COST["default_vot"],
        "net_utility": F.col("activity_utility") + F.col("travel_utility"),
    })


# ---------------------------------------------------------------- travel cost
def _vot_factor(e: Column) -> Column:
    """Signed kind of update: +1 raises the value of time, -1 lowers it."""
    t = P.TRAVEL_COST
    up = (e["travel_min"] > 0) & (e["satisfaction"] < t["dislike"])
    down = (e["travel_min"] > t["long_min"]) & (e["satisfaction"] > t["like"])
    return F.when(up, 1.0 + t["up"] * F.abs(e["satisfaction"])).when(down, 1.0 - t["down"] * e["satisfaction"]).otherwise(F.lit(1.0))


def _limit(v: Column, factor: Column) -> Column:
    t = P.TRAVEL_COST
    moved = v * factor
    return F.when(factor > 1, F.least(F.lit(t["vot_max"]), moved)).when(factor < 1, F.greatest(F.lit(t["vot_min"]), moved)).otherwise(v)


def travel_cost_state(events: DataFrame, keys: list[str] | None = None, order: list[str] | None = None,
                      bucket: Column | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Per user: observations, moving average of realised cost, revealed value of
    time, from scratch or on top of an earlier state.  ``events``: user_id, ts,
    event_id, money, travel_min, satisfaction.

    The value of time at the start of each chunk comes from composing the chunks
    before it; with it known, a chunk's effect on the average is linear.
    """
    keys, order = keys or ["user_id"], order or ["ts", "event_id"]
    t = P.TRAVEL_COST
    fields = [F.col("money").cast("double").alias("money"), F.col("travel_min").cast("double").alias("travel_min"), F.col("satisfaction")]
    chunks = chunk_rows(events, keys, order, ts_bucket() if bucket is None else bucket, fields)
    start = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("lo"), F.lit(1e18).alias("hi"))

    def compose(a: Column, e: Column) -> Column:
        f = _vot_factor(e)
        return F.struct((a["m"] * f).alias("m"), _limit(a["lo"], f).alias("lo"), _limit(a["hi"], f).alias("hi"))

    chunks = chunks.withColumn("_m", F.aggregate("events", start, compose))

    def apply(v: Column, m: Column) -> Column:
        return F.least(m["hi"], F.greatest(m["lo"], v * m["m"]))

    def then(a: Column, b: Column) -> Column:
        return F.struct((a["m"] * b["m"]).alias("m"), apply(a["lo"], b).alias("lo"), apply(a["hi"], b).alias("hi"))

    levels = up_sweep(chunks, keys, then)
    v_first, e_first, n_first = F.lit(t["default_vot"]), F.lit(0.0), F.lit(0).cast("long")
    if initial is not None:
        held = initial.select(*keys, F.struct("n", "avg_travel_cost", "vot").alias("_s0"))
        levels[-1] = _onto(levels[-1], held, keys)
        v_first = F.coalesce("_s0.vot", v_first)
        e_first, n_first = F.coalesce("_s0.avg_travel_cost", e_first), F.coalesce("_s0.n", n_first)
    starts = down_sweep(levels, keys, v_first, apply)
    first = F.struct(F.col("_v").alias("vot"), F.lit(0.0).alias("ema"), F.lit(1.0).alias("decay"))

    def observe(a: Column, e: Column) -> Column:
        realized = e["money"] + e["travel_min"] / 60.0 * a["vot"]
        keep = 1.0 - t["rate"]
        return F.struct(
            _limit(a["vot"], _vot_factor(e)).alias("vot"), (keep * a["ema"] + t["rate"] * realized).alias("ema"), (a["decay"] * keep).alias("decay"))

    seen = F.aggregate("events", first, observe)
    costs = chunks.join(starts, keys + ["_b"]).select(*keys, "_b", seen.alias("_e"), F.size("events").cast("long").alias("_n"))
    costs = costs.select(*keys, "_b", F.struct("_n", F.col("_e.ema").alias("x"), F.col("_e.decay").alias("decay")).alias("_m"))
    cost = up_sweep(costs, keys, lambda a, b: F.struct(
        (a["_n"] + b["_n"]).alias("_n"), (a["x"] * b["decay"] + b["x"]).alias("x"), (a["decay"] * b["decay"]).alias("decay")))[-1]
    last = levels[-1].select(*keys, apply(v_first, F.col("_m")).alias("vot"), e_first.alias("_x0"), n_first.alias("_n0"))
    return cost.select(*keys, "_m").join(last, keys).select(
        *keys, (F.col("_n0") + F.col("_m._n")).alias("n"), (F.col("_x0") * F.col("_m.decay") + F.col("_m.x")).alias("avg_travel_cost"), "vot")


def reference_points(trips: DataFrame, agents: DataFrame, bucket: Column, alpha: float = P.REFERENCE_ALPHA) -> DataFrame:
    """Per agent, moving averages of trip time and cost in trip order, starting from
    the agent's own reference values.  ``bucket``: whole numbers in that order."""
    chunks = chunk_rows(trips, ["agent_id"], ["day", "depart", "trip_key"], bucket, [F.col("travel_min").cast("double").alias("t"), F.col("cost").alias("c")])
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("c"), F.lit(1.0).alias("decay"))
    folded = F.aggregate("events", start, lambda a, e: F.struct(
        ((1 - alpha) * a["t"] + alpha * e["t"]).alias("t"), ((1 - alpha) * a["c"] + alpha * e["c"]).alias("c"), (a["decay"] * (1 - alpha)).alias("decay")))
    total = up_sweep(chunks.withColumn("_m", folded), ["agent_id"], lambda a, b: F.struct(
        (a["t"] * b["decay"] + b["t"]).alias("t"), (a["c"] * b["decay"] + b["c"]).alias("c"), (a["decay"] * b["decay"]).alias("decay")))[-1]
    rows = agents.select("agent_id", "ref_time", "ref_cost").join(total.select("agent_id", "_m"), "agent_id", "left")

    def final(field: str, first: str) -> Column:
        return F.when(F.col("_m").isNull(), F.col(first)).otherwise(F.col(first) * F.col("_m.decay") + F.col("_m")[field])

    return rows.select("agent_id", final("t", "ref_time").alias("ref_time"), final("c", "ref_cost").alias("ref_cost"))


def accepted_memory(trips: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Recommendations an agent had accepted before each trip."""
    return running_total(trips, keys, order, bucket, F.col("accepted").cast("long"), "n_accepted", inclusive=False)


def match_feedback_trip(trips: DataFrame, feedback: DataFrame, bucket: Column) -> DataFrame:
    """Each feedback with the latest not yet rated trip of the agent to the place.

    Trips open and feedbacks close, like brackets: a feedback that lowers the count
    of open trips to a level belongs to the last trip that raised it from there.
    ``trips``: agent_id, place_id, t, trip_key; ``feedback``: agent_id, place_id, t,
    feedback_id.  At equal times trips come first.
    """
    events = trips.select("agent_id", "place_id", "t", F.lit(0).alias("kind"), F.col("trip_key").alias("id")).unionByName(
        feedback.select("agent_id", "place_id", "t", F.lit(1).alias("kind"), F.col("feedback_id").alias("id")))
    keys, order = ["agent_id", "place_id"], ["t", "kind", "id"]
    leveled = running_total(events, keys, order, bucket, F.when(F.col("kind") == 0, 1).otherwise(-1), "_open")
    leveled = leveled.withColumn("_level", F.when(F.col("kind") == 0, F.col("_open") - 1).otherwise(F.col("_open")))
    seen = previous(leveled, keys + ["_level"], order, bucket, F.struct("kind", "id"), "_prev")
    trip = F.when(F.col("_prev.kind") == 0, F.col("_prev.id"))
    return seen.where(F.col("kind") == 1).select("agent_id", "place_id", F.col("id").alias("feedback_id"), trip.alias("trip_key"))


def rate_trips(trips: DataFrame, salt: str = "like", **context) -> DataFrame:
    """Accepted leisure trips with like draw, strength and continuous feedback."""
    rated = trips.where((F.col("purpose") == "leisure") & F.col("accepted")).withColumn("p_like", like_probability(**context))
    rated = rated.withColumns({
        "like": hash_uniform(F.col("trip_key").cast("string"), salt) < F.col("p_like"),
        "strength": feedback_strength(F.col("p_like"), F.col("feedback_sensitivity")),
    })
    return continuous_feedback(rated)


def apply_feedback(trips: DataFrame, places: DataFrame, gated: bool = True, **context) -> dict[str, DataFrame]:
    """All effects of the rated trips: public ratings, affinities of the source that
    recommended, and, behind a welfare gate, continuous feedback and travel-cost
    state.  ``ts`` orders the trips."""
    rated = rate_trips(trips, **context)
    events = rated.select(
        F.col("trip_key").alias("event_id"), "ts", F.col("agent_id").alias("user_id"), "place_id", "source", "strength",
        F.when(F.col("like"), "like").otherwise("dislike").alias("kind"), F.col("cost").alias("money"), "travel_min", "satisfaction")
    effects = {
        "rated": rated, "dynamics": place_dynamics(places, events),
        "place_affinity": place_affinity(events, places), "keyword_affinity": keyword_affinity(events, places),
    }
    if gated:
        effects["travel_cost"] = travel_cost_state(events)
    return effects
