"""Population: personas to agents, survey traits, behaviour coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions import (
    clamp, coerce_unit_interval, draw_option, first_nonempty, hash_int, hash_uniform, hash_word, normalize_score, strip_blank,
)
from tripwise.functions.text import lookup
from tripwise.operators.ordering import ordinal

# Mean of the default motive distribution (2.0, 1.5, 1.2, 1.0)
BASE_MOTIVES = {"derived": 2.0 / 5.7, "intrinsic": 1.5 / 5.7, "escape": 1.2 / 5.7, "positionality": 1.0 / 5.7}
PINNED_MOTIVES = {"derived": 1.0, "intrinsic": 0.0, "escape": 0.0, "positionality": 0.0}


def _stated(df: DataFrame, name: str, default: str) -> Column:
    """A stated answer, stripped; the default stands in for a missing column or null."""
    return F.coalesce(strip_blank(F.col(name)), F.lit(default)) if name in df.columns else F.lit(default)


def _band(table: dict, default: tuple, value: Column) -> tuple[Column, Column]:
    lo = lookup({k: v[0] for k, v in table.items()}, value, default[0])
    hi = lookup({k: v[1] for k, v in table.items()}, value, default[1])
    return lo, hi


def renormalized(motives: dict[str, Column]) -> dict[str, Column]:
    """Weights floored at 0.01 and divided by their floored sum."""
    floored = {k: F.greatest(F.lit(0.01), v) for k, v in motives.items()}
    total = sum(list(floored.values())[1:], floored["derived"])
    return {k: v / total for k, v in floored.items()}


def persona_to_agent(personas: DataFrame, car_only: bool = True, derived_only: bool = True, seed: int = 42) -> DataFrame:
    """One agent per persona, a single projection.

    Bands become ranges with a keyed draw inside; unknown or blank answers take
    the defaults.  ``car_only`` gives everyone a car, ``derived_only`` pins the
    motives; both are on by default.
    """
    def said(name: str, default: str) -> Column:
        return _stated(personas, name, default)

    key = F.col("PersonaID")
    income = _band(P.INCOME_BANDS, P.INCOME_DEFAULT, said("Income", "35-75k"))
    age = _band(P.AGE_BANDS, P.AGE_DEFAULT, said("Age", "mid adult"))
    access = F.lit("own car") if car_only else said("CarAccess", "no car")
    interest, group, window = said("PrimaryInterest", "cultural"), said("Group", "solo"), said("TimeWindow", "weekday evening")
    top_rated = F.lower(said("TopRated", "no")) == "yes"
    budget = said("Budget", "medium")
    walk = F.coalesce(said("WalkTolerance", "15").try_cast("double").cast("int"), F.lit(15))
    shift = P.MOTIVATION_SHIFT
    if derived_only:
        motives = {k: F.lit(v) for k, v in PINNED_MOTIVES.items()}
    else:
        def plus(motive: str, when: Column) -> Column:
            return F.lit(BASE_MOTIVES[motive]) + F.when(when, F.lit(shift[motive])).otherwise(F.lit(0.0))

        motives = renormalized({
            "derived": plus("derived", interest.isin("food", "cultural")),
            "intrinsic": plus("intrinsic", interest.isin("nightlife", "nature")),
            "escape": plus("escape", group == "solo"),
            "positionality": plus("positionality", top_rated),
        })
    return personas.select(
        key.alias("persona_id"),
        hash_int(income[0], income[1], key, "income", F.lit(seed)).alias("income"),
        hash_int(age[0], age[1], key, "age", F.lit(seed)).alias("age"),
        access.alias("car_access"), (access == "own car").alias("car_ownership"),
        lookup(P.CAR_PENALTY, access, P.NO_CAR_PENALTY).alias("car_penalty"),
        lookup(P.TRANSIT_LEVEL, said("TransitAccess", "medium"), 0.55).alias("transit_level"),
        clamp(walk, 5, 45).alias("walk_tolerance"), said("MobilityNeeds", "none").alias("mobility_needs"),
        interest.alias("primary_interest"), window.alias("time_window"),
        F.when(said("RiskSalience", "low") == "high", 1.1).otherwise(0.95).alias("feedback_sensitivity"),
        F.when(said("EnvConscious", "low") == "high", 0.75).otherwise(0.25).alias("pref_green"),
        F.when(budget == "low", 1.2).when(budget == "high", 0.85).otherwise(1.0).alias("pref_cost"),
        F.when(window == "weekday evening", 1.1).otherwise(0.95).alias("pref_time"),
        F.when(group.isin("solo", "mixed friends 20-30"), 0.65).otherwise(0.5).alias("travel_affinity"),
        F.when(interest == "nightlife", 0.7).otherwise(0.4).alias("status_seeking"),
        F.when(top_rated, 0.7).otherwise(0.45).alias("practice_conformity"),
        *[motives[m].alias(m) for m in P.MOTIVES],
    )


def survey_profile(personas: DataFrame) -> DataFrame:
    """Measured traits of each persona, null where nothing was measured, with the
    fallbacks from stated answers.  Columns: PersonaID and the canonical traits."""
    def measured(aliases) -> Column:
        present = [F.col(a) for a in aliases if a in personas.columns]
        return coerce_unit_interval(first_nonempty(*present)) if present else F.lit(None).cast("double")

    def stated(name: str, default: str) -> Column:
        return F.lower(_stated(personas, name, default))

    traits = {k: measured(a) for table in (P.BIG_FIVE_ALIASES, P.LATENT_ALIASES, P.ITEM_ALIASES) for k, a in table.items()}
    follow_ai = F.coalesce(traits["follow_through_ai"], lookup({"high": 0.80, "med": 0.55, "low": 0.25}, stated("WillingnessAI", "med"), 0.55))
    traits.update({
        "budget_tightness": F.coalesce(traits["budget_tightness"], lookup({"low": 0.85, "medium": 0.50, "high": 0.20}, stated("Budget", "medium"), 0.50)),
        "follow_through_ai": follow_ai,
        "follow_through_platform": F.coalesce(traits["follow_through_platform"], follow_ai),
        "popularity_herding": F.coalesce(traits["popularity_herding"], F.when(stated("TopRated", "no") == "yes", 0.75).otherwise(0.40)),
        "spontaneity_share": F.coalesce(traits["spontaneity_share"], F.when(stated("Group", "solo").contains("friends"), 0.62).otherwise(0.45)),
        "city_familiarity": F.coalesce(traits["city_familiarity"], F.lit(0.65)),
    })
    return personas.select("PersonaID", *[traits[t].alias(t) for t in P.TRAITS])


def apply_survey_profile(profiles: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Measured traits over defaults, each on the scale of its item family; absent
    or unparsable values keep the default (0.5 unless given)."""
    defaults = defaults or {}
    names = [t for t in P.TRAITS if t in profiles.columns]
    rest = [c for c in profiles.columns if c not in names]
    return profiles.select(*rest, *[
        F.coalesce(normalize_score(t, *P.ITEM_SCALES.get(t, (1.0, 7.0))), F.lit(defaults.get(t, 0.5))).alias(t) for t in names
    ])


def _term(name: str) -> Column:
    if name == "@incentives":
        return (F.col("incentive_coupon") + F.col("incentive_sponsored") + F.col("incentive_loyalty")) / 3.0
    return F.lit(1.0) - F.col(name[1:]) if name.startswith("~") else F.col(name)


def _weighted(weights: dict[str, float]) -> Column:
    terms = [F.lit(w) * _term(n) for n, w in weights.items()]
    return sum(terms[1:], terms[0])


def behavior_coefficients(traits: DataFrame) -> DataFrame:
    """Ten clamped linear combinations of traits, generated from the weight table."""
    return traits.withColumns({name: clamp(_weighted(w)) for name, w in P.COEFFICIENTS.items()})


def behavior_overlay(agents: DataFrame, derived_only: bool = True) -> DataFrame:
    """Shift preferences, attitudes, motives and thresholds by the coefficients,
    each clamped to its own bounds."""
    shifted = {}
    for target, (drivers, lo, hi) in P.OVERLAY.items():
        value = F.col(target)
        for driver, weight in drivers:
            value = value + F.lit(weight) * (F.col(driver) - 0.5)
        shifted[target] = F.greatest(F.lit(lo), value) if hi is None else clamp(value, lo, hi)
    if derived_only:
        motives = {k: F.lit(v) for k, v in PINNED_MOTIVES.items()}
    else:
        motives = renormalized({m: F.col(m) + F.lit(w) * (F.col(d) - 0.5) for m, (d, w) in P.MOTIVE_OVERLAY.items()})
    return agents.withColumns({**shifted, **motives})


def paradigm_scores(agents: DataFrame, salt: str = "paradigm") -> DataFrame:
    """Sampling weight of each decision paradigm and one keyed draw."""
    scores = agents.withColumns({f"w_{p}": F.lit(1.0) + _weighted(P.PARADIGM_WEIGHTS[p]) for p in P.PARADIGMS})
    names = F.array(*map(F.lit, P.PARADIGMS))
    weights = F.array(*[F.col(f"w_{p}") for p in P.PARADIGMS])
    u = hash_uniform(F.col("agent_id").cast("string"), salt)
    return scores.withColumn("drawn_paradigm", draw_option(names, weights, u))


def mode_bias(agents: DataFrame) -> DataFrame:
    """Mode preference shifts, each limited to ±0.4."""
    biases = {}
    for mode, weights in P.MODE_BIAS.items():
        terms = [F.lit(w) * (F.col(d) - 0.5) for d, w in weights.items()]
        biases[f"bias_{mode}"] = clamp(sum(terms[1:], terms[0]), -0.4, 0.4)
    return agents.withColumns(biases)


def interest_keywords(agents: DataFrame, out: str = "interest_keywords") -> DataFrame:
    """Key words of the three best liked subtypes (``pref_<subtype>`` columns; ties
    keep the subtype order), in first-occurrence order."""
    options = F.array(*[
        F.struct((-F.col(f"pref_{s}")).alias("neg"), F.lit(i).alias("i"), F.array(*map(F.lit, P.SUBTYPE_KEYWORDS[s])).alias("words"))
        for i, s in enumerate(P.SUBTYPES)
    ])
    top = F.slice(F.array_sort(options), 1, 3)
    words = F.flatten(F.transform(top, lambda o: o["words"]))
    return agents.withColumn(out, F.array_distinct(F.transform(words, F.lower)))


def _indexed(df: DataFrame, key: Column, out: str, seed: str) -> DataFrame:
    """0-based row numbers in a keyed random order; chunks by hash are even."""
    rows = df.withColumn("_h", hash_word(key, F.lit(seed)))
    keyed = rows.withColumn("_key", key)
    return ordinal(keyed, [], ["_h", "_key"], F.floor(F.col("_h") / (1 << 22)), out).withColumn(out, F.col(out) - 1).drop("_h", "_key")


def _coordinate(c: str) -> Column:
    return F.format_string("%.6f", F.col(c))


def relocate_personas(personas: DataFrame, nodes: DataFrame, seed: int = 2025) -> DataFrame:
    """Copy personas with a home drawn uniformly among base network nodes."""
    base = _indexed(nodes.where("is_base"), F.col("node_id").cast("string"), "_i", f"homes{seed}")
    n = base.agg(F.count(F.lit(1))).scalar()
    drawn = personas.withColumn("_i", F.floor(hash_uniform(F.col("PersonaID"), F.lit(f"home{seed}")) * n))
    homes = base.select("_i", _coordinate("lat").alias("start_latitude"), _coordinate("lon").alias("start_longitude"))
    kept = [c for c in personas.columns if c not in ("start_latitude", "start_longitude")]
    return drawn.select("_i", *kept).join(homes, "_i").select(*personas.columns)


def bootstrap_marginals(personas: DataFrame, nodes: DataFrame, extra: DataFrame, seed: int = 42) -> DataFrame:
    """New personas whose columns are resampled independently from the given ones.

    ``extra`` has one row per new persona (``idx``).  All columns of a new persona
    share one join: it looks up one base row per column.  Homes are distinct: the
    n-th new persona takes the n-th free node in a keyed random order.
    """
    columns = [c for c in personas.columns if c not in ("PersonaID", "start_latitude", "start_longitude")]
    base = _indexed(personas, F.col("PersonaID"), "_i", f"base{seed}")
    n = base.agg(F.count(F.lit(1))).scalar()
    new = extra.select(F.format_string("SYN%04d", F.col("idx")).alias("PersonaID"), "idx")
    asks = new.select("PersonaID", F.explode(F.array(*map(F.lit, columns))).alias("_c"), n.alias("_n")).withColumn(
        "_i", F.floor(hash_uniform("PersonaID", F.col("PersonaID"), F.col("_c"), F.lit(seed)) * F.col("_n")))
    cells = base.select("_i", F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("_row"))
    picked = F.coalesce(*[F.when(F.col("_c") == c, F.col(f"_row.{c}")) for c in columns])
    answers = asks.join(cells, "_i").select("PersonaID", "_c", picked.alias("_v")).groupBy("PersonaID").agg(
        *[F.max(F.when(F.col("_c") == c, F.col("_v"))).alias(c) for c in columns])
    used = personas.select(F.round(F.col("start_latitude").try_cast("double"), 6).alias("_la"), F.round(F.col("start_longitude").try_cast("double"), 6).alias("_lo"))
    free = nodes.where("is_base").withColumns({"_la": F.round("lat", 6), "_lo": F.round("lon", 6)}).join(used, ["_la", "_lo"], "left_anti")
    spots = free.groupBy("_la", "_lo").agg(F.min("node_id").alias("node_id"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    homes = _indexed(spots, F.col("node_id").cast("string"), "_i", f"free{seed}")
    n_free = homes.agg(F.count(F.lit(1))).scalar()
    placed = _indexed(new, F.col("PersonaID"), "_k", f"order{seed}").withColumn("_i", F.pmod(F.col("_k"), n_free))
    located = placed.join(homes.select("_i", _coordinate("lat").alias("start_latitude"), _coordinate("lon").alias("start_longitude")), "_i")
    return located.select("PersonaID", "start_latitude", "start_longitude").join(answers, "PersonaID").select(*personas.columns)
