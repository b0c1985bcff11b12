"""Per-tick series and day summaries, computed from trip tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise import params as P

DAY = ["treatment", "seed", "day"]


def tick_of(minute: Column) -> Column:
    return (F.floor(minute / P.TICK_MINUTES) * P.TICK_MINUTES).cast("long")


def road_factor(volume: Column, capacity: Column | float) -> Column:
    x = F.greatest(F.lit(0.0), volume / capacity)
    return F.lit(1.0) + P.CONGESTION["alpha"] * F.pow(x, F.lit(float(P.CONGESTION["beta"])))


def crowd_factor(volume: Column, capacity: Column | float) -> Column:
    x = F.greatest(F.lit(0.0), volume / capacity)
    return F.lit(1.0) + P.CONGESTION["crowd"] * x * x


def _day_ticks(days: DataFrame) -> DataFrame:
    last = P.DAY_MINUTES - P.TICK_MINUTES
    return days.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(P.TICK_MINUTES)))).withColumn(
        "tick", F.col("tick").cast("long"))


def departures(trips: DataFrame) -> DataFrame:
    """Counts and means of the trips that start in each non-empty tick."""
    return trips.withColumn("tick", tick_of(F.col("depart"))).groupBy(*DAY, "tick").agg(
        F.count(F.lit(1)).alias("departures"),
        F.sum((F.col("mode") == "car").cast("long")).alias("road_volume"),
        F.sum((F.col("mode") == "transit").cast("long")).alias("transit_volume"),
        F.avg(F.col("travel_min").cast("double")).alias("avg_travel_time_min"),
        F.avg("cost").alias("avg_cost"), F.avg("emissions_g").alias("avg_emissions_g"),
    )


def in_transit(trips: DataFrame) -> DataFrame:
    """Agents on the way at the end of each tick t: departed in a tick <= t and
    arriving after t.  Start and end events are summed per tick first, so the
    running sum sees at most 288 rows per day."""
    first_seen = F.ceil(F.col("arrival") / P.TICK_MINUTES) * P.TICK_MINUTES
    event = F.explode(F.array(
        F.struct(tick_of(F.col("depart")).alias("tick"), F.lit(1).alias("delta")),
        F.struct(first_seen.cast("long").alias("tick"), F.lit(-1).alias("delta")),
    ))
    return trips.select(*DAY, event.alias("e")).groupBy(*DAY, F.col("e.tick").alias("tick")).agg(
        F.sum("e.delta").alias("delta"))


def tick_series(trips: DataFrame, road_capacity: float, transit_capacity: float) -> DataFrame:
    """One row per run, day and tick, empty ticks included."""
    grid = _day_ticks(trips.select(*DAY).distinct())
    running = Window.partitionBy(*DAY).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    series = (
        grid.join(departures(trips), DAY + ["tick"], "left").join(in_transit(trips), DAY + ["tick"], "left")
        .na.fill(0, ["departures", "road_volume", "transit_volume", "delta"])
        .na.fill(0.0, ["avg_travel_time_min", "avg_cost", "avg_emissions_g"])
        .withColumn("in_transit", F.sum("delta").over(running)).drop("delta")
    )
    return series.withColumns({
        "road_factor": road_factor(F.col("road_volume"), road_capacity),
        "crowd_factor": crowd_factor(F.col("transit_volume"), transit_capacity),
    })


def tick_mode_counts(trips: DataFrame) -> DataFrame:
    """Mode counts per non-empty tick, one column per mode; trips of any other mode, or of
    none, are counted in ``other``."""
    names = [*P.MODES, "other"]
    known = F.when(F.col("mode").isin(*P.MODES), F.col("mode")).otherwise("other")
    modes = trips.withColumns({"tick": tick_of(F.col("depart")), "mode": known}).groupBy(*DAY, "tick").pivot("mode", names)
    return modes.count().na.fill(0, names)


def lagged_congestion(trips: DataFrame, road_capacity: float, transit_capacity: float) -> DataFrame:
    """Congestion a trip sees: volumes of the previous non-empty tick of its day."""
    seen = Window.partitionBy(*DAY).orderBy("tick")
    ticks = departures(trips).select(
        *DAY, "tick", F.lag("road_volume", 1, 0).over(seen).alias("road_before"),
        F.lag("transit_volume", 1, 0).over(seen).alias("transit_before"),
    )
    rows = trips.withColumn("tick", tick_of(F.col("depart"))).join(ticks, DAY + ["tick"])
    return rows.withColumns({
        "road_factor": road_factor(F.col("road_before"), road_capacity),
        "crowd_factor": crowd_factor(F.col("transit_before"), transit_capacity),
    })


def peer_status(trips: DataFrame) -> DataFrame:
    """Mean status of the modes used in the previous non-empty tick (0.5 at the start)."""
    counts = tick_mode_counts(trips)
    total = sum((F.col(m) for m in P.MODES[1:]), F.col(P.MODES[0]))
    weighted = sum((F.col(m) * P.MODE_TABLE[m]["status"] for m in P.MODES[1:]), F.col(P.MODES[0]) * P.MODE_TABLE[P.MODES[0]]["status"])
    seen = Window.partitionBy(*DAY).orderBy("tick")
    return counts.select(*DAY, "tick", F.coalesce(F.lag(weighted / total).over(seen), F.lit(0.5)).alias("peer_status"))


def arrival_delay(trips: DataFrame) -> DataFrame:
    """Delay of every arrival against the planned start of the activity: arrivals
    are handled at the first tick at or after them, within the day."""
    handled = (F.ceil(F.col("arrival") / P.TICK_MINUTES) * P.TICK_MINUTES).cast("long")
    rows = trips.withColumn("handled", handled).where(F.col("handled") < P.DAY_MINUTES)
    return rows.withColumn("delay", F.greatest(F.lit(0), F.col("handled") - F.col("planned_start")))


def delay_totals(delays: DataFrame) -> DataFrame:
    return delays.groupBy(*DAY).agg(
        F.sum((F.col("delay") > 0).cast("long")).alias("late_arrivals"), F.sum("delay").alias("total_delay"))


def _share_map(key: str, values: list[str], total: Column) -> list[Column]:
    return [(F.sum((F.col(key) == v).cast("long")) / total).alias(f"{key}_{v}") for v in values]


def day_summary(trips: DataFrame, delays: DataFrame, agents: DataFrame) -> DataFrame:
    """Summary of every run day, days counted from 1."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    leisure = (F.col("purpose") == "leisure") & (F.col("subtype") != "")
    n_leisure = F.greatest(F.lit(1), F.sum(leisure.cast("long")))
    rated = leisure & F.col("liked").isin(0, 1)
    n_rated = F.sum(rated.cast("long"))

    def total(c: str) -> Column:
        return F.sum(c)

    base = trips.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("trips"),
        (F.sum(F.col("travel_min").cast("double")) / n).alias("avg_travel_time_min"),
        (total("cost") / n).alias("avg_cost"), (total("emissions_g") / n).alias("avg_emissions_g"),
        *_share_map("mode", list(P.MODES), n), *_share_map("purpose", ["home", "work", "leisure"], n),
        *[F.sum((leisure & (F.col("subtype") == s)).cast("long")).alias(f"n_{s}") for s in P.SUBTYPES],
        F.sum((leisure & (F.col("source") == "organic")).cast("long")).alias("n_organic"),
        (F.sum((leisure & F.col("accepted")).cast("long")) / n_leisure).alias("acceptance_rate"),
        F.coalesce(F.avg(F.when(leisure, F.col("eta"))), F.lit(0.0)).alias("avg_eta"),
        F.when(n_rated > 0, F.sum(F.when(rated, F.col("liked"))) / n_rated).otherwise(F.lit(0.0)).alias("like_rate"),
        total("utility").alias("total_trip_utility"), (total("utility") / n).alias("avg_trip_utility"),
        total("travel_utility").alias("total_travel_utility"), total("activity_utility").alias("total_activity_utility"),
    )
    people = agents.groupBy("treatment", "seed").agg(F.count(F.lit(1)).alias("_agents"))
    return (
        base.join(delay_totals(delays), DAY, "left").join(people, ["treatment", "seed"], "left")
        .na.fill(0, ["late_arrivals", "total_delay"])
        .withColumn("avg_delay_min", F.col("total_delay") / F.greatest(F.lit(1), F.coalesce("_agents", F.lit(1))))
        .withColumn("day", F.col("day") + 1).drop("_agents", "total_delay")
    )


def label_counts(trips: DataFrame, dimensions=("mode", "purpose", "subtype", "source")) -> DataFrame:
    """Count and share of every label of every dimension per run day, days counted from
    1: whatever labels the trips have.  Subtypes and sources count leisure trips only."""
    leisure = (F.col("purpose") == "leisure") & (F.col("subtype") != "")
    cells = F.array(*[
        F.struct(F.lit(d).alias("dimension"), (F.when(leisure, F.col(d)) if d in ("subtype", "source") else F.col(d)).alias("label"))
        for d in dimensions
    ])
    rows = trips.select(*DAY, F.explode(F.filter(cells, lambda x: x["label"].isNotNull())).alias("_c")).select(*DAY, "_c.*")
    counts = rows.groupBy(*DAY, "dimension", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*DAY, "dimension").agg(F.sum("n").alias("_t"))
    shares = counts.join(totals, [*DAY, "dimension"]).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    return shares.withColumn("day", F.col("day") + 1)


def trip_totals(trips: DataFrame) -> DataFrame:
    """Trip, time, cost and emission totals by run, day and mode, with all subtotals
    of the rollup in one pass."""
    return trips.rollup("treatment", "seed", "day", "mode").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("travel_min").alias("travel_time"),
        F.sum("cost").alias("cost"), F.sum("emissions_g").alias("emissions"),
    )
