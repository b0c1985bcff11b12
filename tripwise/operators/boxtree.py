"""Best-k search over places without forming all pairs.

Items are put into a tree of grid cells (position, and optionally a static
score).  A request walks down the tree with joins: every cell has the count of
its items and the range of their position and static score, so the best and the
worst score any of its items can have for this request are known.  Cells that
cannot reach the request's k-th best score are dropped; only the items of the
few surviving leaf cells are scored.  The bounds are exact, so the result is the
same as scoring every pair.

Dense spots just make the tree deeper there.  A request never meets more than
the children of its surviving cells, and of the items at one spot only those that
k others there don't beat are kept, so a spot with a million places costs no more
than k of them.

Estimated sizes of tables read back are far below their size in memory.  So levels
are counted: they are broadcast while all together have at most ``SENT_ROWS`` rows,
and joined by sorting beyond.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.functions.geo import EARTH_KM
from tripwise.session import kept

DEPTH = {True: (20, 1), False: (10, 2)}  # with static score or not: levels, bits per dimension and level
LEAF_ITEMS = 24
SLACK = 1e-9  # bounds and exact scores round differently
SENT_ROWS = 200_000  # cells and items that a search sends to all executors
BUILD_ROWS = 50_000  # cells of a level that its items' split sends

BOX = ("south", "west", "north", "east")


def _hav(a: Column) -> Column:
    return F.lit(2.0 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), a))))


def sphere_bounds(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Smallest and largest great-circle distance from a point to the cell box."""
    s, w, n, e = (F.col(c) for c in BOX)

    def half_sin2(d: Column) -> Column:
        h = F.sin(F.radians(d) / 2.0)
        return h * h

    def spread(x: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        return F.greatest(F.lit(0.0), lo - x, x - hi), F.greatest(F.abs(x - lo), F.abs(x - hi))

    p0, p1 = spread(lat, s, n)
    l0, l1 = spread(lon, w, e)
    # sin^2(x/2) rises to 180 degrees and falls after it, so extremes sit at the
    # ends of the range unless it contains 180
    m0 = F.least(half_sin2(l0), half_sin2(l1))
    m1 = F.when((l0 <= 180) & (l1 >= 180), F.lit(1.0)).otherwise(F.greatest(half_sin2(l0), half_sin2(l1)))
    c_lo = F.least(F.cos(F.radians(s)), F.cos(F.radians(n)))
    c_hi = F.when((s <= 0) & (n >= 0), F.lit(1.0)).otherwise(F.greatest(F.cos(F.radians(s)), F.cos(F.radians(n))))
    here = F.cos(F.radians(lat))
    return _hav(half_sin2(p0) + here * c_lo * m0), _hav(half_sin2(p1) + here * c_hi * m1)


def plane_bounds(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The same in planar degrees; the far bound holds for anything inside the box."""
    s, w, n, e = (F.col(c) for c in BOX)
    dy0, dx0 = F.greatest(F.lit(0.0), s - lat, lat - n), F.greatest(F.lit(0.0), w - lon, lon - e)
    dy1, dx1 = F.greatest(F.abs(lat - s), F.abs(lat - n)), F.greatest(F.abs(lon - w), F.abs(lon - e))
    return F.hypot(dy0, dx0), F.hypot(dy1, dx1)


@dataclass
class Tree:
    levels: list[DataFrame]  # cells per level: root, cell, parent, leaf, n, box, s_lo, s_hi
    sizes: list[int]  # number of cells per level
    items: DataFrame  # items with their leaf cell
    n_items: int


def _joined_by_size(side: DataFrame, rows: int, sent: int) -> DataFrame:
    """``side`` of a join, broadcast if it and the ``sent`` rows before fit."""
    return F.broadcast(side) if sent + rows <= SENT_ROWS else side.hint("merge")


def _code(items: DataFrame, use_static: bool) -> Column:
    """Interleaved cell digits of an item over the extent of all items."""
    y, x = (F.col("south") + F.col("north")) / 2.0, (F.col("west") + F.col("east")) / 2.0
    dims = [y, x] + ([F.col("s")] if use_static else [])
    edges = items.agg(*[f(d).alias(f"{f.__name__}{i}") for i, d in enumerate(dims) for f in (F.min, F.max)]).first()
    n_levels, bits = DEPTH[use_static]
    top = (1 << (bits * n_levels)) - 1
    grids = []
    for i, name in enumerate(["(south + north) / 2", "(west + east) / 2", "s"][: len(dims)]):
        lo, hi = edges[f"min{i}"] or 0.0, edges[f"max{i}"] or 0.0
        width = (hi - lo) or 1.0
        grids.append(f"CAST(least({top}, greatest(0, floor(({name} - ({lo!r}D)) / {width!r}D * {float(top + 1)!r}D))) AS BIGINT)")
    # one text expression: digit by digit, most significant level first
    width = bits * len(dims)
    parts = [f"{1 << (width * n_levels)}L"]
    for level in range(n_levels):
        for i, g in enumerate(grids):
            parts.append(f"shiftleft(shiftright({g}, {bits * level}) & {(1 << bits) - 1}L, {width * level + bits * (len(dims) - 1 - i)})")
    return F.expr(" | ".join(parts))


def build_tree(items: DataFrame, use_static: bool = False, leaf_items: int = LEAF_ITEMS) -> Tree:
    """Tree over items with columns root, south, west, north, east (and s).

    A cell is split while it holds more than ``leaf_items`` items; each level
    reads only the items of cells that were split above it.
    """
    n_levels, bits = DEPTH[use_static]
    step = bits * (3 if use_static else 2)
    if "s" not in items.columns:
        items = items.withColumn("s", F.lit(0.0))
    items = kept(items)
    items = kept(items.withColumn("_code", _code(items, use_static)))

    def cell(level: int) -> Column:
        return F.shiftright(F.col("_code"), step * (n_levels - level))

    levels: list[DataFrame] = []
    sizes: list[int] = []
    placed: list[DataFrame] = []
    live = items
    for level in range(1, n_levels + 1):
        cells = live.groupBy("root", cell(level).alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("south").alias("south"), F.min("west").alias("west"),
            F.max("north").alias("north"), F.max("east").alias("east"), F.min("s").alias("s_lo"), F.max("s").alias("s_hi"),
        )
        leaf = F.lit(True) if level == n_levels else F.col("n") <= leaf_items
        cells = kept(cells.withColumn("parent", F.shiftright("cell", step)).withColumn("leaf", leaf))
        levels.append(cells)
        n, n_split = cells.agg(F.count(F.lit(1)), F.count_if(~F.col("leaf"))).first()
        sizes.append(n)
        state = _joined_by_size(cells.select("root", "cell", "leaf"), n, SENT_ROWS - BUILD_ROWS)
        tagged = kept(live.withColumn("cell", cell(level)).join(state, ["root", "cell"]))
        placed.append(tagged.where("leaf").drop("leaf", "_code"))
        if not n_split:
            break
        live = tagged.where(~F.col("leaf")).drop("cell", "leaf")
    coded = placed[0]
    for part in placed[1:]:
        coded = coded.unionByName(part)
    return Tree(levels, sizes, coded, items.count())


def drop_copies(items: DataFrame, keep: int, order: str = "pos", flat: bool = False) -> DataFrame:
    """Drop what can never enter a list of length ``keep``: items of a spot (equal in root
    and box) that ``keep`` others there beat by static score, or by ``order`` if that is equal.

    ``flat`` says that a score may not depend on the static score at all: then the first
    ``keep`` of a spot by ``order`` stay too.  Crowded spots are thinned in parts first.
    """
    def thinned(df: DataFrame, spot: list[str]) -> DataFrame:
        keys = ", ".join(spot)
        above = F.expr(f"count(s) OVER (PARTITION BY {keys} ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {SLACK!r}D PRECEDING)")
        able = F.col("_above") < keep
        if flat:
            df = df.withColumn("_first", F.row_number().over(Window.partitionBy(*spot).orderBy(order)))
            able = able | (F.col("_first") <= keep)
        df = df.withColumn("_above", above).withColumn("_rn", F.row_number().over(Window.partitionBy(*spot, "s").orderBy(order)))
        return df.where(able & (F.col("_rn") <= keep)).drop("_above", "_rn", "_first")

    parts = items.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(16)))
    return thinned(thinned(parts, ["root", *BOX, "_part"]).drop("_part"), ["root", *BOX])


def best_k(asks: DataFrame, tree: Tree, score: Callable[[Column, Column], Column], exact: Column,
           bounds: Callable[[Column, Column], tuple[Column, Column]] = sphere_bounds, order: str = "pos") -> DataFrame:
    """The k best items of every request.

    ``asks`` has rid, root, lat, lon, k and whatever the score needs; a request
    may ask several roots.  ``score(s, d)`` must rise with the static score ``s``
    and fall with the distance ``d``; ``exact`` is the score of an item in terms of
    ask columns and item columns (prefixed ``i_``).  Ties go to the smaller ``order``.
    """
    ask_columns = asks.columns
    # small requests make much work: as many tasks as a shuffle has
    asks = asks.repartition(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid")
    keep = ["cell", "leaf", "n", *BOX, "s_lo", "s_hi"]

    def prune(cands: DataFrame) -> DataFrame:
        near, far = bounds(F.col("lat"), F.col("lon"))
        cands = cands.withColumns({"_most": score(F.col("s_hi"), near), "_least": score(F.col("s_lo"), far)})
        by_low = Window.partitionBy("rid").orderBy(F.desc("_least")).rowsBetween(Window.unboundedPreceding, 0)
        cands = cands.withColumn("_have", F.sum("n").over(by_low))
        floor = F.max(F.when(F.col("_have") >= F.col("k"), F.col("_least"))).over(Window.partitionBy("rid"))
        return (
            cands.withColumn("_t", floor).where(F.col("_t").isNull() | (F.col("_most") >= F.col("_t") - SLACK))
            .select(*ask_columns, *keep)
        )

    sent = tree.sizes[0]
    cands = prune(asks.join(_joined_by_size(tree.levels[0].select("root", *keep), sent, 0), "root"))
    for cells, rows in zip(tree.levels[1:], tree.sizes[1:], strict=True):
        child = cells.select(F.col("root").alias("_root"), F.col("parent").alias("_up"), F.struct(*keep).alias("_child"))
        own = F.struct(*keep)
        child, sent = _joined_by_size(child, rows, sent), sent + rows
        joined = cands.join(child, (F.col("root") == F.col("_root")) & (F.col("cell") == F.col("_up")), "left")
        # leaf cells have no children below and stay as they are
        stepped = joined.select(*ask_columns, F.coalesce(F.col("_child"), own).alias("_c")).select(*ask_columns, "_c.*")
        cands = prune(stepped)
    items = tree.items.select("root", "cell", *[F.col(c).alias(f"i_{c}") for c in tree.items.columns if c not in ("root", "cell", "_code")])
    scored = cands.select(*ask_columns, "cell").join(_joined_by_size(items, tree.n_items, sent), ["root", "cell"]).withColumn("score", exact)
    best = Window.partitionBy("rid").orderBy(F.desc("score"), f"i_{order}")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.col("k")).drop("cell")
