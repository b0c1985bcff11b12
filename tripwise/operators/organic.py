"""Self-chosen destinations: one place per request, drawn in proportion to
exp(-distance / scale) over all places of the subtype.

The place of the largest -distance / scale + G, with a standard Gumbel number G per
request and place, is such a draw.  The numbers aren't drawn place by place: the largest of
a cell's n numbers is a Gumbel number at ln n, drawn by a key of (request, cell).  Among a
cell's parts one, chosen by the counts, holds the cell's largest number; the others' largest are
drawn below it.  So a request walks down a tree of cells, knowing of each cell the number of its
best place and the range of its distances.  Cells that can't reach what another cell surely
has are dropped; what is left is a few cells per level however many places there are.

All numbers are functions of keys, so the draw is the same on any cluster, and SQL that
works out all cells for all requests gives the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions import hash_uniform, haversine_km, let
from tripwise.functions.draws import hash_word
from tripwise.operators.boxtree import BOX, SLACK, sphere_bounds
from tripwise.operators.catalog import pois_by_subtype
from tripwise.operators.population import _indexed
from tripwise.session import kept

#: Hexadecimal digits of a place's key: of its position (two bits of each coordinate a digit,
#: 19 m in the end) and of its id's md5, which tell places of one spot apart.
SPOT_DIGITS, ID_DIGITS = 10, 12
DIGITS = SPOT_DIGITS + ID_DIGITS


def place_key(lat: Column, lon: Column, place_id: Column) -> Column:
    """Digits of the cells that hold a place, from the whole earth down to the place itself."""
    top = 1 << (2 * SPOT_DIGITS)

    def grid(x: Column, span: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(top - 1), F.floor((x + span / 2) / span * top))).cast("bigint")

    y, x = grid(lat, 180.0), grid(lon, 360.0)
    digits = [F.hex(F.shiftright(y, s).bitwiseAND(F.lit(3)) * 4 + F.shiftright(x, s).bitwiseAND(F.lit(3))) for s in range(2 * SPOT_DIGITS - 2, -2, -2)]
    return F.concat(*digits, F.upper(F.substring(F.md5(place_id.cast("string")), 1, ID_DIGITS)))


def _open_uniform(*parts: Column | str) -> Column:
    """Uniform number in (0, 1) keyed by the parts."""
    return (hash_word(*parts).cast("double") + 0.5) / F.lit(4294967296.0)


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two keys."""
    at = F.array_position(F.transform(F.sequence(F.lit(1), F.lit(DIGITS)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), True)
    return F.when(at > 0, at.cast("int") - 1).otherwise(F.lit(DIGITS))


def cell_tree(items: DataFrame) -> DataFrame:
    """(root, node, parts): the parts of every cell that has several.

    ``items``: root, key, lat, lon.  A part is the cell of one more digit; its ``node`` is the
    smallest cell that holds the same places, so chains of cells with a single part take no
    step.  One shuffle by cell, combined before it, and one by node, at most 16 parts a row.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(DIGITS)), lambda i: F.substr("key", F.lit(1), i))
    cells = items.select("root", "key", "lat", "lon", F.explode(prefixes).alias("cell")).groupBy("root", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"),
        F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
    cells = cells.withColumn("node", F.substr("lo", F.lit(1), _common(F.col("lo"), F.col("hi"))))
    up = F.when(F.col("cell") == "", F.lit(None)).otherwise(F.substr("cell", F.lit(1), F.length("cell") - 1))
    parts = cells.groupBy("root", up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("cell", "node", "n", *BOX))).alias("parts"))
    # the earth itself is the only part of nothing: the entry of a root
    return parts.where("up is null or size(parts) > 1")


def _split(parts: Column, n: Column, m: Column, rid: Column, node: Column, salt: str) -> Column:
    """Parts of a cell with their largest numbers, m being the cell's own."""
    place = F.floor(_open_uniform(rid, node, salt, "part") * n)
    before = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit("").alias("won")), lambda a, x: F.struct(
        (a["sum"] + x["n"]).alias("sum"), F.when((place >= a["sum"]) & (place < a["sum"] + x["n"]), x["cell"]).otherwise(a["won"]).alias("won")))
    return let(F.struct(parts.alias("parts"), before["won"].alias("won"), m.alias("m")), lambda g: F.transform(g["parts"], lambda x: F.struct(
        x.alias("part"), F.when(x["cell"] == g["won"], g["m"]).otherwise(
            -F.log(F.exp(-g["m"]) - F.log(_open_uniform(rid, x["cell"], salt, "largest")) / x["n"])).alias("m"))))


def _walk(asks: DataFrame, tree: DataFrame, scale: float | None, salt: str) -> DataFrame:
    """(rid, root, key, m): the winning place's key for every request whose root has places.

    Each round opens all cells that can still win, one more level of the tree; the number of
    rounds is the tree's depth.  Without a scale distances don't count."""
    rid = F.col("rid").cast("string")

    def pruned(rows: DataFrame) -> DataFrame:
        near, far = sphere_bounds(F.col("lat"), F.col("lon")) if scale is not None else (F.lit(0.0), F.lit(0.0))
        rows = rows.withColumns({"_most": F.col("m") - near / (scale or 1.0), "_least": F.col("m") - far / (scale or 1.0)})
        sure = F.max("_least").over(Window.partitionBy("rid"))
        return rows.withColumn("_sure", sure).where(F.col("_most") >= F.col("_sure") - SLACK).drop("_sure", "_most", "_least")

    entry = tree.where("up is null").select("root", F.col("parts")[0].alias("p"))
    first = -F.log(-F.log(_open_uniform(rid, "", salt, "first"))) + F.log(F.col("p.n"))
    rows = kept(pruned(asks.join(entry, "root").select("rid", "root", "lat", "lon", "p.node", "p.n", *[f"p.{b}" for b in BOX], first.alias("m"))))
    inner = tree.where("up is not null").select(F.col("root").alias("_root"), F.col("up").alias("_up"), "parts")
    while not rows.where("n > 1").isEmpty():
        opened = rows.where("n > 1").join(inner, (F.col("root") == F.col("_root")) & (F.col("node") == F.col("_up")))
        split = _split(F.col("parts"), F.col("n"), F.col("m"), rid, F.col("node"), salt)
        opened = opened.select("rid", "root", "lat", "lon", F.explode(split).alias("x"))
        opened = opened.select("rid", "root", "lat", "lon", "x.part.node", "x.part.n", *[f"x.part.{b}" for b in BOX], "x.m")
        rows = kept(pruned(opened.unionByName(rows.where("n = 1"))))
    d = F.lit(0.0) if scale is None else haversine_km(F.col("lat"), F.col("lon"), F.col("south"), F.col("west")) / scale
    return rows.groupBy("rid").agg(F.max_by(F.struct("root", F.col("node").alias("key"), d.alias("far")), F.col("m") - d).alias("w")).select("rid", "w.*")


def organic_choice(requests: DataFrame, places: DataFrame, nodes: DataFrame, scale: float = P.ORGANIC_SCALE_KM,
                   salt: str = "organic") -> DataFrame:
    """One destination per request (rid, subtype, lat, lon).  Without any place of the
    subtype it is a random base node and ``place_id`` is null.  Where even the winner is so far that
    its weight vanishes, the choice is uniform.  Places without id or position are left out, and a
    place given twice at one spot counts once.  Jobs run while the result is built."""
    candidates = pois_by_subtype(places)
    items = candidates.select(F.col("subtype").alias("root"), place_key(F.col("lat"), F.col("lon"), F.col("place_id")).alias("key"), "place_id", "lat", "lon")
    items = items.where("key is not null").dropDuplicates(["root", "key"])
    tree = kept(cell_tree(items))
    asks = requests.select("rid", F.col("subtype").alias("root"), "lat", "lon")
    found = kept(_walk(asks, tree, scale, salt))
    vanished = F.exp(-F.col("far")) == 0.0
    far = found.where(vanished).select("rid")
    if not far.isEmpty():
        found = found.where(~vanished).unionByName(_walk(asks.join(far, "rid", "left_semi"), tree, None, salt))
    spots = items.select("root", "key", "place_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    out = found.join(spots, ["root", "key"]).select("rid", "place_id", "p_lat", "p_lon")
    base = _indexed(nodes.where("is_base"), F.col("node_id").cast("string"), "_i", f"{salt}-nodes")
    n = base.agg(F.count(F.lit(1))).scalar()
    orphan = requests.join(tree.select(F.col("root").alias("subtype")).distinct(), "subtype", "left_anti")
    lost = orphan.select("rid", F.floor(hash_uniform(F.col("rid").cast("string"), f"{salt}-node") * n).alias("_i")).join(
        base.select("_i", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "_i")
    return out.unionByName(lost.select("rid", F.lit(None).cast(places.schema["place_id"].dataType).alias("place_id"), "p_lat", "p_lon"))


def organic_weight(lat: Column, lon: Column, p_lat: Column, p_lon: Column, scale: float = P.ORGANIC_SCALE_KM) -> Column:
    """Weight of a place for an origin."""
    return let(haversine_km(lat, lon, p_lat, p_lon), lambda d: F.exp(-d / scale))
