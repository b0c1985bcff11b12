"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every w consecutive k-grams (the leftmost of
equal ones).  A shared span of t = w + k - 1 words has the same w k-grams on both sides and
so the same smallest one at the same offset: joining the fingerprints finds every shared
span of at least t words, and tells its diagonal (document position - item position).  Each
diagonal is then extended: all windows of the item are compared word by word with the
document's words on that diagonal, so hash collisions never count.  Fingerprints of a small
benchmark are sent to all tasks and looked up for every k-gram of a document: that finds the
documents' own fingerprints among others, and costs less than choosing them.

Items shorter than the window are a window of their own; their lengths t < 13 are
winnowed with their own k and w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise.llm.common import ascii_lower, shielded, stored, text_key
from tripwise.session import scratch_path

#: Fixed value: ASCII characters that separate words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a benchmark up to which its fingerprints are sent to all tasks.
SENT_WORDS = 200_000


def words_of(lowered: Column) -> Column:
    """Words of a lower-cased text; null has none."""
    parts = F.split(F.coalesce(lowered, F.lit("")), SEPARATORS)
    return F.filter(parts, lambda p: p != "")


def n_words(text: Column) -> Column:
    """Number of words; capitals count as their small letters do."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_words``; each step is a projection of its own, so nothing is worked out twice."""
    return df.withColumn("_low", F.col(text)).withColumn("_low", ascii_lower(F.col("_low"))).withColumn("_words", words_of(F.col("_low"))).drop("_low")


def gram_sizes(t: int) -> tuple[int, int]:
    """k and w for a guarantee of t words."""
    k = 5 if t >= 13 else (t + 1) // 2
    return k, t - k + 1


def with_grams(df: DataFrame, t: int) -> DataFrame:
    """Adds ``_grams``, the hashes of all k-grams of ``_words``; rows of fewer than t words go."""
    k, _ = gram_sizes(t)
    n = F.size("_words")
    return df.where(n >= t).withColumn("_grams", F.transform(
        F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.lit(t), *[F.get("_words", i + j) for j in range(k)])))


def every_gram(df: DataFrame, t: int, at: str) -> DataFrame:
    """Rows (all other columns, ``at``, hash): all k-grams of ``_words``.

    No array is empty.  With ``posexplode`` the optimizer would ask for that in a filter below, which
    splits the text anew for every word of every k-gram."""
    return with_grams(df, t).select(*[c for c in df.columns if c != "_words"], F.posexplode_outer("_grams").alias(at, "hash"))


def fingerprints(df: DataFrame, t: int, at: str) -> DataFrame:
    """Rows (all other columns, hash, ``at``): the winnowed k-grams of ``_words``."""
    k, w = gram_sizes(t)
    grams = with_grams(df, t)

    def leftmost(j: Column) -> Column:
        part = F.slice("_grams", j, w)
        return (j + F.array_position(part, F.array_min(part)) - 1).cast("int")

    picked = grams.withColumn("_at", F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_grams") - (w - 1)), leftmost)))
    kept = [c for c in df.columns if c != "_words"]
    return picked.select(
        *kept, F.explode(F.transform("_at", lambda i: F.struct((i - 1).alias("i"), F.get("_grams", i - 1).alias("h")))).alias("_f")
    ).select(*kept, F.col("_f.h").alias("hash"), F.col("_f.i").alias(at))


def covered(starts: Column) -> Column:
    """Number of positions under the windows (structs p, size), sorted by p."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["p"] + s["size"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["p"] + s["size"] - F.greatest(acc["end"], s["p"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated.

    A document word is hit when it lies in an occurrence of a window of an item: ``window``
    consecutive words, or the whole item if that has fewer (but not none).  Contaminated:
    some word is hit and ``share`` * n_hit >= n_words.  Null and empty texts have no words
    and no hits; an empty benchmark hits nothing; a null item_id is found but not listed in
    item_ids; repeated rows and repeated doc_ids are judged by their own text.  Other
    columns are ignored here; ``clean_documents`` keeps them.
    """
    judged = judge(docs.select("doc_id", "text"), items, window)
    ids = F.sort_array(F.coalesce("_ids", F.array().cast("array<string>")))
    hit = F.coalesce("_hit", F.lit(0).cast("bigint"))
    return judged.select(
        "doc_id", F.col("_n").cast("bigint").alias("n_words"), hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        ids.alias("item_ids"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("_n"))).alias("contaminated"),
    )


@shielded("_n", "_hit", "_ids", "_k1", "_k2")
def clean_documents(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they are."""
    hit = F.coalesce("_hit", F.lit(0).cast("bigint"))
    judged = judge(docs, items, window).where(~((hit > 0) & (hit * share >= F.col("_n"))))
    return judged.select(*docs.columns)


def judge(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with _n (words), _hit (hit words, null for none) and _ids (items as text)."""
    spark = docs.sparkSession
    item_words = with_words(items.select(F.col("item_id"), "text")).drop("text").where(F.size("_words") > 0)
    # one row per different word sequence: equal items share their windows
    item_words = item_words.groupBy("_words").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    item_words = item_words.withColumn("item", F.xxhash64(F.lit(3), "_words"))
    path = scratch_path(spark, "items")
    item_words.write.parquet(path)
    item_words = spark.read.parquet(path)
    told = item_words.groupBy(F.least(F.size("_words"), F.lit(window)).alias("t")).agg(F.sum(F.size("_words"))).collect()
    sizes, small = [r[0] for r in told], sum(r[1] for r in told) <= SENT_WORDS
    keyed = docs.select("text").select("text", *text_key(F.coalesce("text", F.lit(""))))
    spoken = with_words(keyed).drop("text")
    diagonals = None
    for t in sorted(sizes):
        left = every_gram(spoken, t, "i") if small else fingerprints(spoken, t, "i")
        own = item_words.where(F.size("_words") == t) if t < window else item_words.where(F.size("_words") >= t)
        right = fingerprints(own.withColumn("m", F.size("_words")).select("item", "m", "_words"), t, "j")
        found = left.join(F.broadcast(right) if small else right, "hash").select("k1", "k2", "item", (F.col("i") - F.col("j")).alias("d"), "m")
        diagonals = found if diagonals is None else diagonals.unionByName(found)
    if diagonals is None:
        return docs.withColumns({
            "_n": n_words(F.col("text")), "_hit": F.lit(None).cast("bigint"), "_ids": F.lit(None).cast("array<string>")})
    lines = stored(diagonals.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "d", "m")).alias("lines")), "diagonals")
    # texts travel to their diagonals as texts: as word arrays they are several times larger
    suspects = with_words(keyed.join(lines, ["k1", "k2"]))
    parts = suspects.select(
        "k1", "k2", F.explode(F.transform("lines", lambda x: F.struct(
            x["item"].alias("item"), F.greatest(x["d"], F.lit(0)).alias("from"), F.greatest(-x["d"], F.lit(0)).alias("skip"),
            F.slice("_words", F.greatest(x["d"], F.lit(0)) + 1, x["m"]).alias("said"),
        ))).alias("p"),
    ).select("k1", "k2", "p.*")
    return _extended(docs, parts, item_words, window)


def _extended(docs: DataFrame, parts: DataFrame, item_words: DataFrame, window: int) -> DataFrame:
    """Compare the windows along each diagonal and count what they cover per text."""
    both = parts.join(item_words, "item").withColumn("_own", F.slice("_words", F.col("skip") + 1, F.size("_words")))
    size = F.least(F.size("_words"), F.lit(window))
    last = F.least(F.size("said"), F.size("_own")) - size
    starts = F.when(last >= 0, F.filter(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda s: F.slice("said", s + 1, size) == F.slice("_own", s + 1, size)))
    hits = both.withColumn("size", size).withColumn("_s", starts).where(F.size("_s") > 0)
    hits = hits.select("k1", "k2", "ids", F.transform("_s", lambda s: F.struct((s + F.col("from")).alias("p"), F.col("size").alias("size"))).alias("_s"))
    per_text = hits.groupBy("k1", "k2").agg(
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("_ids"),
        covered(F.sort_array(F.array_distinct(F.flatten(F.collect_set("_s"))))).alias("_hit"),
    )
    counted = docs.withColumn("_n", n_words(F.col("text")))
    counted = counted.withColumns(dict(zip(("_k1", "_k2"), text_key(F.coalesce("text", F.lit(""))), strict=True)))
    per_text = stored(per_text, "hits").withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    return counted.join(per_text, ["_k1", "_k2"], "left").drop("_k1", "_k2")
