"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a random key, the MD5 of a seed and its doc_id. Keys are uniform, so their leading
hex digits cut each source into ranges of equal size without sampling: a range is a window partition, a
running sum inside it is added to the sum of the ranges before it (summed in groups of ranges, then inside
a group), which is the prefix sum over the whole source in key order. Only the table of sources, one row
each, is ordered as a whole. A source's budget is whole epochs plus a rest; documents before
the rest's cut are taken once more, and the one that holds the cut is taken in part (``cut="word"``) or
to the nearer side (``cut="document"``).

Inputs: a null text has no words; a null source is a source of its own, after all others; a null doc_id
has a key of its own and, like rows that repeat a doc_id, is ordered by size and text digest (rows equal
in all of these are alike); sources without words have a target of 0; an empty table gives no rows; other
columns are ignored by :func:`shares` and kept by :func:`mixture`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.common import saved, shared_folder, small

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
#: Documents of a source that one window partition should hold.
RANGE_ROWS = 2_000
#: Digits of a range that stand for its place in a group of ranges.
GROUP_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space."""
    trimmed = F.btrim(text, F.lit("\t\n\x0b\f\r "))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def _sources(sized: DataFrame) -> DataFrame:
    """source, source_size, documents, target: weights by code point order, capped and reshared.

    Targets are min(cap, w * t) for the level t that spends the whole share. Sources by cap / w in rising
    order are capped first; t follows from the sums before and after, so nothing is iterated.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    k = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weighted = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (k + 1).cast("int")).cast("double"))
    everything = Window.partitionBy()
    caps = weighted.withColumns({"cap": (F.col("source_size") * MOST_EPOCHS).cast("double"), "share": F.sum("source_size").over(everything) * F.lit(SHARE_PERCENT / 100)})
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("share") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = caps.withColumn("level", level).withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    level_all = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    first_open = levels.withColumn("t", level_all)
    target = F.when(F.col("t").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("t")))
    return first_open.select("source", "source_size", "documents", target.alias("target"))


def _keyed(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    tie = F.coalesce(F.xxhash64(text), F.lit(0))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), tie.cast("string")))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), key.alias("key"), tie.alias("tie"), *more)


def shares(docs: DataFrame, seed: str = "mix", cut: str = "word") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row a document."""
    folder = shared_folder(docs.sparkSession)
    sized = saved(_keyed(docs, seed), folder, "sized")  # texts are read once
    return _shares(sized, sized, cut, folder).select("doc_id", "size", "source_size", "target", "taken")


def _shares(sized: DataFrame, rows: DataFrame, cut: str, folder: str) -> DataFrame:
    """``rows`` (the columns of ``sized`` and any others) with source_size, target and taken."""
    if cut not in ("word", "document"):
        raise ValueError("cut is word or document")
    sources = saved(_sources(sized), folder, "sources")
    # Ranges a source: a power of 16 that leaves about RANGE_ROWS documents in each.
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("documents") / RANGE_ROWS)))).cast("int")
    planned = small(sources.select(F.col("source").alias("planned"), "source_size", "target", digits.alias("digits")), 128, "planned")

    def placed(table: DataFrame) -> DataFrame:
        return table.join(planned, F.col("source").eqNullSafe(F.col("planned"))).withColumn("range", F.expr("substring(key, 1, digits)"))

    # Sums of earlier ranges in two steps, so that no task holds all ranges of a source: whole groups first, then inside the group.
    group = F.expr(f"substring(range, 1, greatest(0, digits - {GROUP_DIGITS}))")
    sums = saved(placed(sized).groupBy("planned", "range", "digits").agg(F.sum("size").alias("range_size")).withColumn("group", group), folder, "ranges")
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy(F.col("planned").alias("g_source"), F.col("group").alias("g_group")).agg(F.sum("range_size").alias("group_size"))
    groups = groups.withColumn("g_offset", F.coalesce(F.sum("group_size").over(earlier("g_source", "g_group")), F.lit(0)))
    inner = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier("planned", "group", "range")), F.lit(0)))
    both = inner.join(groups, F.col("planned").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g_group")))
    offsets = saved(both.select(F.col("planned").alias("o_source"), F.col("range").alias("o_range"), (F.col("offset") + F.col("g_offset")).alias("offset")), folder, "offsets")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed(rows).withColumn("upto", F.sum("size").over(inside))
    whole = running.join(small(offsets, 64, "o_source", "o_range"), F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    before = F.col("offset") + F.col("upto") - F.col("size")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    left = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    part = left if cut == "word" else F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    return whole.withColumn("taken", (epochs * F.col("size") + part).cast("long"))


def mixture(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed rows themselves, whole documents: a document taken twice is two rows, one not taken is none.

    Documents without words take part in no budget and stay once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    folder = shared_folder(docs.sparkSession)
    taken = _shares(saved(_keyed(docs, seed), folder, "sized"), _keyed(docs, seed, row), "document", folder)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size"))).cast("int")
    return taken.withColumn("__copies", copies).where("__copies > 0").select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select("__row.*")
