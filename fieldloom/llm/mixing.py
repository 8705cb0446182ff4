"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import NOT_SPACE, cut

#: Weights of the sources in their order, repeating; and the slope of each source's weight over the run:
#: its schedule is weight * (1 + tilt * (2t - 1)) for t from 0 (start) to 1 (end of training).
WEIGHTS, TILTS = (3.0, 1.0, 2.0), (0.5, -0.5, 0.0)
SHARE, MOST_REPEATS = 1.5, 2
ROWS_PER_SLICE = 100_000


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(NOT_SPACE), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, share=SHARE, repeats=MOST_REPEATS) -> DataFrame:
    """Adds weight, tilt and target to ``sizes(source, source_size)``, one row per source.

    Water filling: with sources sorted by (most / weight), the first ones stop at ``repeats`` times their
    size and the others share what is left by weight; k is the least number of stopped sources at which none
    of the others is above its most.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("full_at", "rank")
    everything = Window.partitionBy(F.lit(0))

    def pick(values) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))

    t = sizes.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    t = t.withColumn("weight", pick(weights)).withColumn("tilt", pick(tilts))
    t = t.withColumn("most", F.col("source_size") * float(repeats)).withColumn("full_at", F.col("most") / F.col("weight"))
    t = t.withColumn("total", F.sum("source_size").over(everything) * float(share))
    earlier = ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("stopped", F.coalesce(F.sum("most").over(earlier), F.lit(0.0)))
    t = t.withColumn("open_weight", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("rate", F.when((F.col("total") - F.col("stopped")) / F.col("open_weight") <= F.col("full_at"), (F.col("total") - F.col("stopped")) / F.col("open_weight")))
    t = t.withColumn("level", F.first("rate", ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", "weight", "tilt", F.when(F.col("level") <= F.col("full_at"), F.col("level") * F.col("weight")).otherwise(F.col("most")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", share: float = SHARE, weights=WEIGHTS, tilts=TILTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per document: doc_id, text_key, source, size, source_size, target, taken, copies.

    ``copies`` holds a struct (position, words, place) for each time the mix takes the document: ``position`` is where
    it is due, in words of the whole mix; ``words`` is its size, as copies are taken whole; ``place`` is its number in the
    run, from 0, which a range sort of all copies by position gives (see ``placed``). The one copy of a
    source at which the target is met is taken if that ends nearer to the target than leaving it out, so a source
    misses its target by half a document at most. Sizes are words between white space; null or empty texts
    have none and are never taken. Null sources are one source, the last; null or repeated ids are documents
    of their own. An empty table gives no rows; other columns are not read.

    Documents of a source come in the order of MD5(seed:doc_id:size), once around and then again. A copy that
    begins after c words of its source's target T is due at the t at which the schedule's integral
    (1-a)t + at^2 reaches c/T: t = 2u / ((1-a) + sqrt((1-a)^2 + 4au)). Its position is the integral of all
    sources' demand up to t. Running totals are made within slices of a source and then over the slices, so
    no source lies in one task.
    """
    meta = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
    )
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    meta = cut(meta.withColumn("place", place), "sizes")
    slices = max(1, math.ceil(meta.count() / ROWS_PER_SLICE))
    part = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / 2.0**32 * slices).cast("long")
    meta = meta.withColumn("slice", part).withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))

    by_slice = meta.groupBy("name", "source", "slice").agg(F.sum("size").alias("words"))
    sizes = by_slice.groupBy("name", "source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, tilts, share, repeats)
    targets = targets.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    targets = targets.withColumn("all", F.sum("target").over(Window.partitionBy(F.lit(0)))).withColumn(
        "all_tilted", F.sum(F.col("target") * F.col("tilt")).over(Window.partitionBy(F.lit(0)))
    )
    before = Window.partitionBy("name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select("name", "slice", F.coalesce(F.sum("words").over(before), F.lit(0).cast("long")).alias("earlier"))
    offsets = offsets.join(targets, "name")

    inside = Window.partitionBy("name", "slice").orderBy("place", F.col("doc_id").asc_nulls_last(), "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = meta.join(offsets, ["name", "slice"])
    rows = rows.withColumn("start", F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))

    def words_of(k: Column) -> Column:
        left = F.col("target") - (F.col("start") + k * F.col("source_size"))
        return F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))

    def position(k: Column) -> Column:
        u = F.least(F.try_divide(F.col("start") + k * F.col("source_size"), F.col("target")), F.lit(1.0))
        a = F.col("tilt")
        t = 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))
        return F.col("all") * t + F.col("all_tilted") * (t * t - t)

    rounds = F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(repeats) - 1).cast("long"))
    copies = F.filter(F.transform(rounds, lambda k: F.struct(position(k).alias("position"), words_of(k).alias("words"))), lambda c: c["words"] > 0)
    taken = F.aggregate(F.transform(rounds, words_of), F.lit(0).cast("long"), lambda a, w: a + w)
    return placed(rows.select(
        "doc_id", "text_key", "source", "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, copies).otherwise(F.array().cast("array<struct<position:double,words:bigint>>")).alias("copies")
    ))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with the place of each copy in the run: copies are range-sorted by position and numbered.

    Equal positions go by source, document and text. A copy's number is its row in its range and the rows of the
    ranges before, so no window runs over the copies; texts take no part.
    """
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "mixed")
    line = rows.select("_row", "source", "doc_id", "text_key", F.posexplode("copies").alias("_nth", "_copy"))
    line = line.sort("_copy.position", "source", "doc_id", "text_key", "_nth", "_row").select("_row", "_nth", "_copy", F.monotonically_increasing_id().alias("_at"))
    line = cut(line, "run").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = line.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("_start"))
    numbered = line.join(F.broadcast(starts), "_range").withColumn("_place", F.col("_start") + F.col("_at") - F.shiftleft("_range", 33))
    copy = F.struct("_nth", F.col("_copy.position").alias("position"), F.col("_copy.words").alias("words"), F.col("_place").alias("place"))
    lists = numbered.groupBy("_row").agg(F.array_sort(F.collect_list(copy)).alias("_run"))
    run = F.transform(F.coalesce("_run", F.array().cast(lists.schema["_run"].dataType)), lambda c: F.struct(c["position"].alias("position"), c["words"].alias("words"), c["place"].alias("place")))
    return rows.join(lists, "_row", "left").withColumn("copies", run).drop("_row", "_run")


def training_order(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents in the order of training: every copy that ``mix`` takes, range-sorted by its place.

    All columns of ``docs`` are kept as they are. Rows repeated with the same id and text each count once for each
    of their own rows.
    """
    columns = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("k"), F.col("source").cast("string").alias("s"))
    same = Window.partitionBy("d", "k", "s")
    left = left.withColumn("nth", F.row_number().over(same.orderBy("k")))
    right = mixed.withColumn("nth2", F.row_number().over(Window.partitionBy("doc_id", "text_key", "source").orderBy(F.desc("taken"))))
    right = right.where("taken > 0").select("doc_id", "text_key", F.col("source").alias("s2"), "nth2", F.explode("copies").alias("copy"))
    on = left["d"].eqNullSafe(right["doc_id"]) & (left["k"] == right["text_key"]) & left["s"].eqNullSafe(right["s2"]) & (left["nth"] == right["nth2"])
    both = left.join(right, on)
    return both.sort(F.col("copy.place")).select(*[F.col("row").getField(c).alias(c) for c in columns])
