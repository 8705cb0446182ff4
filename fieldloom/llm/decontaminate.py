"""Benchmark decontamination: a prefix-filtered set join between documents and item-sized windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, words

WINDOW, SHINGLE = 10, 3


def _shingles(w: str, size: Column | int) -> Column:
    """All runs of ``size`` words of the array column ``w`` as structs (pos, gram)."""
    last = F.size(w) - size
    runs = F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i + 1, size), " ").alias("gram")),
    )
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows with their shingles and items: wid, len, need, grams (pos, gram), items.

    An item shorter than a window is one window; one without words has none. A window of fewer words than a
    shingle is one shingle.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("len"))
    each = items.select("item", "len", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.col("len")))).alias("w"))
    each = each.groupBy("w", "len").agg(F.collect_set("item").alias("items"))
    each = each.withColumn("wid", F.array_join("w", " ")).withColumn("size", F.least("len", F.lit(shingle)))
    return each.select("wid", "len", "size", "items", _shingles("w", F.col("size")).alias("grams"))


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, items (sorted ids as strings).

    Words are lower-cased A-Z, digits and all beyond ASCII. A document word is hit if it lies inside an
    occurrence of a window of consecutive item words. Null or empty texts have no words; ids may be null or
    repeated (rows are never merged); items with null ids count as hits and are not listed; empty tables give
    no rows, or rows without hits; other columns are not read.

    1. Shingles of all documents meet the benchmark's; what matches is written with its place.
    2. Rarity is the number of those occurrences. Containment of the whole window needs every shingle, so
       the prefix of a window is its rarest one; windows with a shingle that never occurs fall out.
    3. An occurrence of the prefix gives the only place its window can have; places before the text's first
       word or beyond its last are dropped.
    4. A place is a hit if all the window's shingles, compared as strings, stand there one after another.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    windows = cut(item_windows(benchmark, window, shingle), "windows")
    wanted = cut(windows.select("size", F.explode("grams.gram").alias("gram")).distinct(), "grams")
    sizes = [r[0] for r in wanted.select("size").distinct().collect()]  # at most ``shingle`` numbers
    counted = texts.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"))
    grams = None
    for size in sizes or [shingle]:
        part = texts.select("doc_id", "text_key", F.size("w").alias("n_words"), F.explode(_shingles("w", F.lit(size))).alias("g"))
        part = part.select("doc_id", "text_key", "n_words", "g.pos", "g.gram", F.lit(size).alias("size"))
        grams = part if grams is None else grams.union(part)
    seen = cut(grams.join(wanted, ["gram", "size"]).select("doc_id", "text_key", "n_words", "pos", "gram"), "occurrences")

    rarity = seen.groupBy("gram").agg(F.count("*").alias("often"))
    parts = windows.select("wid", "len", F.size("grams").alias("need"), F.explode("grams").alias("g")).select("wid", "len", "need", "g.pos", "g.gram")
    ranked = parts.join(rarity, "gram")
    prefix = ranked.groupBy("wid", "len", "need").agg(
        F.min(F.struct("often", "gram", "pos")).alias("rarest"), F.countDistinct("pos").alias("present")
    ).where("present = need")
    prefix = prefix.select("wid", "len", "need", "rarest.gram", F.col("rarest.pos").alias("offset"))
    places = (
        seen.join(prefix, "gram")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
        .select("doc_id", "text_key", "wid", "len", "need", "start")
    )
    checks = places.join(windows.select("wid", "grams"), "wid").select("doc_id", "text_key", "wid", "len", "need", "start", F.explode("grams").alias("g"))
    checks = checks.select("doc_id", "text_key", "wid", "len", "need", "start", (F.col("start") + F.col("g.pos")).alias("pos"), "g.gram").distinct()
    held = seen.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("pos").alias("p"), F.col("gram").alias("g")).distinct()
    there = checks["doc_id"].eqNullSafe(held["d"]) & (checks["text_key"] == held["k"]) & (checks["pos"] == held["p"]) & (checks["gram"] == held["g"])
    sure = (
        checks
        .join(held, there)
        .groupBy("doc_id", "text_key", "wid", "len", "need", "start")
        .agg(F.count("*").alias("present"))
        .where("present = need")
    )
    hits = cut(sure, "hits")
    covered = hits.select("doc_id", "text_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
    covered = covered.groupBy("doc_id", "text_key").agg(F.count("*").alias("n_hit"))
    named = hits.select("doc_id", "text_key", "wid").distinct().join(windows.select("wid", F.explode("items").alias("item")), "wid")
    named = named.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = covered.join(named.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k")
    found = found.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    out = counted.join(found, counted["doc_id"].eqNullSafe(found["d"]) & (counted["text_key"] == found["k"]), "left")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
