"""Exact de-duplication against an immutable snapshot, screened by static binary-fuse filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACE, cut, new_folder

KEYS_PER_FILTER = 1 << 16
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and seed."""
    h = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & int(MASK))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def slots(h: np.ndarray, segment: int, spread: int) -> np.ndarray:
    """The three slots of each hash, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(spread)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, spread and bytes of a binary-fuse filter over distinct 64-bit keys.

    All slots that hold one key only are peeled at once, round by round; the rounds are then filled backwards.
    """
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    count = max(1, math.ceil(n * factor / segment) - 2)
    spread, size = count * segment, (count + 2) * segment
    for seed in range(1, 200):
        h = mixed(keys, seed)
        at = slots(h, segment, spread)
        degree = np.bincount(at.ravel(), minlength=size)
        holder = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(holder, row, np.arange(n))
        rounds, left, single = [], n, np.flatnonzero(degree == 1)
        while len(single):
            key, which = np.unique(holder[single], return_index=True)
            rounds.append((key, single[which]))
            left -= len(key)
            touched = at[:, key]
            np.subtract.at(degree, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(holder, row, key)
            touched = np.unique(touched)
            single = touched[degree[touched] == 1]
        if left == 0:
            table = np.zeros(size, np.uint8)
            own = prints(h)
            for key, slot in reversed(rounds):
                table[slot] = 0
                table[slot] = own[key] ^ table[at[0, key]] ^ table[at[1, key]] ^ table[at[2, key]]
            return seed, segment, spread, table.tobytes()
        segment_grown = size // segment + 1  # a stubborn set of keys gets one more segment
        spread, size = (segment_grown - 2) * segment, segment_grown * segment
    raise ValueError("keys of a filter must be distinct")


def maybe_held(keys: np.ndarray, seed: int, segment: int, spread: int, table: bytes) -> np.ndarray:
    """False where a key is surely absent; true for every key that was put in."""
    h = mixed(keys, seed)
    a, b, c = slots(h, segment, spread)
    t = np.frombuffer(table, np.uint8)
    return (t[a] ^ t[b] ^ t[c]) == prints(h)


@dataclass(frozen=True)
class Snapshot:
    """Immutable: ``classes`` (bucket, key, digest, keep_id, n, text) and ``filters``, one per bucket."""

    classes: DataFrame
    filters: DataFrame
    buckets: int


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, text with white space runs as one space (null: empty), its SHA-256 and a 64-bit key of that."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " ")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    out = out.withColumn("digest", F.sha2("text", 256))
    return out.withColumn("key", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))


def take_snapshot(rows: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> Snapshot:
    """Write the distinct texts of ``rows`` (as of ``normalised``) by bucket, and a filter for each bucket."""
    spark = rows.sparkSession
    groups = rows.groupBy("digest", "key").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("n"), F.first("text").alias("text")
    )
    buckets = max(1, math.ceil(rows.select("digest").agg(F.approx_count_distinct("digest")).first()[0] / keys_per_filter))
    classes = cut(groups.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets))), "snapshot-classes")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        seed, segment, spread, table = build_filter(np.unique(part["key"].to_numpy()))
        return pd.DataFrame({"bucket": [part["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "spread": [spread], "bits": [table]})

    filters = classes.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket long, seed long, segment long, spread long, bits binary")
    folder = new_folder(spark, "snapshot-filters")
    filters.write.parquet(folder)
    return Snapshot(classes, spark.read.schema(filters.schema).parquet(folder), buckets)


def screened(groups: DataFrame, snapshot: Snapshot, keys_per_task: int = 4 * KEYS_PER_FILTER) -> DataFrame:
    """Adds ``maybe`` to ``groups(key, ...)``: false means that the snapshot surely lacks the key.

    A filter meets at most about ``keys_per_task`` keys at a time; larger batches are salted.
    """
    n = groups.count()
    salts = max(1, math.ceil(n / snapshot.buckets / keys_per_task))
    left = groups.withColumn("bucket", F.pmod(F.col("key"), F.lit(snapshot.buckets)))
    left = left.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    right = snapshot.filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields)

    def look(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if theirs.empty:
            return mine.assign(maybe=False)
        f = theirs.iloc[0]
        return mine.assign(maybe=maybe_held(mine["key"].to_numpy(), int(f["seed"]), int(f["segment"]), int(f["spread"]), f["bits"]))

    return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInPandas(look, fields + ", maybe boolean")


def exact_duplicates(snapshot_docs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Groups of equal texts over a snapshot and a new batch: one row per input row.

    Columns doc_id, keep_id, group_size, kept, text_sha256, in_snapshot (the group has a row in the snapshot).
    Equal: the same bytes after each white space run became one space; null counts as empty, so null and
    empty texts form one group. The smallest doc_id stays, null ids last; of rows repeated with the same id
    one stays. Empty tables give no rows; other columns are not read. The new batch is grouped by digest by
    itself; the snapshot's filters drop groups it cannot hold; the others are joined to the exact buckets
    and compared byte for byte.
    """
    old, new = normalised(snapshot_docs), normalised(incoming)
    snapshot = take_snapshot(old)
    groups = cut(new.groupBy("digest", "key").agg(F.min("doc_id").alias("low"), F.count("*").alias("more")), "batch-groups")
    positive = screened(groups, snapshot).where("maybe").select("digest", "bucket", "low", "more")
    theirs = snapshot.classes.select("bucket", "digest", "keep_id", "n", F.col("text").alias("held"))
    likely = positive.join(theirs, ["bucket", "digest"])
    texts = new.select("digest", "text").join(likely.select("digest"), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
    same = cut(
        likely.join(texts, "digest")
        .where(F.col("text").cast("binary") == F.col("held").cast("binary"))
        .select("digest", F.least("keep_id", "low").alias("keep"), (F.col("n") + F.col("more")).alias("size")),
        "same-bytes",
    )

    def settled(side: DataFrame, fresh: bool) -> DataFrame:
        both = side.join(same, "digest", "left")
        return both.select(
            "digest", F.lit(fresh).alias("fresh"), F.coalesce("keep", "own_id").alias("keep_id"),
            F.coalesce("size", "own_n").alias("group_size"), (F.lit(not fresh) | F.col("size").isNotNull()).alias("in_snapshot"),
        )

    classes = settled(snapshot.classes.select("digest", F.col("keep_id").alias("own_id"), F.col("n").alias("own_n")), False).union(
        settled(groups.select("digest", F.col("low").alias("own_id"), F.col("more").alias("own_n")), True)
    )
    rows = old.select("doc_id", "digest", F.lit(False).alias("fresh")).union(new.select("doc_id", "digest", F.lit(True).alias("fresh")))
    out = rows.join(classes, ["digest", "fresh"])
    repeat = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("fresh"))
    return out.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (repeat == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"), "in_snapshot",
    )


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows below the middle of the id range (the snapshot) and all others, null ids among them."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = F.lit(None if low is None else (int(low) + int(high)) // 2).cast("long")
    early = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return docs.where(early), docs.where(~early)
