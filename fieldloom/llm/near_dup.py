"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import connected, cut, words

GRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 128
#: Texts of one bucket or candidate group that meet in a task: two blocks of about this many.
BLOCK = 512
#: N-grams a bin of a sketch should hold, and the most bins; beyond them bins are fuller and prune less.
BIN_GRAMS, MOST_BINS = 4, 1 << 14


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: of all that find a pair at the threshold with the wanted recall, the one with fewest
    chance candidates (mean collision probability over similarities up to half the threshold)."""
    low = np.linspace(0, threshold / 2, 200)
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            cost = float(np.mean(1 - (1 - low**rows) ** bands))
            best = min(best or (cost, bands, rows), (cost, bands, rows))
    if best is None:
        raise ValueError("no bands reach the wanted recall with so few hashes")
    return best[1], best[2]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(flat: np.ndarray, sizes: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text, and how many each has; shorter texts are one run.

    ``flat`` holds the 64-bit word hashes of all texts one after another. Texts without words have no run.
    """
    padded = np.maximum(sizes, np.minimum(sizes, 1) * n)
    begin = np.cumsum(padded) - padded
    stream = np.zeros(int(padded.sum()), np.uint64)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stream[np.repeat(begin, sizes) + within] = flat
    count = np.where(sizes > 0, padded - n + 1, 0)
    at = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + stream[at + k])
    return h, count


def signatures(h: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of texts that all have n-grams."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    begin = np.cumsum(count) - count
    out = np.zeros((len(count), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(count), band, np.uint64)
        for row in range(rows):
            low = np.minimum.reduceat(h * factors[band * rows + row], begin)
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = key
    return out.view(np.int64)


def sketch(distinct: np.ndarray) -> np.ndarray:
    """How many n-grams of a set fall into each of 2^k bins, 255 at most; bins grow with the set."""
    bins = min(max(1 << (len(distinct) // BIN_GRAMS).bit_length(), 8), MOST_BINS)
    return np.minimum(np.bincount((distinct & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8)


def folded(sketches: np.ndarray, bins: int) -> np.ndarray:
    """Sketches (one a row) as they would be with fewer bins."""
    while sketches.shape[1] > bins:
        half = sketches.shape[1] // 2
        sketches = np.minimum(sketches[:, :half].astype(np.int16) + sketches[:, half:], 255).astype(np.uint8)
    return sketches


def possible_parts(size: np.ndarray, sketches: list[np.ndarray], threshold: float) -> np.ndarray:
    """First member of each one's part, where parts are connected by pairs that may reach the threshold.

    A pair at the threshold differs in at most (1 - t) / (1 + t) of both sets' sizes, and sketches never
    differ by more than the sets do, so no pair at the threshold is lost.
    """
    width = np.array([len(s) for s in sketches])
    rank = np.zeros(len(size), np.int64)
    levels = {}
    for bins in np.unique(width):
        there = np.flatnonzero(width == bins)
        rank[there] = np.arange(len(there))
        levels[bins] = np.stack([sketches[i] for i in there])
    part = np.full(len(size), -1)
    alone = np.arange(len(size))
    while len(alone):
        part[alone[0]] = alone[0]
        waiting, alone = [alone[0]], alone[1:]
        while waiting and len(alone):
            a = waiting.pop()
            root, both = part[a], size[a] + size[alone]
            like = np.minimum(size[a], size[alone]) >= threshold * np.maximum(size[a], size[alone]) - 1e-6
            for bins in np.unique(width[alone[like]]):
                at = np.flatnonzero(like & (width[alone] == bins))
                few = min(bins, width[a])
                mine = folded(sketches[a][None, :], few).astype(np.int16)
                apart = np.abs(folded(levels[bins][rank[alone[at]]], few) - mine).sum(1, dtype=np.int64)
                like[at] = apart <= (1 - threshold) / (1 + threshold) * both[at] + 1e-6
            part[alone[like]] = root
            waiting.extend(alone[like])
            alone = alone[~like]
    return part


def meeting(rows: DataFrame) -> DataFrame:
    """Each row once for every pair (lo, hi) of blocks that its ``block`` of ``blocks`` is in."""
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("lo"), F.greatest(j, F.col("block")).alias("hi"))
    )
    rest = [F.col(c) for c in rows.columns if c != "blocks"]
    return rows.select(*rest, F.explode(meets).alias("meet")).select(*rest, "meet.lo", "meet.hi")


def candidate_ties(nodes: DataFrame, threshold: float) -> DataFrame:
    """a, b: ties that connect all nodes (node, bands, n_set, sketch) which meet in a bucket and may be near.

    A bucket is a band's hash. Its members meet in blocks, by their sizes and sketches alone; pairs that
    these rule out, as nearly all that meet by chance, tie nothing. Of each part of a meeting only ties
    to its first member come out. A task holds one meeting at a time, whatever the bucket's size.
    """
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = buckets.select("band", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = keys.join(buckets, ["band", "key"]).join(nodes.select("node", "n_set", "sketch"), "node")
    members = meeting(members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    place = ["band", "key", "lo", "hi"]
    members = members.select(*place, "node", "n_set", "sketch").repartition(*place).sortWithinPartitions(*place, "node")

    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def ties(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            names, size = rows["node"].to_numpy(), rows["n_set"].to_numpy()
            held = [np.frombuffer(s, np.uint8) for s in rows["sketch"]]
            first = np.arange(len(rows))
            for begin, end in zip(starts, np.append(starts[1:], len(rows)), strict=True):
                first[begin:end] = begin + possible_parts(size[begin:end], held[begin:end], threshold)
            tied = first != np.arange(len(rows))
            return pd.DataFrame({"a": names[tied], "b": names[first[tied]]})

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            where = rows[place].to_numpy(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(1)])) if len(rows) else np.zeros(1, np.int64)
            rest = rows.iloc[starts[-1] :]
            if starts[-1]:
                yield ties(rows.iloc[: starts[-1]], starts[:-1])
        if rest is not None and len(rest):
            yield ties(rest, np.zeros(1, np.int64))

    return members.mapInPandas(tie, "a binary, b binary")


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, node (digest of the words), n_grams, bands, n_set (different n-grams), sketch."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = texts.select("doc_id", F.xxhash64("text").alias("text_key"), word_hashes(F.col("text")).alias("h"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
            sizes = np.diff(offsets).astype(np.int64)
            h, count = grams(flat, sizes, n)
            some = np.flatnonzero(count > 0)
            keys = signatures(h, count[some], bands, rows) if len(some) else np.zeros((0, bands), np.int64)
            raw, ends = flat.tobytes(), 8 * np.cumsum(sizes)
            nodes = [blake2b(raw[e - 8 * s : e], digest_size=16).digest() for s, e in zip(sizes, ends, strict=True)]
            stops = np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]).astype(np.int32)
            sets = [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])][: len(count)]
            sizes_of_sets, drawn = pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.binary()), pa.array(count), pa.ListArray.from_arrays(pa.array(stops), pa.array(keys.ravel())), sizes_of_sets, drawn],
                ["doc_id", "text_key", "node", "n_grams", "bands", "n_set", "sketch"],
            )

    return hashed.mapInArrow(sign, "doc_id long, text_key long, node binary, n_grams long, bands array<long>, n_set long, sketch binary")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets.

    N-grams of few texts are counted pair by pair; n-grams of many as products of 0/1 matrices.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    size = np.diff(np.append(first, len(values)))
    out = np.zeros(m * m, np.int64)
    for k in range(2, 9):
        starts = first[size == k]
        for a in range(k):
            for b in range(a + 1, k):
                out += np.bincount(owner[starts + a] * m + owner[starts + b], minlength=m * m)
    out = out.reshape(m, m)
    out = out + out.T
    many = np.flatnonzero(size > 8)
    for part in np.array_split(many, -(-len(many) // 4096)) if len(many) else []:
        x = np.zeros((m, len(part)), np.float32)
        n_each = size[part]
        column = np.repeat(np.arange(len(part)), n_each)
        at = np.arange(n_each.sum()) + np.repeat(first[part] - (np.cumsum(n_each) - n_each), n_each)
        x[owner[at], column] = 1
        out += (x @ x.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def roots(link: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component in a symmetric 0/1 matrix."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label, len(link)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_classes(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, text_key, label, class_id, class_size, n_links.

    Two texts are linked if the Jaccard similarity of their sets of n-word runs is at least ``threshold``;
    words are lower-cased A-Z, digits and all beyond ASCII; a shorter text is one run. Classes are the
    connected groups, ``class_id`` the smallest doc_id in it (null if all are null), ``label`` its key.
    ``n_links`` counts all linked rows, copies among them. Null, empty and wordless texts are linked to
    nothing: each row is a class of its own, label null. Repeated rows are copies of each other. An empty
    table gives no rows; other columns are not read.

    1. Each text's MinHash bands are written; texts of the same words are one node from here on.
    2. In each bucket (band, hash) members are compared by size and sketch, which rule pairs out but lose none;
       those left are tied, and connected ties are the candidate groups. No pair is listed, and buckets
       that meet by chance do not chain groups together.
    3. A group is cut into blocks by hash; two blocks at a time meet in a task with their full sets, so a
       group of any size is spread and each pair meets once. Out come each node's number of links and one
       tie for each node to the smallest one of its part, never the pairs.
    4. Ties are connected to classes.
    """
    bands, rows = choose_bands(threshold, recall)
    table = cut(signed(docs, n, bands, rows), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    nodes = cut(
        table.where("n_grams > 0").groupBy("node")
        .agg(F.count("*").alias("copies"), F.min(place).alias("home"), *[F.first(c).alias(c) for c in ("bands", "n_set", "sketch")]),
        "nodes",
    )
    groups = connected(candidate_ties(nodes, threshold), "candidates")
    sized = groups.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sized, "label").join(nodes.select("node", "copies", "home"), "node")
    members = members.select("node", "copies", "label", "blocks", F.col("home.doc_id").alias("home_id"), F.col("home.text_key").alias("home_key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("k", F.xxhash64("t"))
    here = members.join(texts, F.col("home_id").eqNullSafe(F.col("d")) & (F.col("home_key") == F.col("k")))
    here = here.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    here = meeting(here.select("node", "copies", "label", "block", "blocks", word_hashes(F.col("t")).alias("h")))

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("node").sort_values("node", kind="stable")
        flat = np.concatenate(list(part["h"])).astype(np.int64).view(np.uint64)
        h, count = grams(flat, part["h"].map(len).to_numpy(np.int64), n)
        sets = [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])]
        both = shared(sets)
        size = np.diag(both)
        link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(link, False)
        if part["lo"].iloc[0] != part["hi"].iloc[0]:  # pairs within a block have their own task
            block = part["block"].to_numpy()
            link &= block[:, None] != block[None, :]
        names = part["node"].to_numpy()
        return pd.DataFrame({"a": names, "b": names[roots(link)], "links": link @ part["copies"].to_numpy(np.int64)})

    checked = cut(here.groupBy("label", "lo", "hi").applyInPandas(verify, "a binary, b binary, links long"), "links")
    links = checked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = connected(checked.select("a", "b"), "classes")
    known = nodes.join(links, "node", "left").join(classes, "node", "left")
    known = known.select(
        "node", F.coalesce("label", "node").alias("label"), F.col("home.doc_id").alias("low"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    known = cut(known, "classes")
    whole = known.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"))
    known = known.join(whole, "label")
    out = table.select("doc_id", "text_key", "node", "n_grams").join(known.select("node", "label", "class_id", "class_size", "n_links"), "node", "left")
    alone = F.col("n_grams") == 0
    return out.select(
        "doc_id", "text_key", "label", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"), F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
    )


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each class the smallest doc_id (null ids last).

    Of rows repeated with the same id and text one stays; wordless rows are all kept.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    stays = classes.where("label is not null").groupBy("label").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("d"), F.col("p.text_key").alias("k"))
    alone = classes.where("label is null").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    stays = stays.withColumn("wordless", F.lit(False)).union(alone.withColumn("wordless", F.lit(True)))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("rd"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("rk"))
    both = rows.join(stays, F.col("rd").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("k")))
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("rd", "rk").orderBy("rk")))
    return both.where("wordless or nth = 1").select([F.col("row").getField(c).alias(c) for c in docs.columns])
