"""Fill-in-the-middle: texts cut at drawn unit bounds, which a Fenwick tree over text blocks finds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that one leaf of the tree counts.
BLOCK = 2048


def unit_starts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the UTF-8 bytes of texts one after another: where a unit starts, and where a code point does.

    A unit is a run of ASCII letters or one other code point; it never runs on into the next text.
    """
    letter = ((data | 0x20) - np.uint8(97)) < 26
    lead = (data & 0xC0) != 0x80
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[ends[ends < len(data)]] = False
    return lead & ~goes_on, lead


def fenwick(counts: np.ndarray) -> np.ndarray:
    """Node i holds the sum of the lowbit(i) leaves that end at leaf i; rows are leaves, columns are kinds of counts."""
    sums = np.zeros((len(counts) + 1, counts.shape[1]), np.int64)
    np.cumsum(counts, axis=0, out=sums[1:])
    node = np.arange(len(counts) + 1)
    return sums - sums[node - (node & -node)]


def descend(tree: np.ndarray, units: int) -> tuple[int, np.ndarray]:
    """Leaves before the one in which unit ``units`` starts, and all counts in them: binary lifting from the root."""
    at, total = 0, np.zeros(tree.shape[1], np.int64)
    step = 1 << (len(tree) - 1).bit_length()
    while step:
        if at + step < len(tree) and total[0] + tree[at + step, 0] <= units:
            at += step
            total = total + tree[at]
        step >>= 1
    return at, total


def places(start: np.ndarray, lead: np.ndarray, draws: list[int], block: int = BLOCK) -> tuple[int, int, int]:
    """Units of one text, and the code points before each of its two cuts (drawn numbers modulo units + 1)."""
    if not len(start):
        return 0, 0, 0
    edges = np.arange(0, len(start), block)
    tree = fenwick(np.stack([np.add.reduceat(start, edges, dtype=np.int64), np.add.reduceat(lead, edges, dtype=np.int64)], 1))
    n = int(start.sum())
    found = []
    for cut in sorted(d % (n + 1) for d in draws):
        leaf, (units, points) = descend(tree, cut)
        if leaf < len(edges):
            part = slice(leaf * block, (leaf + 1) * block)
            byte = np.flatnonzero(start[part])[cut - units]
            points += np.count_nonzero(lead[part][:byte])
        found.append(int(points))
    return n, found[0], found[1]


def cuts(text: Column, first: Column, second: Column) -> Column:
    """n (units) and the code points before the two cuts, a and b."""

    @F.arrow_udf("struct<n:long,a:long,b:long>")
    def find(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        start, lead = unit_starts(data, ends)
        out = [
            places(start[a:b], lead[a:b], [x, y])
            for a, b, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), one.to_pylist(), two.to_pylist(), strict=True)
        ]
        table = np.array(out, np.int64).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(3)], ["n", "a", "b"])

    return find(text, first, second)


def draw(key: Column, number: int) -> Column:
    """The ``number``-th group of eight hex digits of the key's SHA-256, unsigned."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Prefix and middle end after the smaller and the larger of two drawn numbers of units; the draws are the SHA-256 of
    seed:doc_id, so neither the layout nor a lost executor changes them. Documents outside ``percent``, empty ones and
    texts that hold a marker stay plain, with null lengths. Null counts as empty, a null id draws as an empty one,
    repeated rows give equal rows, an empty table none; only doc_id and text are read. Texts are worked on row by row,
    without a shuffle; the worker sends back three numbers, the text itself is cut where it lies.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[draw(key, i).alias(f"h{i}") for i in range(1, 5)])
    rows = rows.withColumn("at", cuts(F.col("text"), F.col("h1"), F.col("h2"))).select("*", "at.n", "at.a", "at.b")
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    one = F.expr("left(text, int(a))")
    two = F.expr("substring(text, int(a) + 1, int(b - a))")
    rest = F.expr("substring(text, int(b) + 1)")
    psm = F.concat(F.lit(PREFIX), one, F.lit(SUFFIX), rest, F.lit(MIDDLE), two)
    spm = F.concat(F.lit(SUFFIX), rest, F.lit(PREFIX), one, F.lit(MIDDLE), two)
    made = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form", F.when(made, F.col("a")).alias("prefix_chars"), F.when(made, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text before the cut: what stands between the markers, in reading order.

    No marker begins as another ends, and the parts hold none, so the first of each is the right one.
    """

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(4))
        first = F.substring_index(body, second, 1)
        body = F.substr(body, F.length(first) + 4)
        then = F.substring_index(body, MIDDLE, 1)
        return first, then, F.substr(body, F.length(then) + 4)

    prefix, suffix, middle = parts(SUFFIX)
    suffix_first, prefix_then, middle_last = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_then, middle_last, suffix_first)).otherwise(output)
