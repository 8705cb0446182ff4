"""Removal of repeated byte strings by suffix arrays built in two stages."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import cut

#: Least length of a repeat, and bytes of the anchors by which repeats find each other.
LENGTH, ANCHOR = 400, 200
#: Bytes of text that are searched for anchors at a time, and of fragments sorted at a time; an anchor with
#: more than LARGE times the latter is counted instead.
PIECE, BIN_BYTES, LARGE = 1 << 20, 1 << 20, 4
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    held = _POWERS.get(base)
    if held is None or len(held) < size:
        factors = np.full(1 << max(20, int(size - 1).bit_length()), base, np.uint64)
        factors[0] = 1
        held = _POWERS[base] = np.cumprod(factors)
    return held[:size]


def window_hashes(stream: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the bytes from each place on, ``width`` of them."""
    n = len(stream)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(powers(BASE, n) * (stream.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    h = (sums[width:] - sums[: n + 1 - width]) * powers(INVERSE, n + 1 - width)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding(values: np.ndarray, width: int, best: np.ufunc, pad: int) -> np.ndarray:
    """Least or greatest of each ``width`` values in a row, by running bests within blocks."""
    n = len(values)
    whole = np.full(-(-n // width) * width, pad, values.dtype)
    whole[:n] = values
    blocks = whole.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def anchored(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every string of ``length`` bytes goes with the leftmost smallest window hash inside it, its anchor.

    Equal strings have equal anchors at equal places, wherever they stand. Returns for each anchor its hash,
    and the first and last start of the strings that it stands for.
    """
    span = length - anchor + 1
    h = window_hashes(np.frombuffer(text, np.uint8), anchor)
    low = sliding(h, span, np.minimum, (1 << 64) - 1)
    edge = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), span, np.maximum, 0) == h)
    at = np.searchsorted(chosen, np.arange(len(low)))
    wrong = np.flatnonzero(h[chosen[at]] != low)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[h[chosen[at[wrong]]] != low[wrong]]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[chosen[at[first]]].view(np.int64), first, np.append(first[1:], len(low)) - 1


def suffix_order(text: bytes, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at the first ``starts`` places of each fragment, sorted: a suffix array in two stages.

    A fragment is ``text[begin:end]`` and ends below every byte. A suffix smaller than its successor (the one
    that begins a byte later) is sorted directly, by its bytes up to ``depth`` or its fragment's end. Every
    other suffix is induced: buckets are scanned by first byte, and what stands there puts its predecessor at
    the next free place of the predecessor's bucket, before that bucket's directly sorted ones. Only what is
    asked for takes part, and what follows it up to the next directly sorted suffix.
    """
    n = len(text) + len(begin)  # with an end mark behind each fragment
    size = end - begin
    head = begin + np.arange(len(begin))
    letters = np.zeros(n, np.int16)
    inner = np.arange(int(size.sum())) + np.repeat(head - (np.cumsum(size) - size), size)
    letters[inner] = np.frombuffer(text, np.uint8)[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)].astype(np.int16) + 1
    # a suffix is smaller than its successor if the next other byte is larger
    change = np.flatnonzero(letters[1:] != letters[:-1])
    rise = letters[change + 1] > letters[change]
    smaller = np.zeros(n, bool)
    following = np.searchsorted(change, np.arange(n - 1))
    known = following < len(change)
    smaller[:-1][known] = rise[following[known]]
    smaller[head + size] = False
    # asked for: the starts, and on to the next smaller one or the end mark
    stop = smaller.copy()
    stop[head + size] = True
    stops = np.flatnonzero(stop)
    last = stops[np.searchsorted(stops, head + starts)]
    wanted = np.zeros(n + 1, np.int64)
    np.add.at(wanted, head, 1)
    np.add.at(wanted, last + 1, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    direct = np.flatnonzero(wanted & smaller)
    owner = np.searchsorted(head, direct, "right") - 1
    low = direct - owner
    keys = [text[a:b] for a, b in zip(low.tolist(), np.minimum(low + depth, end[owner]).tolist(), strict=True)]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]
    del keys
    induced = wanted & ~smaller
    by_letter = np.argsort(letters[direct], kind="stable")
    cuts = np.searchsorted(letters[direct[by_letter]], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    marks = (head + size)[wanted[head + size]]
    out = []
    for c in range(257):
        here = [marks] if c == 0 else list(waiting[c])
        scan = np.concatenate(here) if here else np.zeros(0, np.int64)
        while len(scan) and c:  # equal bytes in a row: the bucket feeds itself
            before = scan - 1
            scan = before[(before >= 0) & induced[before] & (letters[before] == c)]
            here.append(scan)
        bucket = np.concatenate([*here, direct[by_letter[cuts[c] : cuts[c + 1]]]])
        out.append(bucket)
        before = bucket - 1
        before = before[(before >= 0)]
        before = before[induced[before] & (letters[before] > c)]
        order = np.argsort(letters[before], kind="stable")
        before = before[order]
        edges = np.flatnonzero(np.diff(letters[before], prepend=-1))
        for part in np.split(before, edges[1:]) if len(before) else []:
            waiting[int(letters[part[0]])].append(part)
    order = np.concatenate(out)
    owner = np.searchsorted(head, order, "right") - 1
    asked = order - head[owner] < starts[owner]
    return (order - owner)[asked]


def common_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, up to ``most``; eight at a time."""
    padded = text + bytes(most + 8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    lcp = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, most, 8):
        x = eight[order[alive] + at] ^ eight[order[alive - 1] + at]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        lcp[alive[differ]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[~differ]
    lcp[alive] = most
    return np.minimum(lcp, most)


def repeated_ranges(fragments: list[bytes], counts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each fragment the byte ranges covered by strings of ``length`` that occur more than once.

    A fragment stands for ``counts`` places; two fragments never hold one place.
    """
    size = np.array([len(f) for f in fragments], np.int64)
    end = np.cumsum(size)
    begin, starts = end - size, size - length + 1
    text = b"".join(fragments)
    order = suffix_order(text, begin, end, starts, length)
    group = np.cumsum(common_prefixes(text, order, length) < length) - 1
    owner = np.searchsorted(begin, order, "right") - 1
    places = np.bincount(group, counts[owner])
    hit = order[places[group] > 1]
    mask = np.zeros(len(text) + 1, np.int64)
    np.add.at(mask, hit, 1)
    np.add.at(mask, hit + length, -1)
    covered = np.cumsum(mask[:-1]) > 0
    out = []
    for a, b in zip(begin, end, strict=True):
        edges = np.flatnonzero(np.diff(covered[a:b].astype(np.int8), prepend=0, append=0))
        out.append(list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same text or
    another; strings lie within one text and are judged on the input. Null counts as empty; texts shorter
    than ``length`` are kept whole; ids may be null or repeated, repeated rows are repeats of each other; an
    empty table gives no rows; other columns are not read.

    1. Each string goes with its anchor (see ``anchored``); strings next to each other with one anchor make a
       fragment. Fragments are written as places and hashes, about one for each hundred bytes.
    2. An anchor seen once has no repeats. Where all fragments of an anchor are equal, all their strings are.
    3. Of the other anchors each distinct fragment is fetched once, with the number of its places. Anchors are
       dealt to bins of about ``bin_bytes``; a bin's suffix array and adjacent common prefixes give the
       strings that occur twice.
    4. An anchor with more than ``LARGE * bin_bytes`` of distinct fragments is no job for one task: its strings are
       counted by digest instead, pre-aggregated, with the same result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_key"), F.encode("text", "UTF-8").alias("data"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"row": [], "first": [], "last": [], "anchor": [], "digest": []}
            for i, value in enumerate(batch.column("data")):
                text = value.as_py()
                for piece in range(0, max(len(text) - length + 1, 0), PIECE):
                    part = text[piece : piece + PIECE + length - 1]
                    if len(part) < length:
                        continue
                    h, first, last = anchored(part, length, anchor)
                    found["row"].append(np.full(len(h), i))
                    found["first"].append(first + piece)
                    found["last"].append(last + piece)
                    found["anchor"].append(h)
                    found["digest"].append(
                        np.frombuffer(b"".join(blake2b(part[a : b + length], digest_size=8).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.int64)
                    )
            if found["row"]:
                row = pa.array(np.concatenate(found.pop("row")))
                columns = {k: pa.array(np.concatenate(v)) for k, v in found.items()}
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("text_key").take(row), *columns.values()], ["doc_id", "text_key", *columns]
                )

    places = cut(texts.mapInArrow(find, "doc_id long, text_key long, first long, last long, anchor long, digest long"), "fragments")
    seen = places.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b")).where("n > 1")
    again = cut(places.join(seen.select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchor"), "repeated-anchors")

    home = F.struct(F.col("doc_id").isNull().alias("last_id"), "doc_id", "text_key", "first", "last")
    distinct = again.where("mixed").groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(home).alias("home"))
    distinct = distinct.select(
        "anchor", "digest", "n", F.col("home.doc_id").alias("d"), F.col("home.text_key").alias("k"), F.col("home.first").alias("first"), F.col("home.last").alias("last")
    )
    wanted = distinct.groupBy("d", "k").agg(F.collect_list(F.struct("anchor", "digest", "n", "first", "last")).alias("parts"))
    fetched = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    piece = F.transform(
        "parts",
        lambda p: F.struct(
            p["anchor"].alias("anchor"), p["digest"].alias("digest"), p["n"].alias("n"),
            F.substring(F.col("data"), (p["first"] + 1).cast("int"), (p["last"] - p["first"] + length).cast("int")).alias("bytes"),
        ),
    )
    fetched = fetched.select(F.explode(piece).alias("p")).select("p.*")
    fetched = cut(fetched, "fragment-bytes")
    weights = fetched.groupBy("anchor").agg(F.sum(F.length("bytes").cast("long")).alias("bytes"))
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    bins = max(1, math.ceil(total / bin_bytes))
    large = weights.where(F.col("bytes") > LARGE * bin_bytes).select("anchor")
    small = fetched.join(large, "anchor", "left_anti").withColumn("bin", F.pmod(F.xxhash64("anchor"), F.lit(bins)))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["anchor", "digest"])  # rows repeated with one id and text fetch the same twice
        ranges = repeated_ranges(list(part["bytes"]), part["n"].to_numpy(np.int64), length)
        each = [len(r) for r in ranges]
        flat = np.array([x for r in ranges for x in r], np.int64).reshape(-1, 2)
        return pd.DataFrame({"anchor": np.repeat(part["anchor"].to_numpy(), each), "digest": np.repeat(part["digest"].to_numpy(), each), "lo": flat[:, 0], "hi": flat[:, 1]})

    sorted_out = small.groupBy("bin").applyInPandas(compare, "anchor long, digest long, lo long, hi long")
    strings = fetched.join(large, "anchor", "left_semi").dropDuplicates(["anchor", "digest"])
    strings = strings.withColumn("lo", F.explode(F.sequence(F.lit(0), F.length("bytes") - length)))
    strings = strings.select("anchor", "digest", "n", F.col("lo").cast("long").alias("lo"), F.sha2(F.substring(F.col("bytes"), F.col("lo") + 1, F.lit(length)), 256).alias("w"))
    twice = strings.groupBy("w").agg(F.sum("n").alias("times")).where("times > 1").select("w")
    counted = strings.join(twice, "w").select("anchor", "digest", "lo", (F.col("lo") + length).alias("hi"))
    ranges = cut(sorted_out.union(counted), "ranges")

    gone = again.where("not mixed").select("doc_id", "text_key", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
    partly = again.where("mixed").join(ranges, ["anchor", "digest"])
    gone = gone.union(partly.select("doc_id", "text_key", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi")))
    gone = gone.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    both = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "data", "lo", "hi")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            sizes = pc.binary_length(batch.column("data"))
            for value, lo, hi in zip(batch.column("data"), batch.column("lo"), batch.column("hi"), strict=True):
                text = value.as_py()
                if not lo.is_valid:
                    removed.append(0), spans.append(0), kept.append(text)
                    continue
                lo, hi = np.sort(lo.values.to_numpy()), np.sort(hi.values.to_numpy())
                begin = lo[np.concatenate([[True], lo[1:] > hi[:-1]])]  # with both sorted, a gap opens where no range is open
                end = hi[np.concatenate([lo[1:] > hi[:-1], [True]])]
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
                removed.append(len(text) - len(kept[-1]))
                spans.append(len(begin))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes.cast(pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return both.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
