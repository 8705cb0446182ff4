"""Toxicity: embeddings of word pieces, averaged over a stretch of words, into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Word pieces: all byte n-grams of a word with one blank on each side; hashed to 2**BITS rows of DIM numbers.
GRAMS, BITS, DIM = range(3, 7), 18, 4
#: Words averaged at a time; a word counts once in a stretch, and a short one is filled up with blanks (zeros).
#: A document scores as its highest stretch, so length does not thin out a few words.
STRETCH = 64
#: Bounds of the training sample: labelled rows of each class, and bytes of their texts.
ROWS_CLEAN, ROWS_TOXIC, SAMPLE_BYTES = 4_000, 2_000, 32 << 20
#: A longer labelled text gives the sample this many windows spread evenly over it, of so many bytes together at most.
ROW_BYTES, WINDOWS = 1 << 20, 16
#: Pieces that occur in fewer words of the sample's texts are left at zero.
LEAST_SEEN, STEPS, BATCH, RATE, DECAY = 5, 1600, 256, 0.2, 1e-4
CUT, CLEAN_LOSS = 0.7, 0.002
PIECE_BYTES = 1 << 20
PLAIN = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass
class Model:
    """``piece``: score of each hashed word piece, embeddings times the difference of the softmax rows."""

    piece: np.ndarray
    bias: float
    at_cut: float

    def packed(self) -> bytes:
        return np.concatenate([[self.bias, self.at_cut], self.piece]).astype(np.float32).tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Model:
        values = np.frombuffer(data, np.float32)
        return Model(values[2:], float(values[0]), float(values[1]))

    def score(self, logit: np.ndarray) -> np.ndarray:
        """Logits to 0..1; ``at_cut`` becomes CUT."""
        shifted = np.clip(logit - self.at_cut + np.log(CUT / (1 - CUT)), -60, 60)
        return 1 / (1 + np.exp(-shifted))


def plain(text: str | None) -> bytes:
    """UTF-8 with A-Z as a-z and all other ASCII but digits and letters as blanks."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)


def pieces(stream: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: hashed row of the n-gram that starts at each byte, and whether it stays within one word."""
    size = len(stream)
    at = np.arange(size, dtype=np.int32)
    following = np.minimum.accumulate(np.where(stream == 32, at, np.int32(size))[::-1])[::-1]
    letters = stream.astype(np.uint32)
    h = letters * np.uint32(0x9E3779B1)
    for n in range(2, max(GRAMS) + 1):
        if size < n:
            return
        h = (h[: size - n + 1] * np.uint32(0x01000193)) ^ (letters[n - 1 :] * np.uint32(0x85EBCA6B))
        if n in GRAMS:
            inside = following[1 : size - n + 2] >= at[n - 1 :]
            yield (((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int32), inside


def word_places(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last one of each word; the stream begins and ends with a blank."""
    blank = stream == 32
    change = blank[1:] != blank[:-1]
    edges = np.flatnonzero(change) + 1
    return edges[0::2], edges[1::2]


def piece_counts(lengths: np.ndarray) -> np.ndarray:
    return sum(np.maximum(lengths + 3 - n, 0) for n in GRAMS)


def logits(texts: list[bytes], model: Model) -> np.ndarray:
    """Highest stretch of each text; a text without words has the bias alone."""
    best = np.full(len(texts), -np.inf)
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        stream = np.frombuffer(b" " + b" ".join(t for _, t in group) + b" ", np.uint8)
        first, last = word_places(stream)
        if len(first):
            total = np.zeros(len(stream) + 1, np.float64)
            for row, inside in pieces(stream):
                total[1 : len(row) + 1] += np.where(inside, model.piece[row], 0)
            total = np.cumsum(total)
            word = (total[last] - total[first - 1]) / piece_counts(last - first)
            begin = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in group])])[:-1]
            owner = np.searchsorted(begin, first, "right") - 1
            opening = np.searchsorted(owner, np.arange(len(group)))
            nth = np.arange(len(first)) - opening[owner]
            stretch = np.cumsum((nth % STRETCH) == 0) - 1
            of = owner[np.flatnonzero((nth % STRETCH) == 0)]
            distinct = np.unique((stretch << 40) + (np.clip(word, -9e4, 9e4) * 1e6).round().astype(np.int64) + (1 << 39))
            total = np.bincount(distinct >> 40, (distinct & ((1 << 40) - 1)) - (1 << 39), len(of)) / 1e6
            np.maximum.at(best, np.array([i for i, _ in group])[of], total + model.bias)
        group.clear()

    for i, text in enumerate(texts):
        while text:
            stop = len(text) if len(text) <= PIECE_BYTES else text.find(b" ", PIECE_BYTES)
            stop = len(text) if stop < 0 else stop
            group.append((i, text[:stop]))
            held += stop
            text = text[stop:]
            if held >= PIECE_BYTES:
                flush()
                held = 0
    if group:
        flush()
    return np.where(np.isfinite(best), best, model.bias)


def train(texts: list[bytes], labels: np.ndarray, checked: np.ndarray, steps: int = STEPS) -> Model:
    """Embeddings and softmax rows learned together by Adagrad over batches of stretches.

    At first every stretch of a toxic text counts as toxic; after a quarter of the steps only its highest
    one does. ``checked`` rows take no part; they place the cut.
    """
    n1, n = int(labels.sum()), len(labels)
    if n1 == 0 or n1 == n:  # one class only, or no labels: its smoothed share, and nothing is rejected
        share = min((n1 + 0.5) / (n + 1), 0.5)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))), float(np.log(CUT / (1 - CUT))))
    vocabulary: dict[bytes, int] = {}
    word, stretch_of, doc_of = [], [], []
    count = 0
    for d in np.flatnonzero(~checked):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in texts[d].split()], np.int32)
        if len(ids):
            both = np.unique(((count + np.arange(len(ids), dtype=np.int64) // STRETCH) << 32) + ids)
            word.append((both & 0xFFFFFFFF).astype(np.int32))
            stretch_of.append((both >> 32).astype(np.int32))
            doc_of += [d] * (-(-len(ids) // STRETCH))
            count = len(doc_of)
    if not count:
        return train([], np.zeros(0, np.int64), np.zeros(0, bool))
    word, stretch_of, doc_of = np.concatenate(word), np.concatenate(stretch_of), np.array(doc_of)
    stream = np.frombuffer(b" " + b" ".join(vocabulary) + b" ", np.uint8)
    first, last = word_places(stream)
    owner = np.searchsorted(first - 1, np.arange(len(stream)), "right") - 1
    rows, holders = [], []
    for row, inside in pieces(stream):
        at = np.flatnonzero(inside)
        rows.append(row[at])
        holders.append(owner[at].astype(np.int32))
    rows, holders = np.concatenate(rows), np.concatenate(holders)
    per_word = piece_counts(last - first).astype(np.float32)
    seen = np.bincount(rows, np.bincount(word, minlength=len(first))[holders], 1 << BITS)
    kept = np.flatnonzero(seen[rows] >= LEAST_SEEN)
    kept = kept[np.argsort(holders[kept], kind="stable")]
    used, rows = np.unique(rows[kept], return_inverse=True)
    word_ends = np.cumsum(np.bincount(holders[kept], minlength=len(first)))
    ends = np.cumsum(np.bincount(stretch_of, minlength=count))
    y = labels[doc_of].astype(np.float32)

    rng = np.random.default_rng(7)
    table = rng.normal(0, 1e-3, (len(used), DIM)).astype(np.float32)
    soft = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full_like(v, 1e-6) for v in (table, soft, bias)]

    def slots(stops: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the members of each id, one after another, and the running number of their id."""
        n_each = stops[ids] - np.where(ids > 0, stops[ids - 1], 0)
        which = np.repeat(np.arange(len(ids)), n_each)
        return np.arange(n_each.sum()) + np.repeat(stops[ids] - np.cumsum(n_each), n_each), which

    def step(ids: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
        """Logit differences of the stretches; with weights, one Adagrad step as well."""
        at, which = slots(ends, ids)
        some, inverse = np.unique(word[at], return_inverse=True)
        piece_at, piece_word = slots(word_ends, some)
        mine = rows[piece_at]
        gathered = table[mine]
        words_ = np.stack([np.bincount(piece_word, gathered[:, k], len(some)) for k in range(DIM)], 1) / per_word[some, None]
        mean = np.stack([np.bincount(which, words_[inverse, k], len(ids)) for k in range(DIM)], 1)  # of the stretch, in units of one word
        z = mean @ soft + bias
        gap = z[:, 1] - z[:, 0]
        if weight is not None:
            off = (1 / (1 + np.exp(-np.clip(gap, -30, 30))) - y[ids]) * weight
            toward = np.stack([-off, off], 1)
            pull = toward @ soft.T
            to_word = np.stack([np.bincount(inverse, pull[which, k], len(some)) for k in range(DIM)], 1) / per_word[some, None]
            grad = np.stack([np.bincount(mine, to_word[piece_word, k], len(used)) for k in range(DIM)], 1)
            grad += DECAY * table
            for values, g, s in zip((table, soft, bias), (grad, mean.T @ toward, toward.sum(0)), squares, strict=True):
                s += g * g
                values -= RATE * g / np.sqrt(s)
        return gap

    done = 0
    while done < steps:
        chosen = np.arange(count)
        if done >= steps // 4:
            gap = np.concatenate([step(part, None) for part in np.array_split(chosen, -(-count // 4096))])
            best = np.full(n, -np.inf)
            np.maximum.at(best, doc_of, gap)
            chosen = chosen[(y == 0) | (gap >= best[doc_of])]
        share = max(y[chosen].mean(), 1e-6)
        weights = np.where(y == 1, np.sqrt(max((1 - share) / share, 1)), 1.0)
        chosen = rng.permutation(chosen)
        for part in np.array_split(chosen, -(-len(chosen) // BATCH)):
            step(part, weights[part] / len(part))
            done += 1
    piece = np.zeros(1 << BITS, np.float32)
    piece[used] = table @ (soft[:, 1] - soft[:, 0])
    model = Model(piece, float(bias[1] - bias[0]), 0.0)
    held = checked if 0 < labels[checked].sum() < checked.sum() else np.ones(n, bool)
    z = logits([t for t, c in zip(texts, held, strict=True) if c], model)
    model.at_cut = best_cut(z, labels[held])
    return model


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between neighbouring logits at which the F1 of class 1 is highest.

    Never below the logit that all but CLEAN_LOSS of the clean rows keep.
    """
    floor = float(np.quantile(z[y == 0], 1 - CLEAN_LOSS)) + 1e-6
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    last = len(f1) - 1 - int(np.argmax(f1[::-1]))
    z = z[order]
    return max(floor, float((z[last] + z[last + 1]) / 2) if last + 1 < len(z) else float(z[last]))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3: remainder 1 is held out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, rows_clean: int = ROWS_CLEAN, rows_toxic: int = ROWS_TOXIC) -> Model:
    """Train in one task on a bounded sample of the labelled rows that are not held out.

    Of each class come the rows with the smallest MD5 of the id, as many as the bounds allow. A fifth of
    them, by the same hash, places the cut. Long texts enter by windows, so none uses up its class's bytes. Rows with null id, label or fold take no part; of several labels
    of one id the largest holds; of texts repeated with one id the first in order.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).na.drop()
    known = known.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("draw", F.md5(F.col("doc_id").cast("string").cast("binary")))
    picked = None
    for value, most in ((0, rows_clean), (1, rows_toxic)):
        some = known.where(F.col("toxic") == value).orderBy("draw").limit(most)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id")  # at most rows_clean + rows_toxic ids
    sample = sample.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text"))
    width = ROW_BYTES // WINDOWS // 4 - 1  # letters of up to four bytes, and a blank after each window
    step = F.floor((F.length("text") - width) / (WINDOWS - 1)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(width)))
    sample = sample.withColumn("text", F.when(F.octet_length("text") > ROW_BYTES, F.array_join(windows, " ")).otherwise(F.col("text")))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("toxic").orderBy("draw"))
    sample = sample.withColumn("bytes", so_far).where(F.col("bytes") <= SAMPLE_BYTES // 2)

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([*parts, pd.DataFrame({"text": [], "toxic": [], "draw": []})]).sort_values("draw", kind="stable")
        checked = got["draw"].str[-2:].map(lambda x: int(x, 16) % 5 == 0).to_numpy(bool) if len(got) else np.zeros(0, bool)
        model = train([plain(t) for t in got["text"]], got["toxic"].to_numpy(np.int64), checked)
        yield pd.DataFrame({"model": [model.packed()]})

    row = sample.select("text", "toxic", "draw").repartition(1).mapInPandas(learn, "model binary").first()
    return Model.unpacked(bytes(row[0])) if row else train([], np.zeros(0, np.int64), np.zeros(0, bool))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``toxic_score`` (0 to 1) to the rows of ``docs``; every whole text, null as empty.

    Texts without words score as the bias alone, far below the cut. Rows are neither merged nor moved; an
    empty table stays empty. A column ``toxic_score`` of ``docs`` is replaced.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.packed())  # 1 MB, whatever the corpus

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Model.unpacked(weights.value)
        for batch in batches:
            yield pd.Series(held.score(logits([plain(t) for t in batch], held)))

    return docs.withColumn("toxic_score", scored(F.coalesce(F.col("text").cast("string"), F.lit(""))))
