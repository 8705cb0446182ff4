"""Feature collections of any size, read in byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.session import reliable

#: What stands before the first object of an array in a piece that begins outside of all arrays.
BEFORE_FIRST = re.compile(r'^(?:[^"\[]|"(?:[^"\\]|\\.)*"|\[(?!\s*\{))*\[\s*(?=\{)', re.DOTALL)
STATE = ["quotes", "brace0", "brace1", "bracket0", "bracket1"]
BLOCK = ["file", "block"]


def _surplus(text: Column, more: str, less: str = "") -> Column:
    """How many more of one mark than of the other a text holds."""

    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    return (count(more) - count(less) if less else count(more)).cast("int")


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, in order of (file, block, nth), with what it does to the reader's state.

    Spark cuts the files into byte ranges (``block`` is where one starts) as with lines. A piece may begin
    inside a string or outside, which its block cannot know: braces and brackets are counted for both.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value"
    )
    marks = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    raw = raw.withColumn("marks", marks)
    raw = raw.withColumn("even", F.array_join(F.filter("marks", lambda _, i: i % 2 == 0), ""))
    raw = raw.withColumn("odd", F.array_join(F.filter("marks", lambda _, i: i % 2 == 1), ""))
    return raw.select(
        *BLOCK, "nth", "value",
        (F.size("marks") - 1).cast("int").alias("quotes"),
        _surplus(F.col("even"), "{").alias("brace0"), _surplus(F.col("odd"), "{").alias("brace1"),
        _surplus(F.col("even"), "[", "]").alias("bracket0"), _surplus(F.col("odd"), "[", "]").alias("bracket1"),
    )


def _runs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of one batch, block by block."""
    new = (rows["file"] != rows["file"].shift()) | (rows["block"] != rows["block"].shift())
    starts = np.flatnonzero(new.to_numpy())
    for begin, end in zip(starts, np.append(starts[1:], len(rows)), strict=True):
        yield rows.iloc[begin:end]


def _walk(rows: pd.DataFrame, state: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Bracket depth before each piece, whether it ends an object that lies in an array of the root, and the last state."""
    quote, brace, bracket = state
    q = rows["quotes"].to_numpy(np.int64)
    after_quote = (quote + np.cumsum(q)) & 1
    before_quote = (after_quote + q) & 1
    braces = brace + np.cumsum(np.where(before_quote, rows["brace1"], rows["brace0"]) - (after_quote == 0))
    moved = np.where(before_quote, rows["bracket1"], rows["bracket0"])
    brackets = bracket + np.cumsum(moved)
    ends = (after_quote == 0) & (braces == 1) & (brackets == 1)
    return brackets - moved, ends, (int(after_quote[-1]), int(braces[-1]), int(brackets[-1]))


def block_states(pieces: DataFrame) -> DataFrame:
    """file, block, quote, brace, bracket: the reader's state where each block starts."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {}
        for batch in batches:
            for rows in _runs(batch):
                key = (rows["file"].iloc[0], rows["block"].iloc[0])
                two = seen.get(key, ((0, 0, 0), (1, 0, 0)))
                seen[key] = tuple(_walk(rows, state)[2] for state in two)
        yield pd.DataFrame(
            [(f, b, out[0], out[1], other[1], out[2], other[2]) for (f, b), (out, other) in seen.items()], columns=[*BLOCK, *STATE]
        )

    sums = pieces.select(*BLOCK, *STATE).mapInPandas(total, "file string, block long, quotes int, brace0 long, brace1 long, bracket0 long, bracket1 long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("quote", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("quote") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))).over(earlier), F.lit(0))

    return known.select(*BLOCK, "quote", before("brace").alias("brace"), before("bracket").alias("bracket"))


def collection_features(spark: SparkSession, path: str) -> DataFrame:
    """One row (``feature``, JSON text) for each feature of the collections below ``path``.

    A file is read in byte ranges, whatever its line breaks: a first pass over the ranges tells the state in
    which each begins (inside a string, depth of braces and brackets), a second one cuts the features at
    their closing braces. Only what lies over the edges of ranges is shuffled, one row or two a range.
    Other members of a collection are skipped; objects in arrays of theirs come out too and are told by
    their type. Empty collections and empty files give no rows. What follows a broken bracket is lost.
    """
    pieces = json_pieces(spark, path)
    placed = pieces.join(block_states(pieces), BLOCK).sortWithinPartitions(*BLOCK, "nth")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, held, opens, ended = None, None, [], False, False

        def row(text: list[str], kind: str, opened: bool) -> tuple:
            return (*key, kind, opened, "}".join(text))

        for batch in batches:
            out = []
            for rows in _runs(batch):
                here = (rows["file"].iloc[0], int(rows["block"].iloc[0]))
                if here != key:
                    if held or ended:  # an empty tail also says that the next block begins a feature
                        out.append(row([*held, ""], "tail" if ended else "part", opens))
                    key, held, opens, ended = here, [], False, False
                    state = tuple(int(rows[c].iloc[0]) for c in ("quote", "brace", "bracket"))
                outside, ends, state = _walk(rows, state)
                for value, bracket, end in zip(rows["value"], outside, ends, strict=True):
                    if bracket == 0:
                        held, opens = [], True
                        value = BEFORE_FIRST.sub("", value)
                    held.append(value)
                    if end:
                        out.append(row([*held, ""], "whole" if ended else "head", opens))
                        held, opens, ended = [], False, True
            yield pd.DataFrame(out, columns=[*BLOCK, "kind", "opens", "text"])
        if held or ended:
            yield pd.DataFrame([row([*held, ""], "tail" if ended else "part", opens)], columns=[*BLOCK, "kind", "opens", "text"])

    cut = reliable(placed.mapInPandas(gather, "file string, block long, kind string, opens boolean, text string"), "features")
    edges = cut.where("kind <> 'whole'")
    # a feature over an edge: a tail, parts of blocks that end none, and the head of the next block
    rank = F.when(F.col("kind") == "tail", 1).otherwise(0)
    order = Window.partitionBy("file").orderBy("block", rank)
    edges = edges.withColumn("rank", rank).withColumn("nth", F.sum(rank).over(order))
    joined = edges.groupBy("file", "nth").agg(
        F.array_sort(F.collect_list(F.struct("block", "rank", "opens", "text"))).alias("parts"), F.max(F.col("kind") == "head").alias("closed")
    )
    last = F.greatest(F.lit(1), F.array_max(F.transform("parts", lambda p, i: F.when(p["opens"], i + 1).otherwise(1))))
    text = F.array_join(F.slice("parts", last, F.size("parts")).getField("text"), "")
    both = cut.where("kind = 'whole'").select("text").union(joined.where("closed").select(text.alias("text")))
    return both.select(F.regexp_replace("text", r"^[\s,]+", "").alias("feature"))


def write_collections(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Texts of one feature a row (``value``) to files that are whole collections, one for each task."""

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = '{"type":"FeatureCollection","features":['
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"value": [start + batch["value"].iloc[0], *("," + batch["value"].iloc[1:])]})
                start = ","
        yield pd.DataFrame({"value": ["]}" if start == "," else start + "]}"]})

    lines.select("value").mapInPandas(framed, "value string").write.mode(mode).text(path)
