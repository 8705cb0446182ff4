"""Interaction audit of filters: what each one removes in every order, and its Shapley value from the potential."""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACE, cut


def own_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that need a document's own text only."""
    found = F.array_remove(F.split(text, SPACE, -1), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: filter i fails), n, good, toxic: documents and labelled documents with this mask.

    Texts count as equal when their SHA-256 is. A row is a copy if a row with a smaller doc_id has its text; rows
    that repeat one id are no copies of each other, and a null id is neither smaller nor larger than any other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum(F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in own_failures(F.col("text")).items())
    rows = rows.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = rows.where("id IS NOT NULL").join(marks, "id", "left").fillna(False, ["good", "toxic"])

    # one row per id keeps the layout of the join; the next step leaves one row per text, part and label
    each = marked.groupBy("id", "part", "mask", "digest", "good", "toxic").agg(F.count("*").alias("c"))
    groups = each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("c").alias("n"), F.min(F.struct("id", "c")).alias("low"))
    groups = cut(groups, "audit-texts")
    first = groups.groupBy("digest").agg(F.min("low.id").alias("first"))
    groups = groups.join(first, "digest").withColumn("kept", F.when(F.col("low.id") == F.col("first"), F.col("low.c")).otherwise(0))
    parts = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("kept").cast("long").alias("n")),
        F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("kept")).alias("n")),
    )
    known = groups.select("part", "good", "toxic", F.explode(parts).alias("p")).select("part", "p.mask", "p.n", "good", "toxic")
    nameless = rows.where("id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n"))
    every = known.where("n > 0").union(nameless.select("part", "mask", "n", F.lit(False), F.lit(False)))
    return every.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def potential(worth: Column, filters: int) -> Column:
    """Hart-Mas-Colell potential of a game, times filters!, for every coalition (an array by its bits).

    P(none) = 0 and P(S) = (v(S) + sum over i in S of P(S without i)) / |S|. A coalition's parts have smaller
    numbers, so one pass over the numbers fills the array; with the factor all values are whole.
    """
    factor = F.lit(math.factorial(filters)).cast("long")

    def step(seen: Column, s: Column) -> Column:
        before = [F.when(s.bitwiseAND(1 << i) > 0, F.get(seen, s.bitwiseXOR(F.lit(1 << i)))).otherwise(F.lit(0).cast("long")) for i in range(filters)]
        total = factor * F.get(worth, s) + sum(before)
        return F.concat(seen, F.array(F.call_function("div", total, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), step)


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """For each part and order of the filters one row per step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (the filter's removed, summed over all orders).

    ``counts`` is the output of ``failure_counts``: at most 2^filters rows for each part. The removal game gives a
    coalition the documents that any of its filters fails; the difference of two coalitions is a step, and the
    potential of all filters less that without the filter its Shapley value.
    """
    size = len(names)
    coalition = F.explode(F.sequence(F.lit(0), F.lit((1 << size) - 1))).alias("s")
    fails = F.col("mask").bitwiseAND(F.col("s")) > 0
    worth = counts.select("*", coalition).groupBy("part", "s").agg(
        F.sum("n").alias("total"), *[F.sum(F.when(fails, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    )
    games = worth.groupBy("part").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("v"))
    games = games.select("part", "total", *[F.col(f"v.{c}").alias(c) for c in ("n", "good", "toxic")])
    games = games.withColumn("p", potential(F.col("n"), size))

    steps = []
    for order in permutations(range(size)):
        for at, i in enumerate(order):
            steps.append({"o": "".join(names[j] for j in order), "step": at + 1, "i": 1 << i, "before": sum(1 << j for j in order[:at])})
    step = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,step:int,i:int,before:int>>")
    rows = games.select("*", F.explode(step).alias("t")).select("*", "t.*").withColumn("after", F.col("before").bitwiseOR(F.col("i")))
    every = F.lit((1 << size) - 1)

    def at(array: str, place: Column) -> Column:
        return F.get(F.col(array), place)

    removed = at("n", F.col("after")) - at("n", F.col("before"))
    return rows.select(
        "part", F.col("o").alias("filter_order"), "step",
        (F.col("total") - at("n", F.col("after"))).alias("kept"), removed.alias("removed"), (at("n", F.col("i")) - removed).alias("redundant"),
        (at("n", every) - at("n", every.bitwiseXOR(F.col("i")))).alias("unique_fails"),
        *[(at(c, F.col("after")) - at(c, F.col("before"))).alias(f"{c}_lost") for c in ("good", "toxic")],
        (at("p", every) - at("p", every.bitwiseXOR(F.col("i")))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``, one part for each lang (null: empty text).

    Null texts are empty ones; a document counts as good or toxic if any of its label rows says so, null labels
    say nothing; repeated rows count as often as they come; an empty table gives no rows; only doc_id, text and lang
    are read. The documents are read once; what is shuffled is some 60 bytes for each, by id and then by digest
    after equal texts were put together in the tasks that read them.
    """
    return audit(failure_counts(docs, labels))
