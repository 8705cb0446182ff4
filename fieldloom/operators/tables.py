"""Counts, shares, merges, de-duplication, reshaping and ranked selections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.scale import add_slice, join_side, number_rows, pin_small, slice_bounds
from fieldloom.session import reliable

# --- counts and shares ------------------------------------------------------


def count_by(df: DataFrame, keys: Sequence[str], counted: str | None = None, out: str = "n") -> DataFrame:
    """Non-null counts per key; rows with a null key are left out."""
    rows = df.na.drop(subset=list(keys))
    return rows.groupBy(*keys).agg(F.count(counted or F.lit(1)).alias(out))


def class_share(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of the total per class, largest first."""
    counts = count_by(df, [key], out="count")
    total = counts.agg(F.sum("count"))
    shares = counts.withColumn("percentage", F.col("count") / total.scalar() * 100)
    return shares.orderBy(F.desc("percentage"), key)


def share_pred_vs_actual(pred: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Class shares of predictions and of training rows under a ``model`` tag."""

    def shares(df: DataFrame, tag: str) -> DataFrame:
        counts = count_by(df, [key], out="_n")
        total = df.agg(F.count(F.lit(1))) if tag == "prediction" else counts.agg(F.sum("_n"))
        return counts.select(key, (F.col("_n") / total.scalar()).alias("percent"), F.lit(tag).alias("model"))

    return shares(pred, "prediction").unionByName(shares(actual, "training data"))


def rate_within(df: DataFrame, parent: str, child: str, parent_counted: str) -> DataFrame:
    """Rows per (parent, child) over the non-null ``parent_counted`` rows per parent.

    Everything is pre-aggregated to (parent, child) before the second sum, so a
    parent with most of the rows costs no more than its number of children.
    """
    pairs = df.where(F.col(parent).isNotNull()).groupBy(parent, child).agg(
        F.count(child).alias("_n"), F.count(parent_counted).alias("_d")
    )
    per_parent = Window.partitionBy(parent)
    rated = pairs.withColumn("_all", F.sum("_d").over(per_parent)).where(F.col(child).isNotNull())
    return rated.select(parent, child, F.try_divide(F.col("_n"), F.col("_all")).alias("rate"))


def null_counts(df: DataFrame) -> DataFrame:
    """Rows (column, nulls) for every column, from one pass."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.unpivot([], [f"`{c}`" for c in df.columns], "column", "nulls")


def null_shares(df: DataFrame) -> DataFrame:
    one = df.agg(
        *[F.avg(F.when(F.col(f"`{c}`").isNull(), 1.0).otherwise(0.0)).alias(c) for c in df.columns]
    )
    return one.unpivot([], [f"`{c}`" for c in df.columns], "column", "null_share")


def drop_sparse_columns(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Keep the columns whose null share is below the limit."""
    shares = {r["column"]: r["null_share"] for r in null_shares(df).collect()}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if (shares[c] or 0.0) < limit])


# --- merging ----------------------------------------------------------------


def merge_bands(tables: Sequence[DataFrame], keys: Sequence[str], unique: bool = True) -> DataFrame:
    """Full outer merge of per-band tables on keys that may be null.

    With ``unique`` keys the tables are stacked and grouped: one shuffle for all
    bands, nulls match nulls, and a repeated key raises.  Otherwise repeated keys
    multiply as a merge does (see ``merge_repeated``).
    """
    keys = list(keys)
    if not unique:
        return merge_repeated(tables, keys)
    values = [[c for c in t.columns if c not in keys] for t in tables]
    tagged = [t.withColumn("_band", F.lit(i)) for i, t in enumerate(tables)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    twice = reduce(
        lambda a, b: a | b, [F.count_if(F.col("_band") == i) > 1 for i in range(len(tables))]
    )
    merged = stacked.groupBy(*keys).agg(
        *[F.max(F.col(f"`{c}`")).alias(c) for vs in values for c in vs], twice.alias("_twice")
    )
    refused = F.raise_error(F.lit("merge_bands: a key repeats within one band"))
    return merged.where(F.when(F.col("_twice"), refused.cast("boolean")).otherwise(True)).drop("_twice")


#: Result rows that one row of an input makes in one step.
FAN = 4096


def merge_repeated(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of any number of tables, null keys meeting null keys; each input is read once.

    The tables are stacked and written.  Of a key, table i holds n_i rows, numbered 0 to n_i - 1, and the result
    has one row for each choice of a row from every table that holds the key: place p of the product of all
    max(n_i, 1) takes row (p // stride_i) % n_i of table i.  Each row goes to its places and one grouping by
    (key, place) puts them together, so a key with most of the rows is spread over its places; numbers come from
    counts by input slice.  What is shuffled is the result's size times the number of tables.
    """
    keys, n = list(keys), len(tables)
    values = [[c for c in t.columns if c not in keys] for t in tables]
    tagged = [
        t.select(
            F.struct(*[F.col(f"`{k}`") for k in keys]).alias("_k"), F.lit(i).alias("_side"), F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_id"), *[F.col(f"`{c}`") for c in vs],
        )
        for i, (t, vs) in enumerate(zip(tables, values, strict=True))
    ]
    rows = reliable(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged))
    counts = rows.groupBy("_k").agg(*[F.greatest(F.count_if(F.col("_side") == i), F.lit(1)).alias(f"_n{i}") for i in range(n)])
    numbered = number_rows(rows, ["_k", "_side"], ["_part"], [F.col("_id")], "_at").join(counts, "_k")

    def pick(columns: Sequence[Column]) -> Column:
        return F.get(F.array(*columns), F.col("_side"))

    one = F.lit(1).cast("bigint")
    stride = pick([reduce(lambda a, b: a * b, [F.col(f"_n{j}") for j in range(i)], one) for i in range(n)])
    others = reduce(lambda a, b: a * b, [F.col(f"_n{i}") for i in range(n)]) / pick([F.col(f"_n{i}") for i in range(n)])
    numbered = numbered.select(
        "_k", (F.col("_at") - 1).alias("_at"), stride.alias("_stride"), others.cast("bigint").alias("_others"),
        pick([F.col(f"_n{i}") for i in range(n)]).alias("_mine"), *[F.col(f"`{c}`") for vs in values for c in vs],
    )
    blocks = numbered.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_others") - 1, F.lit(FAN).cast("bigint"))))
    spread = blocks.withColumn("_q", F.explode(F.sequence("_b", F.least(F.col("_b") + FAN, F.col("_others")) - 1)))
    place = F.floor(F.col("_q") / F.col("_stride")) * F.col("_stride") * F.col("_mine") + F.col("_at") * F.col("_stride") + F.col("_q") % F.col("_stride")
    merged = spread.withColumn("_p", place).groupBy("_k", "_p").agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for vs in values for c in vs])
    return merged.select("_k.*", *[F.col(f"`{c}`") for vs in values for c in vs])


def join_first_match(
    left: DataFrame, right: DataFrame, on: str, order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Inner join with the first right row per key.

    The first row is a ``min`` of a struct: combined before the shuffle, so a
    right key with most of the rows is one row by the time it moves.
    """
    first = right.groupBy(on).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    )
    return left.join(first.select(on, "_first.*"), on)


def dedupe_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(key, "_first.*").select(*df.columns)


def stack_layers(*layers: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def point_union(layers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Full outer union of point layers on exact coordinates.

    Each layer's columns get the layer's suffix.
    """
    named = [
        layer.select(
            "x", "y", *[F.col(f"`{c}`").alias(f"{c}_{suffix}") for c in layer.columns if c not in ("x", "y")]
        )
        for suffix, layer in layers
    ]
    return merge_repeated(named, ["x", "y"])


# --- numbering ----------------------------------------------------------------


def row_index(df: DataFrame, key: str, out: str = "row_index", start: int = 0) -> DataFrame:
    """Position by a unique numeric key, numbered slice by slice."""
    sliced = add_slice(df, key, slice_bounds(df, key))
    numbered = number_rows(sliced, [], ["_slice"], [F.col(key)], out)
    return numbered.withColumn(out, F.col(out) - 1 + start).drop("_slice")


def split_halves(df: DataFrame, key: str, out: str = "part") -> DataFrame:
    """First and second half by a unique key; the odd row goes to part 2."""
    numbered = row_index(df, key, "_at")
    n = df.agg(F.count(F.lit(1)))
    return numbered.withColumn(
        out, F.when(F.col("_at") < F.floor(n.scalar() / 2), 1).otherwise(2)
    ).drop("_at")


# --- ranked selections ----------------------------------------------------------


def top_k(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def first_containing(df: DataFrame, name: str, part: str) -> DataFrame:
    """The first name, in order, that contains the text."""
    return df.where(F.col(name).contains(part)).agg(F.min(name).alias(name)).where(F.col(name).isNotNull())


def substring_join(
    paths: DataFrame,
    path: str,
    names: DataFrame,
    name: str,
    rank: str | None = None,
    first: int | None = None,
) -> DataFrame:
    """Rows (name, path) for every name contained in a path; unmatched names stay.

    ``first`` keeps that many names in the order of ``rank``.  A path gives its
    pieces of each length that a name has, and those meet the names by an equality
    join, whatever their number; only the distinct lengths reach the driver, and the pieces are never broadcast.
    """
    if first is not None:
        names = names.orderBy(rank, name).limit(first)
    names = join_side(names.select(name))
    lengths = [r[0] for r in names.select(F.length(name)).distinct().na.drop().collect()]
    none = F.array().cast("array<string>")

    def pieces(n: int) -> Column:
        last = F.length(path) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col(path), i, F.lit(n)))).otherwise(none)

    parts = F.array_distinct(F.concat(none, *[pieces(n) for n in lengths]))
    hits = paths.select(path, F.explode(parts).alias(name)).join(names, name).select(name, path)
    # found names are no more than the names themselves
    missing = names.join(hits.select(name).distinct(), name, "left_anti")
    return hits.unionByName(missing, allowMissingColumns=True)


def best_trial(trials: DataFrame, value: str, tie: str, by: str | None = None) -> DataFrame:
    """Trial with the highest value, overall or per classifier; ties go to the lowest number."""
    keys = [by] if by else []
    rest = [c for c in trials.columns if c not in keys]
    best = trials.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(tie))).alias("_best")
    )
    return best.select(*keys, "_best.*")


# Short names of classifiers inside parameter keys, and the keys that hold whole numbers; fixed values.
CLASSIFIER_PREFIX = {"RandomForest": "rf", "LGBM": "lgbm", "SVC": "svc"}
INTEGER_PARAMS = [
    "num_leaves",
    "max_depth",
    "min_samples_split",
    "n_estimators",
    "min_samples_leaf",
    "min_data_in_leaf",
    "bagging_freq",
]


def trial_params(trials: DataFrame, classifier: str = "classifier", params: str = "params") -> DataFrame:
    """Own parameters of each trial's classifier: prefix off, whole numbers as such, ``c`` as ``C``."""
    known = F.create_map(*[F.lit(v) for kv in CLASSIFIER_PREFIX.items() for v in kv])
    prefix = F.concat(F.lower(F.coalesce(known[F.col(classifier)], F.col(classifier))), F.lit("_"))
    own = F.map_filter(params, lambda k, v: F.startswith(k, prefix))
    bare = F.transform_keys(own, lambda k, v: F.replace(k, prefix, F.lit("")))
    typed = F.transform_values(
        bare,
        lambda k, v: F.when(k.isin(INTEGER_PARAMS), v.cast("double").cast("bigint").cast("string")).otherwise(v),
    )
    named = F.transform_keys(typed, lambda k, v: F.when(k == "c", F.lit("C")).otherwise(k))
    return trials.withColumn(params, named)


# --- reshaping --------------------------------------------------------------------


def wide_to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], sep: str = "-", value: str = "value"
) -> DataFrame:
    """Columns ``<stub><sep><suffix>`` to rows (ids, stub, suffix, value)."""
    long = df.unpivot(list(ids), [f"`{c}`" for c in columns], "_name", value)
    at = F.split("_name", sep, 2)
    return long.select(*ids, at[0].alias("stub"), at[1].alias("suffix"), value)


def union_names(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.union(second).distinct()


def top_features(
    importance: DataFrame, name: str, value: str, k: int, without: Iterable[str] = ()
) -> DataFrame:
    """The ``k`` most important features, then the unwanted names removed."""
    top = top_k(importance, value, name, k)
    keep: Column = F.lit(True)
    for pattern in without:
        keep = keep & ~F.col(name).rlike(pattern)
    return top.where(keep)


def target_compare(scores: DataFrame, targets: DataFrame, metric: str, value: str) -> DataFrame:
    """Scores next to the target of their metric."""
    small, _ = pin_small(targets)
    return scores.join(small, metric, "left").withColumn("above_target", F.col(value) > F.col("target"))
