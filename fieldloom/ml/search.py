"""Adaptive search: draws that follow the density of good trials against the others, stopped fold by fold, resumable.

The study's state is a small Parquet table below a lasting folder, one write for each scored fold.  A study that lost its
driver goes on from there: its draws come from the seed and the scores of earlier rounds alone.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.ml.models import CLASSIFIER_PREFIX, SCORERS, SEARCH_SPACE, classifier, draw_params, in_threads, training_rows
from fieldloom.operators.metrics import fold_scores
from fieldloom.operators.sampling import group_folds

STATE = "number int, fold int, score double, classifier string, params string"
TRIALS = "number int, value double, classifier string, params map<string,string>, folds int, reached double"
#: Random trials before the first adaptive round; draws weighed for each value; share of trials that count as good.
STARTUP, CANDIDATES, GOOD_SHARE = 10, 24, 0.25
#: Least width of a kernel on the unit interval.
LEAST_WIDTH = 0.05


class Axis:
    """One parameter's choices on the unit interval (ranges) or as categories (lists)."""

    def __init__(self, choice):
        self.choice = choice
        self.categories = list(choice) if isinstance(choice, list) else None

    def place(self, value) -> float:
        choice = self.choice
        if isinstance(choice, range):
            return (choice.index(value) + 0.5) / len(choice)
        if choice[0] == "log":
            return math.log(value / choice[1]) / math.log(choice[2] / choice[1])
        return (value - choice[0]) / (choice[1] - choice[0])

    def value(self, place: float):
        choice = self.choice
        if isinstance(choice, range):
            return choice[min(int(place * len(choice)), len(choice) - 1)]
        if choice[0] == "log":
            return choice[1] * (choice[2] / choice[1]) ** place
        return choice[0] + place * (choice[1] - choice[0])


def kernel_width(places: Sequence[float]) -> float:
    mean = sum(places) / len(places)
    spread = math.sqrt(sum((p - mean) ** 2 for p in places) / len(places))
    return max(LEAST_WIDTH, spread * len(places) ** -0.2)


def density(at: float, places: Sequence[float]) -> float:
    """A kernel at each place, cut at the ends of the unit interval, and one even share over all of it."""
    total = 1.0
    if places:
        width = kernel_width(places)
        for p in places:
            inside = 0.5 * (math.erf((1 - p) / (width * math.sqrt(2))) + math.erf(p / (width * math.sqrt(2))))
            total += math.exp(-0.5 * ((at - p) / width) ** 2) / (width * math.sqrt(2 * math.pi) * inside)
    return total / (len(places) + 1)


def draw_place(places: Sequence[float], rng: random.Random) -> float:
    """A draw from ``density``."""
    nth = rng.randrange(len(places) + 1)
    if nth == len(places):
        return rng.random()
    width = kernel_width(places)
    while True:
        at = rng.gauss(places[nth], width)
        if 0 <= at <= 1:
            return at


def likelier(good: Sequence, rest: Sequence, choices: Sequence, rng: random.Random):
    """The best of some draws from the good ones' shares, by its share there over its share among the rest."""
    shares = {c: [sum(v == c for v in group) + 1 for group in (good, rest)] for c in choices}
    drawn = rng.choices(list(choices), [shares[c][0] for c in choices], k=CANDIDATES)
    return max(drawn, key=lambda c: shares[c][0] / shares[c][1])


def propose(done: Sequence[Mapping], space: Mapping, classifiers: Sequence[str], rng: random.Random, startup: int = STARTUP) -> tuple[str, dict]:
    """(classifier, parameters) of the next trial.

    ``done`` holds the earlier rounds' trials: classifier, params, value (None where stopped). Good are the best
    quarter of the whole trials, the rest are all others, stopped ones among them.
    """
    whole = sorted((t for t in done if t["value"] is not None), key=lambda t: (-t["value"], t["number"]))
    if len(done) < startup or not whole:
        name = rng.choice(list(classifiers))
        return name, draw_params(space[name], rng)
    good = whole[: math.ceil(GOOD_SHARE * len(whole))]
    best = {t["number"] for t in good}
    rest = [t for t in done if t["number"] not in best]
    name = likelier([t["classifier"] for t in good], [t["classifier"] for t in rest], classifiers, rng)
    params = {}
    for field, choice in space[name].items():
        values = [[t["params"][field] for t in group if t["classifier"] == name] for group in (good, rest)]
        axis = Axis(choice)
        if axis.categories is not None:
            params[field] = likelier(*values, axis.categories, rng)
            continue
        near, far = ([axis.place(v) for v in group] for group in values)
        drawn = [draw_place(near, rng) for _ in range(CANDIDATES)]
        params[field] = axis.value(max(drawn, key=lambda at: density(at, near) / density(at, far)))
    return name, params


def hopeless(scores: Sequence[float], others: Sequence[Sequence[float]]) -> bool:
    """Whether the mean so far lies below the median of the earlier whole trials' means at the same fold."""
    n = len(scores)
    return bool(others) and sum(scores) / n < median(sum(o[:n]) / n for o in others)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """(number, fold, score, classifier, params as JSON) of all folds scored so far."""
    place, system = _files(spark, f"{folder}/scores")
    system.mkdirs(place)
    return spark.read.schema(STATE).option("recursiveFileLookup", True).parquet(f"{folder}/scores")


def study_rows(spark: SparkSession, folder: str, folded: DataFrame, key: str) -> DataFrame:
    """The rows with their folds as the study first wrote them.

    Bagging depends on where rows lie, so they lie by their key: a fold scored again gives the same number.
    """
    path = f"{folder}/rows"
    place, system = _files(spark, f"{path}/_SUCCESS")
    if not system.exists(place):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        folded.repartition(parts, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return spark.read.schema(folded.schema).parquet(path)


def adaptive_search(
    rows: DataFrame,
    key: str,
    label: str,
    group: str,
    folder: str,
    n_trials: int = 100,
    classifiers: Sequence[str] = ("SVC", "RandomForest", "LGBM"),
    space: Mapping | None = None,
    scoring: str = "kappa",
    folds: int = 3,
    seed: int = 42,
    weight: str | None = None,
    batch: int = 4,
    startup: int = STARTUP,
) -> DataFrame:
    """Trials (number, value, classifier, params, folds, reached) of the study that lives in ``folder``.

    Trials run in rounds of ``batch``, side by side; a round's draws and stops depend on earlier rounds only, so
    neither threads nor a restart change them. A trial stops after a fold that leaves its mean below the median of
    the earlier whole ones; it has no value, ``folds`` says how far it got and ``reached`` its mean. Folds that the
    folder holds are not fitted again; call with the same settings, or with more trials: the rows of the first call,
    which the folder keeps, stay the study's. What passes the driver is one number a fold. Null values of the label or the group follow ``group_folds``.
    """
    if scoring not in SCORERS:
        raise ValueError(f"scoring must be one of {sorted(SCORERS)}")
    spark, space, folder = rows.sparkSession, space or SEARCH_SPACE, folder.rstrip("/")
    held = {(r["number"], r["fold"]): r for r in read_state(spark, folder).collect()}
    folded = study_rows(spark, folder, group_folds(rows, group, label, folds, seed), key)

    def score(number: int, fold: int, name: str, params: Mapping) -> float:
        known = held.get((number, fold))
        if known is not None:
            if (known["classifier"], json.loads(known["params"])) != (name, json.loads(json.dumps(params))):
                raise ValueError(f"{folder} holds a study of other settings")
            return known["score"]
        named = {("C" if k == "c" else k): v for k, v in params.items()}
        others = folded.where(F.col("fold") != fold)
        model = classifier(name, named, seed, weight, training_rows(others, weight) if name == "SVC" else None).fit(others)
        out = model.transform(folded.where(F.col("fold") == fold)).select(key, "fold", "prediction", "lc")
        got = float(SCORERS[scoring](fold_scores(out, "lc", "prediction")).first()[0])
        row = spark.createDataFrame([(number, fold, got, name, json.dumps(params))], STATE)
        row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/scores/trial-{number:05d}-fold-{fold}")
        return got

    done: list[dict] = []
    while len(done) < n_trials:
        whole = [t["scores"] for t in done if t["value"] is not None]
        numbers = range(len(done), min(len(done) + batch, n_trials))
        drawn = [propose(done, space, classifiers, random.Random(f"{seed}-{n}"), startup) for n in numbers]

        def one(number: int, name: str, params: dict, whole=whole):
            def run() -> dict:
                scores: list[float] = []
                for fold in range(folds):
                    scores.append(score(number, fold, name, params))
                    if fold + 1 < folds and hopeless(scores, whole):
                        break
                value = sum(scores) / folds if len(scores) == folds else None
                return {"number": number, "classifier": name, "params": params, "scores": scores, "value": value}

            return run

        done += in_threads([one(n, *d) for n, d in zip(numbers, drawn, strict=True)], batch)
    table = [
        (t["number"], t["value"], t["classifier"], {f"{CLASSIFIER_PREFIX[t['classifier']]}_{k}": str(v) for k, v in t["params"].items()},
         len(t["scores"]), sum(t["scores"]) / len(t["scores"]))
        for t in done
    ]
    return spark.createDataFrame(table, TRIALS)
