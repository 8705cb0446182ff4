"""Adaptive search: its draws, its stops, and a study that goes on after a lost driver."""

import random

import numpy as np
import pytest

from fieldloom.ml import models as L
from fieldloom.ml import search as S

SPACE = {"A": {"x": (0.0, 1.0), "n": range(1, 101), "c": ("log", 1e-3, 1e3), "kind": ["p", "q", "r"]}, "B": {"x": (0.0, 1.0)}}


def test_places_go_both_ways():
    for choice, values in ((range(3, 60, 4), list(range(3, 60, 4))), ((0.5, 2.0), [0.5, 1.1, 2.0]), (("log", 1e-4, 1e4), [1e-4, 1.0, 50.0])):
        axis = S.Axis(choice)
        assert [axis.value(axis.place(v)) for v in values] == pytest.approx(values)


@pytest.mark.parametrize("places", [[], [0.0], [0.1, 0.12, 0.9], [0.5] * 7])
def test_density_is_one_and_fits_its_draws(places):
    at = (np.arange(4000) + 0.5) / 4000
    shares = np.array([S.density(a, places) for a in at])
    assert shares.mean() == pytest.approx(1.0, abs=1e-3)
    rng = random.Random(1)
    drawn = np.array([S.draw_place(places, rng) for _ in range(6000)])
    assert (drawn < 0.3).mean() == pytest.approx(shares[at < 0.3].sum() / 4000, abs=0.03)


def study(adaptive, trials=80, seed=0):
    """Values found on a known surface: the best lies at x = 0.8, n = 20, c = 10, kind q of A."""
    done = []
    for number in range(trials):
        rng = random.Random(f"{seed}-{number}")
        name, p = S.propose(done, SPACE, ["A", "B"], rng, startup=10 if adaptive else trials)
        value = -2.0 if name == "B" else -abs(p["x"] - 0.8) - abs(p["n"] - 20) / 100 - abs(np.log10(p["c"]) - 1) / 6 - 0.3 * (p["kind"] != "q")
        done.append({"number": number, "classifier": name, "params": p, "value": value})
    return done


def test_draws_near_the_best():
    gains = [np.mean([t["value"] for t in study(True, seed=s)[40:]]) - np.mean([t["value"] for t in study(False, seed=s)[40:]]) for s in range(5)]
    assert min(gains) > 0.3
    assert study(True) == study(True)


def test_hopeless():
    assert not S.hopeless([0.1], [])
    assert S.hopeless([0.1], [[0.2, 0.9], [0.3, 0.1], [0.05, 0.1]])
    assert not S.hopeless([0.2], [[0.2, 0.9], [0.3, 0.1], [0.05, 0.1]])
    assert S.hopeless([0.3, 0.1], [[0.1, 0.5]])


def test_study_goes_on(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(i, "ab"[i % 2], i % 30, *[float(v) for v in rng.normal(i % 2, 1.0, 3)]) for i in range(120)]
    rows = spark.createDataFrame(data, "id long, lc_name string, grp long, f0 double, f1 double, f2 double")
    table, _ = L.training_table(rows, "id", "lc_name", ["f0", "f1", "f2"], ["grp"])
    space = {"RandomForest": {"max_depth": range(1, 4), "n_estimators": [1, 2], "criterion": ["gini"]}}
    fitted = []
    made = S.classifier

    def counted(*args):
        fitted.append(args)
        if len(fitted) == counted.dies:
            raise RuntimeError("lost")
        return made(*args)

    monkeypatch.setattr(S, "classifier", counted)

    def run(folder, trials, dies=None):
        fitted.clear()
        counted.dies = dies
        out = S.adaptive_search(table, "id", "lc_name", "grp", str(folder), trials, ["RandomForest"], space, folds=2, batch=1, startup=2)
        return sorted(out.collect(), key=lambda r: r["number"])

    whole = run(tmp_path / "whole", 4)
    used = len(fitted)
    assert [r["number"] for r in whole] == [0, 1, 2, 3] and all((r["value"] is None) == (r["folds"] < 2) for r in whole)
    with pytest.raises(RuntimeError):
        run(tmp_path / "lost", 4, dies=4)
    assert run(tmp_path / "lost", 4) == whole and len(fitted) == used - 3
    assert run(tmp_path / "lost", 4) == whole and not fitted
    best = L.best_classifier(spark.createDataFrame(whole, S.TRIALS))
    top = max((r for r in whole if r["value"] is not None), key=lambda r: (r["value"], -r["number"]))
    assert best.getMaxDepth() == int(top["params"]["rf_max_depth"])
    with pytest.raises(ValueError):
        S.adaptive_search(table, "id", "lc_name", "grp", str(tmp_path / "lost"), 4, ["RandomForest"], space, folds=2, seed=7)
