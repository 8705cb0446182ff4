"""Kernel machines: random features stand for the kernel, a linear machine is fitted on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task maps at a time.
SLICE = 1024
KERNELS = ("linear", "rbf", "poly")


def fourier_features(x: np.ndarray, gamma: float, components: int, seed: int) -> np.ndarray:
    """Products of two rows come near exp(-gamma |a - b|²); orthogonal directions in blocks, one phase each."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    blocks = []
    for _ in range(-(-components // width)):
        turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
        blocks.append(turn * np.sqrt(rng.chisquare(width, width))[:, None])
    directions = np.concatenate(blocks)[:components] * np.sqrt(2 * gamma)
    return np.sqrt(2 / components) * np.cos(x @ directions.T + rng.uniform(0, 2 * np.pi, components))


def polynomial_sketch(x: np.ndarray, gamma: float, degree: int, components: int, seed: int) -> np.ndarray:
    """Products of two rows come near (gamma a·b)^degree: count sketches of each factor, multiplied as spectra."""
    rng = np.random.default_rng(seed)
    out = None
    for _ in range(degree):
        place, sign = rng.integers(0, components, x.shape[1]), rng.choice([-1.0, 1.0], x.shape[1])
        sketch = np.zeros((len(x), components))
        np.add.at(sketch.T, place, (x * sign * np.sqrt(gamma)).T)
        spectrum = np.fft.rfft(sketch, axis=1)
        out = spectrum if out is None else out * spectrum
    made = np.fft.irfft(out, components, axis=1)
    # what the transform leaves of cells that no product falls into is noise; the machine would scale it up
    return np.where(np.abs(made) < 1e-12 * np.abs(made).max(1, keepdims=True), 0.0, made)


def mapped_slices(rows: np.ndarray, kernel: str, gamma: float, degree: int, components: int, seed: int) -> Iterator[np.ndarray]:
    """The features of SLICE rows at a time, so that memory does not follow the batch."""
    for at in range(0, len(rows), SLICE):
        part = rows[at : at + SLICE]
        yield fourier_features(part, gamma, components, seed) if kernel == "rbf" else polynomial_sketch(part, gamma, degree, components, seed)


def kernel_features(x: Column, kernel: str, gamma: float, degree: int, components: int, seed: int) -> Column:
    """The features of an array of doubles. They depend on the parameters only, so every task makes the same ones."""
    if kernel == "linear":
        return x

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            rows = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 1))
            for made in mapped_slices(rows, kernel, gamma, degree, components, seed):
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * components), pa.array(made.ravel()))

    return features(x)


class KernelMachine(Estimator):
    """Support-vector machine, one class against the rest. ``gamma`` is scale, auto or a number.

    The loss is averaged over the training rows, so the regularisation is 1 / (C x rows); ``rows`` is their number or
    sum of weights. ``components`` bounds the width, and with it the model, for any number of rows.
    """

    def __init__(self, rows: float, C: float = 1.0, kernel: str = "linear", degree: int = 3, gamma: str | float = "scale", components: int = 512, max_iter: int = 20, weight: str | None = None, features: str = "features", label: str = "lc", seed: int = 42):
        super().__init__()
        if kernel not in KERNELS or degree < 1 or C <= 0:
            raise ValueError(f"kernel one of {KERNELS}, degree at least 1, C above 0: {kernel}, {degree}, {C}")
        self.rows, self.C, self.kernel, self.degree, self.gamma, self.components = rows, C, kernel, degree, gamma, components
        self.max_iter, self.weight, self.features, self.label, self.seed = max_iter, weight, features, label, seed

    def _width(self, dataset: DataFrame) -> float:
        """The kernel's gamma; ``scale`` is 1 / (features x variance of all values)."""
        if self.gamma not in ("scale", "auto"):
            return float(self.gamma)
        x = vector_to_array(self.features)
        zero = F.lit(0.0)
        sums = dataset.select(F.size(x).alias("n"), F.aggregate(x, zero, lambda a, v: a + v).alias("s"), F.aggregate(x, zero, lambda a, v: a + v * v).alias("q"))
        row = sums.agg(F.max("n").alias("width"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
        spread = row["q"] / row["n"] - (row["s"] / row["n"]) ** 2
        return 1.0 / (row["width"] * spread) if self.gamma == "scale" and spread > 0 else 1.0 / row["width"]

    def _fit(self, dataset: DataFrame) -> KernelModel:
        gamma = 1.0 if self.kernel == "linear" else self._width(dataset)
        machine = LinearSVC(
            regParam=1.0 / (self.C * self.rows), maxIter=self.max_iter, standardization=self.kernel == "linear",
            **({"weightCol": self.weight} if self.weight else {}),
        )
        model = KernelModel(None, self.kernel, gamma, self.degree, self.components, self.features, self.seed)
        rest = OneVsRest(classifier=machine, parallelism=4, featuresCol="_mapped", labelCol=self.label, **({"weightCol": self.weight} if self.weight else {}))
        model.fitted = rest.fit(model.mapped(dataset))
        return model


class KernelModel(Model):
    def __init__(self, fitted, kernel: str, gamma: float, degree: int, components: int, features: str, seed: int):
        super().__init__()
        self.fitted, self.kernel, self.gamma, self.degree, self.components, self.features, self.seed = fitted, kernel, gamma, degree, components, features, seed

    def mapped(self, dataset: DataFrame) -> DataFrame:
        if self.kernel == "linear":
            return dataset.withColumn("_mapped", F.col(self.features))
        x = kernel_features(vector_to_array(self.features), self.kernel, self.gamma, self.degree, self.components, self.seed)
        return dataset.withColumn("_mapped", array_to_vector(x))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(self.mapped(dataset)).drop("_mapped")
