"""Models on a feature panel: lasso, least squares, boosted trees and a small network, with predictions as a signal frame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PanelModel:
    """``fit(rows, features, label)``, ``predict(rows)`` gives ``(datetime, vt_symbol, signal)``, ``detail()`` describes the fit.

    Rows where a feature or, in fitting, the label is missing or not finite are left out.
    """

    def __init__(self):
        self.features: list[str] = []
        self.model: PipelineModel | None = None

    def _stage(self, label: str):
        raise NotImplementedError

    def _finite(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        for n in names:
            df = df.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) != F.lit(float("inf"))))
        return df

    def fit(self, rows: DataFrame, features: Sequence[str], label: str = "label", valid: DataFrame | None = None) -> PanelModel:
        self.features = list(features)
        data = self._finite(self._training(rows, valid), [*features, label])
        self.model = Pipeline(stages=[VectorAssembler(inputCols=self.features, outputCol="_x"), self._stage(label)]).fit(data)
        return self

    def _training(self, rows: DataFrame, valid: DataFrame | None) -> DataFrame:
        return rows if valid is None else rows.unionByName(valid).dropDuplicates(["datetime", "vt_symbol"])

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit the model first")
        return self.model.transform(self._finite(rows, self.features)).select("datetime", "vt_symbol", F.col("prediction").alias("signal"))

    def detail(self) -> pd.DataFrame:
        fitted = self.model.stages[-1]
        weights = fitted.coefficients.toArray() if hasattr(fitted, "coefficients") else fitted.featureImportances.toArray()
        return pd.DataFrame({"feature": self.features, "weight": weights}).sort_values("weight", key=np.abs, ascending=False, ignore_index=True)


class Lasso(PanelModel):
    """Least squares with an L1 penalty, no intercept, on training and validation rows together."""

    def __init__(self, alpha: float = 5e-4, iterations: int = 1000):
        super().__init__()
        self.alpha, self.iterations = alpha, iterations

    def _stage(self, label):
        return LinearRegression(featuresCol="_x", labelCol=label, elasticNetParam=1.0, regParam=self.alpha, fitIntercept=False, standardization=False, maxIter=self.iterations)


class LeastSquares(PanelModel):
    """Ordinary least squares; ``classify`` turns predictions beyond the edge into BUY and SELL."""

    def _stage(self, label):
        return LinearRegression(featuresCol="_x", labelCol=label, regParam=0.0, solver="normal")

    @staticmethod
    def classify(signals: DataFrame, edge: float = 0.005) -> DataFrame:
        return signals.withColumn("action", F.when(F.col("signal") >= edge, "BUY").when(F.col("signal") <= -edge, "SELL").otherwise("HOLD"))


class BoostedTrees(PanelModel):
    """Gradient-boosted trees that stop early on the validation rows."""

    def __init__(self, trees: int = 50, depth: int = 5, step: float = 0.1, seed: int = 0):
        super().__init__()
        self.trees, self.depth, self.step, self.seed, self.early = trees, depth, step, seed, False

    def _training(self, rows, valid):
        self.early = valid is not None
        return rows if valid is None else rows.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))

    def _stage(self, label):
        made = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, seed=self.seed)
        return made.setValidationIndicatorCol("_valid") if self.early else made


class Network:
    """A network of linear, normalising and ReLU layers, trained by Adam on a bounded sample of rows with the best
    validation state kept; predictions run on the executors."""

    def __init__(self, hidden: Sequence[int] = (64,), steps: int = 500, batch: int = 2000, rate: float = 0.001, seed: int = 0, sample_rows: int = 200_000):
        self.hidden, self.steps, self.batch, self.rate, self.seed, self.sample_rows = tuple(hidden), steps, batch, rate, seed, sample_rows
        self.features: list[str] = []
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        self.scale: tuple[np.ndarray, np.ndarray] | None = None

    def _sample(self, rows: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray]:
        data = PanelModel._finite(self, rows, [*self.features, label]).select(*self.features, label)
        n = data.count()
        data = data.sample(min(1.0, self.sample_rows / n), self.seed) if n > self.sample_rows else data
        a = data.toPandas().to_numpy("float64")
        return a[:, :-1], a[:, -1]

    @staticmethod
    def _forward(x, layers):
        states = [x]
        for i, (w, b) in enumerate(layers):
            x = x @ w + b
            x = np.maximum(x, 0) if i + 1 < len(layers) else x
            states.append(x)
        return states

    def fit(self, rows: DataFrame, features: Sequence[str], label: str = "label", valid: DataFrame | None = None) -> Network:
        self.features = list(features)
        x, y = self._sample(rows, label)
        vx, vy = self._sample(valid, label) if valid is not None else (x, y)
        self.scale = x.mean(axis=0), x.std(axis=0) + 1e-12
        x, vx = ((a - self.scale[0]) / self.scale[1] for a in (x, vx))
        rng = np.random.default_rng(self.seed)
        sizes = (x.shape[1], *self.hidden, 1)
        layers = [(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        moments = [[np.zeros_like(p) for _ in range(2)] for layer in layers for p in layer]
        best, kept = np.inf, layers
        for step in range(1, self.steps + 1):
            at = rng.integers(0, len(x), min(self.batch, len(x)))
            states = self._forward(x[at], layers)
            slope = 2 * (states[-1] - y[at, None]) / len(at)
            slopes = []
            for i in range(len(layers) - 1, -1, -1):
                slopes = [states[i].T @ slope, slope.sum(axis=0), *slopes]
                slope = slope @ layers[i][0].T * (states[i] > 0) if i else slope
            flat = []
            for p, g, m in zip((p for layer in layers for p in layer), slopes, moments, strict=True):
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                flat.append(p - self.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
            layers = list(zip(flat[::2], flat[1::2], strict=True))
            if step % 20 == 0 and (loss := float(((self._forward(vx, layers)[-1][:, 0] - vy) ** 2).mean())) < best:
                best, kept = loss, layers
        self.layers = kept
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        features, layers, (mean, dev), forward = self.features, self.layers, self.scale, self._forward

        def run(batches):
            for b in batches:
                b["signal"] = forward((b[features].to_numpy("float64") - mean) / dev, layers)[-1][:, 0]
                yield b[["datetime", "vt_symbol", "signal"]]

        return PanelModel._finite(self, rows, features).select("datetime", "vt_symbol", *features).mapInPandas(run, "datetime timestamp_ntz, vt_symbol string, signal double")
