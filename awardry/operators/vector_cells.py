"""Cells of vectors about centres, with bounds by which whole cells can be left out of an exact search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that centres are fitted on at most, rounds of fitting, rows of a cell about, and cells at most.
SAMPLE, ROUNDS, ROWS, MOST = 8192, 8, 256, 512
#: Angles are this much greater than computed, so that rounding leaves nothing out.
SLACK = 1e-6
#: The cell of zero vectors, which have no angle.
ZERO = -1


def unit(vectors: pd.Series) -> np.ndarray:
    """A matrix of vectors of length 1; zero vectors stay zero."""
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def fit_centres(vectors: DataFrame, vector: str = "vec", key: str = "id", rows: int = ROWS) -> np.ndarray:
    """Centres of length 1 for a table: one for ``rows`` rows about, MOST at most, fitted on the SAMPLE vectors whose keys have the least hashes."""
    n = vectors.count()
    sample = vectors.select(key, vector).orderBy(F.xxhash64(key), key).limit(SAMPLE).toPandas()
    if sample.empty:
        return np.zeros((0, 0))
    m = unit(sample[vector])
    m = m[np.linalg.norm(m, axis=1) > 0]
    k = min(MOST, max(1, n // rows), len(m))
    centres = m[np.linspace(0, len(m) - 1, k).astype(int)] if k else np.zeros((0, 0))
    for _ in range(ROUNDS if k > 1 else 0):
        near = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms == 0, 1, norms), centres)
    return centres


def with_cells(df: DataFrame, centres: np.ndarray, vector: str = "vec") -> DataFrame:
    """df with cell, the number of the nearest centre (ZERO for a zero vector), and angle, how far from it."""
    held = df.sparkSession.sparkContext.broadcast(centres)  # MOST vectors at most

    @F.pandas_udf("cell int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "angle": pd.Series([], dtype=float)})
        m = unit(vectors)
        zero = np.linalg.norm(m, axis=1) == 0
        if not len(held.value):
            return pd.DataFrame({"cell": np.full(len(m), ZERO, np.int32), "angle": 0.0})
        cosines = m @ held.value.T
        cell = cosines.argmax(1)
        angle = np.arccos(np.clip(cosines[np.arange(len(m)), cell], -1, 1))
        return pd.DataFrame({"cell": np.where(zero, ZERO, cell).astype(np.int32), "angle": np.where(zero, 0.0, angle)})

    return df.withColumn("__n", nearest(vector)).select(*df.columns, "__n.cell", "__n.angle")


@dataclass
class Cells:
    """What is known of each cell: its number, radius and the greatest other score of its rows."""

    centres: np.ndarray
    numbers: np.ndarray
    radius: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, centres: np.ndarray, rest: str = "rest") -> Cells:
        """From a table of with_cells; a row for each cell comes to the driver."""
        told = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.max(rest).alias("rest")).sort("cell").toPandas()
        return cls(centres, told["cell"].to_numpy(int), told["radius"].to_numpy(float), told["rest"].to_numpy(float))

    def bounds(self, queries: np.ndarray, weight: float) -> np.ndarray:
        """For each query (of length 1, or zero) and cell: no row's weight * cosine + rest is greater.

        By the triangle inequality of angles a row is no nearer to the query than the cell's centre is, less the radius.
        """
        if weight < 0:
            return np.full((len(queries), len(self.numbers)), np.inf)
        best = np.zeros((len(queries), len(self.numbers)))
        real = self.numbers != ZERO
        if real.any():
            angle = np.arccos(np.clip(queries @ self.centres[self.numbers[real]].T, -1, 1))
            best[:, real] = np.cos(np.maximum(angle - self.radius[real] - SLACK, 0))
        best[np.linalg.norm(queries, axis=1) == 0] = 0
        return best * weight + self.rest
