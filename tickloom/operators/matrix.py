"""Projection of long covariance matrices to positive semidefinite ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def project(matrix: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, eps)) @ vectors.T


def make_psd(long: DataFrame, value: str, eps: float = 1e-6) -> DataFrame:
    """(day, sym_i, sym_j, value) with sym_i <= sym_j -> the same of the nearest matrix whose eigenvalues are
    eps or more; one matrix of K x K symbols a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([pdf.sym_i, pdf.sym_j]).astype(str), return_inverse=True)
        i, j = at[: len(pdf)], at[len(pdf) :]
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = pdf[value].to_numpy(float)
        a, b = np.triu_indices(len(names))
        return pd.DataFrame({"day": pdf.day.iloc[0], "sym_i": names[a], "sym_j": names[b], value: project(m, eps)[a, b]})

    return long.select("day", "sym_i", "sym_j", value).groupBy("day").applyInPandas(run, f"day string, sym_i string, sym_j string, {value} double")
