"""The obs table of an annotated-matrix file; matrices are never touched.  Needs h5py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading h5ad files needs h5py") from e
    return h5py


def _text(x):
    return None if x is None else x.decode() if isinstance(x, bytes) else str(x)


def _column(node) -> list:
    """Values of a plain, categorical (codes and categories) or masked (values and mask) column."""
    if hasattr(node, "keys"):
        if "categories" in node:
            names = [_text(x) for x in node["categories"][()]]
            return [names[c] if c >= 0 else None for c in node["codes"][()].tolist()]
        return [None if m else _text(v) for v, m in zip(node["values"][()].tolist(), node["mask"][()].tolist(), strict=True)]
    return [_text(x) for x in node[()].tolist()]


def inspect_h5ad(path: str) -> dict:
    with _h5py().File(path, "r") as f:
        obs = f["obs"]
        index = obs.attrs.get("_index", "_index")
        return {"columns": sorted(k for k in obs if k != index), "n_cells": len(obs[index])}


def read_h5ad_obs(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    with _h5py().File(path, "r") as f:
        obs = f["obs"]
        index = obs.attrs.get("_index", "_index")
        names = columns or sorted(k for k in obs if k != index)
        data = {"obs_index": _column(obs[index]), **{n: _column(obs[n]) for n in names}}
    return spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"`{c}` string" for c in data))
