"""Result bundles: tables as Parquet and CSV with a manifest, published whole or not at all."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import shutil
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = lambda kind: kind.startswith(("array", "struct", "map"))
    return df.select(*[(F.to_json(c).alias(c) if nested(kind) else F.col(c)) for c, kind in df.dtypes])


def write_frame(df: DataFrame, path: str) -> None:
    """<path>.parquet (zstd) and <path>.csv, both folders of part files."""
    df.write.option("compression", "zstd").parquet(f"{path}.parquet")
    for_csv(df).write.csv(f"{path}.csv", header=True)


def write_json(value, path: str) -> None:
    """JSON without NaN, replaced in one step."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=1, sort_keys=True, allow_nan=False)
    os.replace(part, path)


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def snapshot(paths: list[str]) -> dict[str, str]:
    return {p: file_sha256(p) for p in paths}


def verify(before: dict[str, str]) -> None:
    for path, digest in before.items():
        if file_sha256(path) != digest:
            raise RuntimeError(f"{path} changed during the run")


def frame_digest(df: DataFrame) -> str:
    """A hash of schema and rows that no order of rows changes: sums of two independent halves of each row's hash."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    half = lambda a: F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(half(1).alias("a"), half(16).alias("b")).agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{sums[0]}|{sums[1]}|{sums[2]}".encode()).hexdigest()


@contextmanager
def bundle(path: str, inputs: list[str], parameters: dict):
    """A staging folder that becomes `path` when all went well and no input changed; an existing path is refused."""
    if os.path.exists(path):
        raise FileExistsError(path)
    before, stage = snapshot(inputs), f"{path}.{uuid.uuid4().hex}.stage"
    os.makedirs(stage)
    try:
        yield stage
        verify(before)
        written = {os.path.relpath(os.path.join(d, f), stage): file_sha256(os.path.join(d, f)) for d, _, files in os.walk(stage) for f in files if not f.startswith((".", "_"))}
        manifest = {"schema_version": 1, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "python": platform.python_version(), "inputs": before, "parameters": parameters, "outputs": written}
        write_json(manifest, os.path.join(stage, "manifest.json"))
        if os.path.exists(path):
            raise FileExistsError(path)
        os.rename(stage, path)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def read_manifest(path: str) -> dict:
    def no_repeats(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key occurs twice in the manifest")
        return dict(pairs)

    with open(path, encoding="utf-8") as f:
        held = json.load(f, object_pairs_hook=no_repeats)
    if held.get("schema_version") != 1:
        raise ValueError("the manifest's schema_version isn't 1")
    return held
