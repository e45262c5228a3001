"""Catalogue files of several formats, side files of a domain, JSON results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.model import Domain


def read_any(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A table by its suffix: .parquet, .csv, .tsv, .json (records or lines), .jsonl; others are sniffed.

    Broken JSON lines become rows of nulls with the text in ``_corrupt_record``; blank lines are skipped.
    """
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix in (".csv", ".tsv"):
        df = spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix == ".tsv" else ",", multiLine=True, escape='"')
    elif suffix in (".jsonl", ".ndjson"):
        df = spark.read.json(path, mode="PERMISSIVE")
    elif suffix == ".json":
        # A file of one array or object spans lines; a file of lines doesn't.
        first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
        text = first[0][0].strip() if first else ""
        try:
            lines = isinstance(json.loads(text), dict)
        except ValueError:
            lines = False
        df = spark.read.json(path, mode="PERMISSIVE", multiLine=not lines)
    elif suffix == ".parquet":
        df = spark.read.parquet(path)
    else:
        df = _sniff(spark, path)
    return df.limit(limit) if limit else df


def _sniff(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - whatever the reader says, it is no Parquet
        return spark.read.json(path, mode="PERMISSIVE")


def normalised(df: DataFrame, position: str | None = None) -> DataFrame:
    """NaN to null in all floating columns; ``position`` adds the row's place in the scan."""
    floats = {f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    df = df.withColumns(floats) if floats else df
    return df.withColumn(position, F.monotonically_increasing_id()) if position else df


def side_file(folder: str, name: str) -> str | None:
    """A side file of a domain: below ``extras`` first, then beside the catalogue."""
    return next((str(p) for p in (Path(folder, "extras", name), Path(folder, name)) if p.exists()), None)


def load_domain(spark: SparkSession, folder: str) -> tuple[Domain, DataFrame, DataFrame | None]:
    """(domain, catalogue, tasks) of a folder with config.json, a catalogue of any format, and tasks.json if there is one."""
    root = Path(folder)
    domain = Domain.load(root / "config.json")
    path = next((p for p in sorted(root.iterdir()) if p.stem.startswith("catalog") and p.suffix in (".parquet", ".csv", ".tsv", ".jsonl", ".json")), None)
    if path is None:
        raise FileNotFoundError(f"no catalogue in {folder}")
    tasks = side_file(folder, "tasks.json")
    return domain, normalised(read_any(spark, str(path))), read_any(spark, tasks) if tasks else None


def described_values(spark: SparkSession, path: str) -> DataFrame:
    """(pid, attr, value) of a JSON file {"products": {pid: {attr: value}}}."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "products map<string, map<string, string>>").alias("j"))
    return parsed.select(F.explode("j.products").alias("pid", "attrs")).select("pid", F.explode("attrs").alias("attr", "value"))


def embeddings(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """(id, embedding array<float>) of a Parquet table, or of a .npy matrix with the ids of its rows."""
    if not path.endswith(".npy"):
        return spark.read.parquet(path)
    import numpy as np

    matrix = np.load(path, mmap_mode="r")
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids or map(str, range(len(matrix))), matrix)]
    return spark.createDataFrame(rows, "id string, embedding array<float>")


def write_results(df: DataFrame, path: str, append: bool = False) -> None:
    """Results as JSON lines."""
    df.write.mode("append" if append else "overwrite").json(path)


def to_records(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object with its nulls."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


class Stages:
    """Stage outputs in a folder: a stage is computed unless its table is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def get(self, name: str, make) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if not jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
