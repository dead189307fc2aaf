"""Reading and writing the tables of an analysis as Parquet folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return found.select(*columns) if columns else found


def register(spark: SparkSession, folder: str, names: list[str] = TABLES) -> None:
    """Tables as temporary views, for spark.sql."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def save(tables: dict[str, DataFrame], path: str, params: dict | None = None, keep: list[str] | None = None) -> None:
    """Named tables and parameters under one folder; `keep` selects tables."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        if keep is None or name in keep:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(params or {}, sort_keys=True),)], "params string").write.mode("overwrite").parquet(f"{path}/params")


def load(spark: SparkSession, path: str, names: list[str], strict: bool = False) -> tuple[dict[str, DataFrame], dict]:
    """The tables that are there, and the parameters; a missing table is an error only if `strict`."""
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as error:
            if strict or "PATH_NOT_FOUND" not in str(error):
                raise
    return found, json.loads(spark.read.parquet(f"{path}/params").first()["params"])


def couplings(spark: SparkSession, path: str) -> DataFrame:
    """(src, tgt, i, j, w) from files named ..._{src}_{tgt}.parquet with columns i, j, w; times as doubles."""
    rows = spark.read.option("pathGlobFilter", "*_*_*.parquet").parquet(path).withColumn("_file", F.input_file_name())
    pattern = r"_([0-9.]+)_([0-9.]+)\.parquet$"
    return rows.select(F.regexp_extract("_file", pattern, 1).cast("double").alias("src"), F.regexp_extract("_file", pattern, 2).cast("double").alias("tgt"), "i", "j", "w")


def from_entries(spark: SparkSession, entries: list[tuple], kind: str = "long") -> DataFrame:
    """A matrix (i, j, w) from a list."""
    return spark.createDataFrame(entries, f"i {kind}, j {kind}, w double")


def graph_name(names: list[str], mode: str = "connectivities", key: str | None = None) -> str:
    """The stored graph of that mode: "<key>_<mode>", with "<mode>" for no key or the key "neighbors"; an error if there is none."""
    if mode not in ("connectivities", "distances"):
        raise ValueError("mode is connectivities or distances")
    tried = [mode] if key in (None, "neighbors") else [f"{key}_{mode}", key]
    for name in tried:
        if name in names:
            return name
    raise KeyError(f"no graph {tried[0]}")


def graph(spark: SparkSession, path: str, mode: str = "connectivities", key: str | None = None) -> DataFrame:
    """The stored graph (i, j, w) of a bundle written by `save`."""
    for name in ([mode] if key in (None, "neighbors") else [f"{key}_{mode}", key]):
        found, _ = load(spark, path, [name])
        if found:
            return found[name].select("i", "j", "w")
    raise KeyError(f"no graph {key or ''} {mode}".replace("  ", " "))


def transition_matrix(spark: SparkSession, path: str, key: str | None = None, backward: bool = False) -> DataFrame:
    """A stored transition matrix by name, or that of the direction: T_fwd or T_bwd."""
    name = key or ("T_bwd" if backward else "T_fwd")
    found, _ = load(spark, path, [name])
    if not found:
        raise KeyError(f"no matrix {name}")
    return found[name].select("i", "j", "w")


def lineages(spark: SparkSession, path: str, kind: str = "fates") -> tuple[DataFrame, list[str]]:
    """A stored fate table (i, names...) and its lineage names: those kept with it if they fit, else the columns' own."""
    found, params = load(spark, path, [kind], strict=True)
    columns = [c for c in found[kind].columns if c != "i"]
    names = params.get(f"{kind}_names")
    if not names or len(names) != len(columns) or len(set(names)) < len(names):
        return found[kind], columns
    return found[kind].toDF(*["i" if c == "i" else names[columns.index(c)] for c in found[kind].columns]), list(names)
