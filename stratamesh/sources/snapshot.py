"""Snapshots of a mesh with its cell, face and scalar data: a directory of Parquet tables and one JSON table of attributes.

``<path>/amr`` holds the leaves, ``<path>/celldata`` the cells partitioned by level (so a reader's level limit prunes files), ``<path>/facedata`` the faces,
``<path>/attributes`` name and value. Readers push column and level selections down to the scans.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.geometry import corner
from ..operators.mesh import Config, described, indexed


def write(path: str, leaves: DataFrame, cells: DataFrame, cfg: Config, faces: DataFrame | None = None, scalars: dict[str, float] | None = None) -> None:
    spark = leaves.sparkSession
    indexed(leaves, cfg).write.parquet(f"{path}/amr")
    level = K.level(F.col("key"), cfg.dim)
    cells.withColumn("level", level).write.partitionBy("level").parquet(f"{path}/celldata")
    if faces is not None:
        faces.write.parquet(f"{path}/facedata")
    attributes = {"config": json.dumps(dataclasses.asdict(cfg))} | {k: json.dumps(v) for k, v in (scalars or {}).items()}
    spark.createDataFrame(sorted(attributes.items()), "name string, value string").coalesce(1).write.json(f"{path}/attributes")


def attributes(spark: SparkSession, path: str) -> dict:
    return {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(f"{path}/attributes").collect()}


def config(spark: SparkSession, path: str) -> Config:
    found = attributes(spark, path)["config"]
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def leaves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/amr")


def cells(spark: SparkSession, path: str, names: list[str] | None = None, max_level: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/celldata")
    if max_level is not None:
        df = df.filter(F.col("level") <= max_level)
    if names is not None:
        df = df.select("key", *[a for a in ("i", "j", "k") if a in df.columns], *names)
    return df


def faces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/facedata")


#: Optional columns of mesh output.
MESH_COLUMNS = ("level", "tree", "at_domain_border", "at_tree_border", "is_outside")


def mesh_columns(mesh: DataFrame, cfg: Config, wanted: tuple[str, ...] = MESH_COLUMNS) -> DataFrame:
    key = F.col("key")
    every = {"level": K.level(key, cfg.dim), "tree": K.morton_tree(key, cfg.dim), "at_domain_border": K.at_any_domain_border(key, cfg.brick, cfg.dim), "at_tree_border": K.at_any_tree_border(key, cfg.dim), "is_outside": K.is_outside(key, cfg.dim)}
    return mesh.select("key", *[every[w].alias(w) for w in wanted])


def cell_corners(cells_: DataFrame, cfg: Config) -> DataFrame:
    """The corner coordinates of each cell, for unstructured output: key, axes, corner, x, y[, z]."""
    points = [F.struct(F.lit(c).alias("corner"), *[v.alias("xyz"[d]) for d, v in enumerate(corner(F.col("key"), [F.col(a) for a in cfg.axes], cfg.block, c, cfg.dim))]) for c in range(1 << cfg.dim)]
    return cells_.select("key", *cfg.axes, F.explode(F.array(*points)).alias("p")).select("key", *cfg.axes, "p.*")


def to_numpy(df: DataFrame, column: str, order: list[str], path: str, limit: int = 50_000_000) -> int:
    """One column as a .npy file on the driver, in order; more than ``limit`` values are refused, as they would not fit there."""
    import numpy as np

    n = df.count()
    if n > limit:
        raise ValueError(f"{n} values are too many for a single array; write Parquet instead")
    np.save(path, df.orderBy(*order).select(column).toPandas()[column].to_numpy())
    return n


def read_quadrants(spark: SparkSession, path: str, cfg: Config) -> DataFrame:
    return described(leaves(spark, path).select("key"), cfg)
