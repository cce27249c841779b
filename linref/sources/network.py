"""Reading and writing networks: template tables as Parquet, JSON or CSV, lines as WKT or GeoJSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linref.functions import geometry as g
from linref.operators.importing import EDGE_COLUMNS, MARKER_COLUMNS, require


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**({"header": True} if kind == "csv" else {}) | options).load(path)


def with_line(df: DataFrame, column: str = "geom", kind: str = "wkt") -> DataFrame:
    """df with its text column parsed to a line; of a multi-line the first part."""
    return df.withColumn(column, (g.line_from_wkt if kind == "wkt" else g.line_from_geojson)(F.col(column)))


def source_edges(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Template edges with typed columns; kind: how lines are written, None for lines."""
    require(df, EDGE_COLUMNS)
    df = with_line(df, kind=kind) if kind else df
    return df.select(F.col("edge_order").cast("int").alias("edge_order"), *[F.col(c).cast("string").alias(c) for c in ("road_code", "road_class", "road_type", "road_class_code")], F.col("is_active").cast("boolean").alias("is_active"), F.col("road_topic").cast("string").alias("road_topic"), F.col("is_access_road").cast("boolean").alias("is_access_road"), "geom")


def source_markers(df: DataFrame, virtual: str = "PRV") -> DataFrame:
    """Template markers with typed columns; a text `type` column names virtual ones by its value."""
    if "type" in df.columns and "is_virtual" not in df.columns:
        df = df.withColumn("is_virtual", F.coalesce(F.col("type") == virtual, F.lit(False)))
    require(df, MARKER_COLUMNS)
    return df.select(F.col("road_code").cast("string").alias("road_code"), F.col("code").cast("int").alias("code"), F.coalesce(F.col("abscissa").cast("double"), F.lit(0.0)).alias("abscissa"), F.col("is_virtual").cast("boolean").alias("is_virtual"), "geom")


def write_lines(df: DataFrame, path: str, kind: str = "wkt", column: str = "geom") -> None:
    """df as Parquet, its line as text."""
    df.withColumn(column, (g.wkt if kind == "wkt" else g.geojson)(F.col(column))).write.mode("overwrite").parquet(path)
