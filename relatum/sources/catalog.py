"""The catalog: typed tables that every operator reads."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Declared schemas; key columns are never null.
SCHEMAS: dict[str, str] = {
    "files": "id bigint, path string, filename string, extension string, size_bytes bigint, modified_date string, parent_folder string",
    "audio_meta": "path string, duration_secs double, sample_rate bigint, bit_depth bigint, channels bigint, artist string, album string, title string, genre string, year string, bpm double, codec string, bitrate string, file_type string",
    "photo_meta": "path string, width bigint, height bigint, camera_make string, camera_model string, lens string, focal_length string, aperture string, shutter_speed string, iso bigint, date_taken string, gps_lat double, gps_lon double, color_space string, file_type string",
    "video_meta": "path string, duration_secs double, width bigint, height bigint, framerate string, video_codec string, audio_codec string, bitrate_kbps bigint, file_type string, creation_date string",
    "document_meta": "path string, page_count bigint, title string, author string, creator string, creation_date string, file_type string",
    "font_meta": "path string, font_family string, font_style string, font_version string, file_type string",
    "duplicates": "path string, md5_hash string",
    "properties": "path string, domain string, key string, value_num double, value_txt string",
    "embeddings": "path string, model string, vector array<float>, dim int",
    "segments": "id string, path string, segment_type string, segment_key string, label string, bbox_x double, bbox_y double, bbox_w double, bbox_h double, time_start double, time_end double, confidence double, area_frac double, model string, mask_rle binary",
    "segment_embeddings": "segment_id string, model string, vector array<float>, dim int",
    "search_texts": "path string, source_type string, source_key string, content string",
    "neighbors": "path_a string, path_b string, model string, similarity double",
    "projects": "id string, name string, project_root string, file_count bigint, date_range string",
    "file_projects": "path string, project_id string",
    "compositions": "id string, name string, concept string, axes string, created_at string",
    "composition_items": "composition_id string, path string, position bigint, score double, axes_detail string",
    "pipelines": "name string, model string, version string, processed bigint, failed bigint, status string, updated_at string",
}


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that was set.

    Where none is, a temporary one is made in local mode; on a cluster, executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="relatum-"))
    return (named or jsc.getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Ends lineage in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


@dataclass
class Catalog:
    """Tables by name. A table that is not given is empty, with its declared schema."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables[name]

    def with_table(self, name: str, df: DataFrame) -> Catalog:
        """A catalog with one table replaced."""
        if name not in SCHEMAS:
            raise KeyError(f"unknown table {name}")
        return Catalog(self.spark, {**self.tables, name: df})


def open_catalog(spark: SparkSession, path: str) -> Catalog:
    """A catalog stored as one Parquet folder a table; tables without a folder are empty.

    The folder is listed through Spark's own file system layer, so any store it reads will do.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = {}
    for name, ddl in SCHEMAS.items():
        if fs.exists(jvm.org.apache.hadoop.fs.Path(root, name)):
            tables[name] = spark.read.schema(StructType.fromDDL(ddl)).parquet(f"{path}/{name}")
    return Catalog(spark, tables)


def save_catalog(catalog: Catalog, path: str, mode: str = "error") -> None:
    """Writes every table that was given; wide lookups by path profit from rows sorted by it."""
    for name, df in catalog.tables.items():
        out = df.sortWithinPartitions("path") if "path" in df.columns else df
        out.write.mode(mode).parquet(f"{path}/{name}")
