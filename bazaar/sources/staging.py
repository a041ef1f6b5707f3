"""Staging layer readers.

``read_staging`` is the raw-file reader (CSV with header, explicit schema,
quoted multi-line text, FAILFAST on malformed rows) or Parquet; the
``Staging`` container hands the nine tables to the downstream builds.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from bazaar.sources.driver_tables import mapped_staging_table
from bazaar.sources.schemas import STAGING_SCHEMAS, STAGING_TABLES


# Tables with newlines inside quoted values.
MULTI_LINE = {"order_reviews"}


def read_staging(spark: SparkSession, name: str, path: str, fmt: str = "csv") -> DataFrame:
    """Read one raw staging table with its fixed schema.

    CSV: header names must be the schema's, in its order; double-quote
    escaping; malformed rows abort.  Only review texts contain newlines, so
    only that file is read as a whole; the others are split.
    Parquet: columns selected and cast to the staging schema by name.
    """
    schema = STAGING_SCHEMAS[name]
    if fmt == "csv":
        return (spark.read.schema(schema)
                .option("header", True)
                .option("mode", "FAILFAST")
                .option("enforceSchema", False)   # a header that differs is an error
                .option("multiLine", name in MULTI_LINE)
                .option("escape", '"')
                .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
                .csv(path))
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    raise ValueError(f"unsupported staging format {fmt!r}")


@dataclass
class Staging:
    """The nine staging tables, resolved lazily and memoised per instance."""

    loader: Callable[[str], DataFrame]
    columnar: bool = False   # scans prune columns: queries read the source in place
    derived: bool = False    # tables are computed from others each time that they are read
    _cache: dict = field(default_factory=dict)
    _lock: threading.RLock = field(default_factory=threading.RLock)

    def table(self, name: str) -> DataFrame:
        if name not in STAGING_SCHEMAS:
            raise KeyError(name)
        with self._lock:
            if name in self._cache:
                return self._cache[name]
        df = self.loader(name)   # may wait for a load: never under the lock
        with self._lock:
            return self._cache.setdefault(name, df)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in STAGING_SCHEMAS:
            raise AttributeError(name)
        return self.table(name)

    @property
    def translation(self) -> DataFrame:
        return self.table("product_category_name_translation")


def staging_from_files(spark: SparkSession, root: str, fmt: str = "csv",
                       names: dict[str, str] | None = None) -> Staging:
    """Staging over raw files ``{root}/{file}``; ``names`` maps table -> file name."""
    files = {t: f"{t}.{fmt}" for t in STAGING_TABLES} | (names or {})
    return Staging(lambda t: read_staging(spark, t, f"{root.rstrip('/')}/{files[t]}", fmt), columnar=fmt == "parquet")


def staging_from_driver(spark: SparkSession, sf_dir: str, spread: int | None = None) -> Staging:
    """Staging derived from the driver's TPC-H-like parquet tables.

    ``spread`` deals each table out to so many partitions first: for files of a
    single row group, which one task would read.
    """
    return Staging(lambda t: mapped_staging_table(spark, sf_dir, t, spread), columnar=True, derived=True)


def staging_from_frames(frames: dict[str, DataFrame]) -> Staging:
    """Staging over in-memory DataFrames (hand-built fixtures in tests)."""
    return Staging(lambda t: frames[t])
