"""One source's layers: staging, core and analytics, each written once.

Core and analytics tables (and staging tables with several readers) are written as
Parquet under a fresh folder of the shared checkpoint root and read back, so
every downstream query scans columnar files.  A ``Warehouse`` is memoised per (application, source) so a
session that runs many queries builds each layer once.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from bazaar.plans.core import CORE_TABLES, Core, materialize_core, new_version, publish_version, published_version, write_checked
from bazaar.plans.rfm import rfm_customer, rfm_segment_summary
from bazaar.session import app_id, apply_semantics, run_folder
from bazaar.sources.schemas import STAGING_TABLES
from bazaar.sources.staging import Staging, staging_from_driver


ANALYTICS_TABLES = ("rfm_customer", "rfm_segment_summary")


class StoredStaging(Staging):
    """Staging tables kept as Parquet once they have readers enough.

    A table of a text source is parsed when it is first asked for, and kept.  One that is
    derived from others is read in place by its first reader, pruned to what that
    needs, and kept when a second one asks; ``keep`` says at once that there will be several.
    """

    def __init__(self, spark: SparkSession, raw: Staging, root: str):
        super().__init__(self._load)
        self.spark, self.raw, self.root = spark, raw, root
        # Each table has its own lock: builds of different tables load side by side.
        self._locks = {name: threading.Lock() for name in STAGING_TABLES}
        self._readers = dict.fromkeys(STAGING_TABLES, 0)

    def _load(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.raw.table(name).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def table(self, name: str) -> DataFrame:
        if name not in self._locks:
            raise KeyError(name)
        with self._locks[name]:
            self._readers[name] += 1
            if self.raw.derived and self._readers[name] == 1:
                return self.raw.table(name)
            return super().table(name)

    def keep(self, *names: str) -> None:
        """These tables (all, if none is named) will be read more than once."""
        for name in names or STAGING_TABLES:
            with self._locks[name]:
                self._readers[name] += 1

    def stored(self, name: str) -> bool:
        return name in self._cache


def load_staging(spark: SparkSession, raw: Staging, root: str) -> Staging:
    """The staging layer of a source: columnar sources as they are, others kept as Parquet (``StoredStaging``)."""
    return raw if raw.columnar and not raw.derived else StoredStaging(spark, raw, root)


class Warehouse:
    """Staging (loaded once), core and analytics layers of one source."""

    def __init__(self, spark: SparkSession, raw: Staging, root: str | None = None,
                 load_raw: bool = True):
        self.spark = spark
        self.raw = raw
        self.root = root or run_folder(spark, "warehouse")
        self._load_raw = load_raw
        self._staging: Staging | None = None
        self._core: Core | None = None
        self._analytics: dict[str, DataFrame] = {}
        self._analytics_version, self._analytics_published = new_version(), False
        self._lock = threading.RLock()
        # catalog database holding the bucketed core table's metadata
        self.database = "bazaar_" + uuid.uuid4().hex[:12]

    def close(self) -> None:
        """Drop this warehouse's catalog metadata (written files are kept)."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")

    @property
    def staging(self) -> Staging:
        with self._lock:
            if self._staging is None:
                self._staging = (load_staging(self.spark, self.raw, f"{self.root}/staging")
                                 if self._load_raw else self.raw)
            return self._staging

    def register_catalog(self, prefix: str = "") -> dict[str, list[str]]:
        """Expose the written layers as catalog databases ``{prefix}staging``,
        ``{prefix}core`` and ``{prefix}analytics`` (external tables over the
        written files).  Staging tables that were read in place are written first."""
        for name in STAGING_TABLES:
            if isinstance(self.staging, StoredStaging):
                self.staging.keep(name)
                self.staging.table(name)
            else:
                self.staging.table(name).write.mode("overwrite").parquet(f"{self.root}/staging/{name}")
        layers = {"staging": {t: self.staging.table(t) for t in STAGING_TABLES},
                  "core": {t: self.core.table(t) for t in CORE_TABLES},
                  "analytics": dict(zip(ANALYTICS_TABLES, (self.rfm, self.rfm_summary)))}
        out = {}
        for layer, tables in layers.items():
            db = f"{prefix}{layer}"
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
            for name in tables:
                path = {"staging": f"{self.root}/staging/{name}", "analytics": self._analytics_path(name)}.get(layer) or self.core.paths[name]
                self.spark.sql(f"DROP TABLE IF EXISTS {db}.{name}")
                self.spark.catalog.createTable(f"{db}.{name}", path=path, source="parquet")
            out[db] = sorted(tables)
        return out

    @property
    def core(self) -> Core:
        with self._lock:
            if self._core is None:
                # Analytics of an earlier load keep the core that they were computed from.
                _, of = published_version(self.spark, f"{self.root}/analytics")
                self._core = materialize_core(self.spark, self.staging, f"{self.root}/core",
                                              database=self.database, keep=(of,) if of else ())
            return self._core

    def _analytics_path(self, name: str) -> str:
        return f"{self.root}/analytics/{self._analytics_version}/{name}"

    def _analytics_table(self, name: str, build) -> DataFrame:
        """An analytics table, written to the folder of a version, which is published once it holds all of them."""
        with self._lock:
            if name not in self._analytics:
                self._analytics[name] = write_checked(build(), self._analytics_path(name), name)
            if len(self._analytics) == len(ANALYTICS_TABLES) and not self._analytics_published:
                publish_version(self.spark, f"{self.root}/analytics", self._analytics_version, list(ANALYTICS_TABLES), self.core.version)
                self._analytics_published = True
            return self._analytics[name]

    @property
    def rfm(self) -> DataFrame:
        """analytics.rfm_customer (written)."""
        return self._analytics_table("rfm_customer", lambda: rfm_customer(self.core))

    @property
    def rfm_summary(self) -> DataFrame:
        """analytics.rfm_segment_summary (written)."""
        return self._analytics_table("rfm_segment_summary", lambda: rfm_segment_summary(self.rfm))


_WAREHOUSES: dict[tuple[str, str], Warehouse] = {}
_REG_LOCK = threading.Lock()


def warehouse_for(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The memoised warehouse over the driver's tables in ``sf_dir``."""
    apply_semantics(spark)
    key = (app_id(spark), sf_dir.rstrip("/"))
    with _REG_LOCK:
        if key not in _WAREHOUSES:
            _WAREHOUSES[key] = Warehouse(spark, staging_from_driver(spark, sf_dir))
        return _WAREHOUSES[key]


def close_all() -> None:
    """Drop the catalog metadata of all memoised warehouses (their files stay)."""
    with _REG_LOCK:
        while _WAREHOUSES:
            _WAREHOUSES.popitem()[1].close()
