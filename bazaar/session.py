"""Spark session construction and the shared scratch location.

Library code never invents cluster settings: it reads ``spark.checkpoint.dir``
from the running session.  Only when that setting is absent *and* the master
is local (tests, a laptop) do we create a scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on for correct semantics (not tuning):
#  * UTC + TIMESTAMP_NTZ inputs keep wall-clock timestamps unshifted;
#  * ANSI mode makes decimal overflow and x/0 errors instead of silent NULLs,
#    as a SQL database does.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Execution settings.  AQE re-plans joins/partition counts at runtime and
# splits skewed join partitions.
EXECUTION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Independent table builds are submitted as concurrent jobs; FAIR lets a
    # small job's tasks run beside a large one instead of queueing behind it.
    "spark.scheduler.mode": "FAIR",
    # Remove checkpoint files of global-order steps once nothing references them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "bazaar", cpus: int | str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests / bench.  On a cluster use the provided session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(SEMANTIC_CONF)
    conf.update(EXECUTION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = "16g"
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_semantics(spark)
    return spark


def apply_semantics(spark: SparkSession) -> None:
    """Session-level SQL settings the queries depend on (runtime-settable)."""
    for k, v in SEMANTIC_CONF.items():
        spark.conf.set(k, v)


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 — Connect sessions have no SparkContext
        return None


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "app")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    If the session has none (local tests) a scratch folder is created and
    registered; on a non-local master a missing setting is an error, because
    a machine-local folder would not survive executor loss.
    """
    sc = _context(spark)
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not d:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="bazaar-ckpt-")
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def run_folder(spark: SparkSession, *parts: str) -> str:
    """A fresh sub-folder of the shared checkpoint root for this application."""
    root = checkpoint_root(spark).rstrip("/")
    return "/".join([root, f"bazaar-{app_id(spark)}", *parts, uuid.uuid4().hex[:8]])
