"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import functools
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(app_name: str = "palimp", cpus: str = "8", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a temporary folder used; a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="palimp-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/palimp/{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Cut lineage through the shared folder so that a lost executor does not replay the job."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
    return df.checkpoint()


def per_session(build):
    """Build a large column expression once per application instead of once per query."""
    built: dict[tuple, object] = {}

    @functools.wraps(build)
    def cached(*args):
        app = SparkSession.getActiveSession().sparkContext.applicationId
        key = (app, *args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return cached


def ship_by_value(module_name: str) -> None:
    """Send a module's functions inside the tasks that use them, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
