"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "penstock", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on. Cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions run from any folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):
        base = os.path.join(tempfile.mkdtemp(prefix="penstock-package-"), "penstock")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for staged tables: `spark.checkpoint.dir` of the session.

    A machine-local folder is used only when the setting is missing on a local master; on a cluster
    a missing setting is an error because executors could not see each other's files.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="penstock-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """Fresh path below the scratch folder."""
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
