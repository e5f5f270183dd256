"""Sessions, and this package's way to the executors."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName("sparkloom")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


#: Bytes of a batch that goes to a Python worker. Spark's own default of 64 MB is held several times over by each task,
#: outside the heap and in the worker; it is lowered where a session has not set another.
BATCH_SETTING, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that functions of it run there."""
    if spark.conf.get(BATCH_SETTING) == f"{BATCH_DEFAULT}b":
        spark.conf.set(BATCH_SETTING, f"{BATCH}b")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query (spark, ...) that ships the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one in the warehouse, or,
    if all run in one process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/tables"
        else:
            app = spark.sparkContext.applicationId
            if app not in _own:
                _own[app] = tempfile.mkdtemp(prefix="shared-")
                atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
            folder = _own[app]
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
