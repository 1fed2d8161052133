"""Sessions and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)
#: Applications whose executors have this package.
_shipped: set[str] = set()


def get_session(app: str = "logloom", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; ``conf`` uses ``__`` for dots.

    On a cluster, master, memory and ``spark.checkpoint.dir`` come from spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, so that it needn't be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    # The driver serves the file as long as the application runs.
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/{name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    whole = os.path.join(at, f)
                    z.write(whole, os.path.join(name, os.path.relpath(whole, here)))
    sc.addPyFile(archive)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without: it then gets a temporary folder, which every
    task of the one machine can read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = sc._jsc.sc().getCheckpointDir()
    if made.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
        made = sc._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


#: Folders of intermediate results that this process has named, with their sessions.
_made: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a folder not used before, below the shared folder.

    What is written there serves one query; ``forget_folders`` deletes it, at the latest when the process ends.
    """
    path = f"{shared_root(spark)}/logloom/{label}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(forget_folders)
    _made.append((spark, path))
    return path


def forget_folders() -> int:
    """Deletes the folders of intermediate results that this process has made; tables that read them can't be used any more.

    Returns how many were there. A folder whose session has ended stays.
    """
    n = 0
    while _made:
        spark, path = _made.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception as e:
            log.debug("%s stays: %s", path, e)
    atexit.unregister(forget_folders)
    return n
