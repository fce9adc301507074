"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session may go without it and gets a temporary folder; on a
    cluster such a folder would not be shared, so that is an error.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {key} to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="tarn-shared-")
        spark.conf.set(key, found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _fs(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def listing(spark: SparkSession, path: str) -> str:
    """A digest of names, lengths and change times of all files below a path."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return ""
    told = spark.sparkContext._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().listLeafStatuses(fs, at).mkString("\n")
    lines = sorted(re.sub(r"access_time=\d+", "", told).split("\n"))
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


def kept_tables(spark: SparkSession, name: str, source: str, build: Callable[[], dict[str, Callable[[str], None]]]) -> dict[str, str]:
    """Paths of tables derived from ``source``, written once for all applications and again when its files change.

    ``build`` gives a writer (path -> None) per table.  All tables are written
    beside their place and take it by one rename, so that nobody sees a part of
    them; if another application was faster, its tables count.  Versions older
    than the last two are removed.
    """
    top = f"{shared_folder(spark)}/kept-{name}-{hashlib.md5(source.encode()).hexdigest()[:16]}"
    place = f"{top}/{listing(spark, source)[:16]}"
    writers = build()
    if not exists(spark, place):
        beside = f"{top}/writing-{uuid.uuid4().hex}"
        for t, write in writers.items():
            write(f"{beside}/{t}")
        fs, at = _fs(spark, beside)
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        fs.mkdirs(jvm.Path(top))
        if exists(spark, place) or not fs.rename(at, jvm.Path(place)):
            remove(spark, beside)
        done = [s for s in fs.listStatus(jvm.Path(top)) if not s.getPath().getName().startswith("writing-")]
        for old in sorted(done, key=lambda s: s.getModificationTime())[:-2]:
            fs.delete(old.getPath(), True)
    return {t: f"{place}/{t}" for t in writers}
