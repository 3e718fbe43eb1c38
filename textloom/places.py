"""Where intermediate files go: a folder that the driver and every executor reach."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or the context's checkpoint folder; a session on one machine may lack both."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def mounted(spark: SparkSession, path: str) -> str | None:
    """A path of a local or mounted file system as Python opens it, in a task as on the driver; None for any other."""
    files, place = _file_system(spark, path)
    uri = files.makeQualified(place).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder has files or partitions that a reader would see."""
    files, place = _file_system(spark, path)
    return files.exists(place) and any(not f.getPath().getName().startswith(("_SUCCESS", ".")) for f in files.listStatus(place))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    files, place = _file_system(spark, path)
    return files.getContentSummary(place).getLength()


def delete(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def rename_parts(spark: SparkSession, folder: str, suffix: str, name: str | None = None) -> None:
    """Gives the part files of a written folder another suffix, and the one of a folder that has one only another name."""
    files, place = _file_system(spark, folder)
    for f in files.listStatus(place):
        part = f.getPath().getName()
        if part.startswith("part-"):
            files.rename(f.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, (name or part.split(".")[0]) + suffix))


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    files, place = _file_system(spark, folder)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    files, place = _file_system(spark, path)
    stream = files.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file whole, or not at all if one of that name is there; False then.

    It is written beside its place and moved there without overwriting, which file systems of clusters do as one step. A
    local one looks first, so there two writers must not meet.
    """
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, place = _file_system(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), configuration)
    try:
        context.rename(files.makeQualified(beside), files.makeQualified(place), options)
    except Py4JJavaError as error:
        files.delete(beside, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True
