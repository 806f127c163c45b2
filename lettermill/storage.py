"""Small files on the cluster's file system, as the driver sees it.

For logs and catalogues of a few rows only; data goes through Spark's readers and writers.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, without hidden files; none where there is no folder."""
    files, place = _file_system(spark, folder)
    if not files.exists(place):
        return []
    found = [status.getPath().getName() for status in files.listStatus(place)]
    return [n for n in found if not n.startswith((".", "_SUCCESS"))]


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _file_system(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file whole, or leave the one that is there and return False.

    The text is written under a name of its own and renamed, so no reader sees a part of it.
    """
    files, place = _file_system(spark, path)
    files.mkdirs(place.getParent())
    part = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{spark._jvm.java.util.UUID.randomUUID()}")
    stream = files.create(part, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(files.makeQualified(place).toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    never[0] = fs.Options.Rename.NONE
    try:
        context.rename(files.makeQualified(part), files.makeQualified(place), never)
        return True
    except Py4JJavaError as exc:
        files.delete(part, False)
        if "FileAlreadyExists" not in str(exc.java_exception):
            raise
        return False


def remove(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return bool(files.delete(place, True))
