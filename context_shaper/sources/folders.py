"""Small files and folder listings on whatever file system Spark uses, from the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.getFileStatus(place).isDirectory()


def make(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.mkdirs(place)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(place) if entry.isDirectory())


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none if it does not exist."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(place) if entry.isFile())


def literal(path: str) -> str:
    """A pattern that only this path fits."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def children(spark: SparkSession, pattern: str, name: str = "*") -> Iterator[str]:
    """Paths with a name that fits, in all folders that fit a pattern.  One folder's listing is held at a time."""
    place, system = _place(spark, pattern)
    only = spark._jvm.org.apache.hadoop.fs.GlobFilter(name)
    for folder in system.globStatus(place) or []:
        if folder.isDirectory():
            yield from _texts(spark, spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(system.listStatus(folder.getPath(), only)))


def _texts(spark: SparkSession, paths) -> Iterator[str]:
    """An array of Hadoop paths, fetched as one text, the way a job names its inputs."""
    if not len(paths):
        return
    mapred = spark._jvm.org.apache.hadoop.mapred
    job = mapred.JobConf(False)
    mapred.FileInputFormat.setInputPaths(job, paths)
    for match in re.finditer(r"(?:[^\\,]|\\.)+", job.getRaw("mapreduce.input.fileinputformat.inputdir"), re.DOTALL):
        yield re.sub(r"\\(.)", r"\1", match[0], flags=re.DOTALL)


def stat(spark: SparkSession, path: str) -> tuple[int, int]:
    """Length and modification time (milliseconds) of a file."""
    place, system = _place(spark, path)
    status = system.getFileStatus(place)
    return status.getLen(), status.getModificationTime()


def size(spark: SparkSession, path: str) -> int:
    place, system = _place(spark, path)
    return system.getContentSummary(place).getLength()


def input_files(files: DataFrame) -> list[str]:
    """The URIs of the files a table is read from, fetched as one text: a call for each takes a minute for 400,000."""
    names = files.sparkSession._jvm.org.apache.hadoop.util.StringUtils.join("\n", files._jdf.inputFiles())
    return names.split("\n") if names else []


def read_text(spark: SparkSession, path: str) -> str:
    place, system = _place(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a whole file in its place at once; False if another is there already."""
    place, system = _place(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.draft")
    system.mkdirs(place.getParent())
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if _renamed(spark, draft, place, system):
        return True
    system.delete(draft, False)
    return False


def publish(spark: SparkSession, draft: str, path: str) -> bool:
    """Give a finished folder its name; False, and the draft is deleted, if the name is taken."""
    source, _ = _place(spark, draft)
    place, system = _place(spark, path)
    if _renamed(spark, source, place, system):
        return True
    system.delete(source, True)
    return False


def _renamed(spark: SparkSession, source, place, system) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    try:
        # Unlike FileSystem.rename, this one never replaces what is there.
        context.rename(source, place, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        return True
    except Py4JJavaError:
        if system.exists(place):
            return False
        raise


def remove(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)
