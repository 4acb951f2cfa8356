"""Small files on any Hadoop file system the session can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a whole file or nothing: it appears under its name when it is complete."""
    fs, where = _at(spark, path)
    part = where.suffix(".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"cannot write {path}")


def read_file(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none when it does not exist."""
    fs, where = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def sizes(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and bytes of the files of a folder."""
    fs, where = _at(spark, folder)
    return [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(where)]


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.getFileStatus(where).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
