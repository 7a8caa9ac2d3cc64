"""Folders in whatever file system a path names, through Hadoop's interface."""

from pyspark.sql import SparkSession

# Signs that folder names of keys have as codes, beside control ones.
UNSAFE = set("\"#%'*/:=?\\\x7f{[]^")


def _open(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly in a folder; none if there is no such folder."""
    files, place = _open(spark, path)
    return sorted(entry.getPath().getName() for entry in files.listStatus(place)) if files.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _open(spark, path)
    return files.exists(place)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path in the file system of the machine; None for one in another file system."""
    files, place = _open(spark, path)
    whole = files.makeQualified(place).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def folder_name(value: str | int | None) -> str:
    """A key as Spark writes it into a folder's name."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(sign):02X}" if sign in UNSAFE or sign < " " else sign for sign in str(value))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    files, place = _open(spark, pattern)
    return sorted(entry.getPath().toString() for entry in files.globStatus(place) or [])


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with what is in it, if it is there."""
    files, place = _open(spark, path)
    files.delete(place, True)
