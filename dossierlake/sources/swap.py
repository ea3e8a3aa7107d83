"""Replacing folders of a table so that a job cut short at any step can be finished or undone by the next one.

New folders are prepared below ``root/_pending/<name>/`` (readers skip names that start with an underscore). A journal written
last says what is to be replaced and removed; from then on the change is decided. Each step moves or deletes one folder and
may be repeated, so :func:`recover` simply runs a journal to its end, and throws preparations without one away. Readers that
list the table in the middle of a swap may miss a folder, so run it when nobody reads, or read again.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

PENDING, JOURNAL = "_pending", "_journal"


def _path(spark: SparkSession, name: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def file_system(spark: SparkSession, root: str) -> JavaObject:
    return _path(spark, root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, root: str, depth: int = 1) -> list[str]:
    """Folders ``depth`` levels below ``root`` that readers see, as relative names in order; none where there is no root."""
    fs, found = file_system(spark, root), [""]
    for _ in range(depth):
        deeper = []
        for name in found:
            here = _path(spark, f"{root}/{name}".rstrip("/"))
            for status in fs.listStatus(here) if fs.exists(here) else []:
                leaf = status.getPath().getName()
                if status.isDirectory() and not leaf.startswith(("_", ".")):
                    deeper.append(f"{name}/{leaf}".lstrip("/"))
        found = deeper
    return sorted(found)


def prepare(spark: SparkSession, root: str) -> str:
    """A new folder for what is to be swapped in."""
    return f"{root}/{PENDING}/{uuid.uuid4().hex}"


def decide(spark: SparkSession, prepared: str, replace: list[str], remove: list[str]) -> None:
    """Write the journal: folders of the table that take what is prepared under the same name, and folders that go."""
    fs = file_system(spark, prepared)
    draft = _path(spark, f"{prepared}/{JOURNAL}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray("".join(f"{kind}\t{name}\n" for kind, names in (("replace", replace), ("remove", remove)) for name in names).encode()))
    finally:
        out.close()
    if not fs.rename(draft, _path(spark, f"{prepared}/{JOURNAL}")):
        raise OSError(f"the journal of {prepared} could not be written")


def finish(spark: SparkSession, root: str, prepared: str) -> None:
    """Run the journal of ``prepared`` from wherever it stands."""
    fs = file_system(spark, root)
    source = fs.open(_path(spark, f"{prepared}/{JOURNAL}"))
    reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(source, "UTF-8"))
    try:
        steps = []
        while (line := reader.readLine()) is not None:
            steps.append(line.split("\t", 1))
    finally:
        reader.close()
    for kind, name in steps:
        step(spark, root, prepared, kind, name)
    fs.delete(_path(spark, prepared), True)


def step(spark: SparkSession, root: str, prepared: str, kind: str, name: str) -> None:
    """One line of a journal. A replacement that is no longer prepared has been moved before."""
    fs, target, waiting = file_system(spark, root), _path(spark, f"{root}/{name}"), _path(spark, f"{prepared}/{name}")
    if kind == "remove":
        fs.delete(target, True)
    elif fs.exists(waiting):
        fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.rename(waiting, target):
            raise OSError(f"{waiting} could not be moved to {target}")


def recover(spark: SparkSession, root: str) -> tuple[int, int]:
    """Finish what was decided and drop what was not; returns how many of each. Run by every job that swaps, before it reads."""
    fs, pending = file_system(spark, root), f"{root}/{PENDING}"
    finished = dropped = 0
    for status in fs.listStatus(_path(spark, pending)) if fs.exists(_path(spark, pending)) else []:
        prepared = f"{pending}/{status.getPath().getName()}"
        if fs.exists(_path(spark, f"{prepared}/{JOURNAL}")):
            finish(spark, root, prepared)
            finished += 1
        else:
            fs.delete(_path(spark, prepared), True)
            dropped += 1
    return finished, dropped
