"""Versioned tables of files: a version is an immutable list of entries with a parent, and changes are new versions.

A folder holds data files, entries as Parquet under `_entries`, and `_versions/<number>.json`, which names a version's
entries and its parent. A version exists once its number does; it is created only if absent, so that of two writers who
start from the same version one wins and the other gets a Conflict. Readers pin a version: files that a later one moves,
relabels or leaves out stay until `collect` removes what the kept versions no longer name.

Local files are created by a hard link, which fails if the name is taken; other stores are asked first whether it is, as
exclusively as they can.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has made the version first."""


def store_of(folder: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    return store, base.rstrip("/")


def version_path(base: str, number: int) -> str:
    return f"{base}/_versions/{number:010d}.json"


def versions(folder: str) -> list[int]:
    """The numbers of all versions, rising."""
    from pyarrow import fs

    store, base = store_of(folder)
    infos = store.get_file_info(fs.FileSelector(f"{base}/_versions", allow_not_found=True))
    return sorted(int(i.base_name[:-5]) for i in infos if i.base_name.endswith(".json") and i.base_name[:-5].isdigit())


def described(folder: str, number: int) -> dict:
    store, base = store_of(folder)
    with store.open_input_file(version_path(base, number)) as f:
        return json.loads(f.read())


def create(folder: str, parent: int, entries: list[str]) -> int:
    """Makes the version after the parent, whole or not at all; a Conflict if there is one already."""
    from pyarrow import fs

    store, base = store_of(folder)
    store.create_dir(f"{base}/_versions", recursive=True)
    number = parent + 1
    path, temporary = version_path(base, number), f"{base}/_versions/.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(json.dumps({"parent": parent, "entries": entries}).encode())
    try:
        if isinstance(store, fs.LocalFileSystem):
            os.link(temporary, path)
        elif store.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        else:
            store.move(temporary, path)
            return number
    except FileExistsError:
        raise Conflict(f"version {number} of {folder} exists") from None
    finally:
        if store.get_file_info(temporary).type == fs.FileType.File:
            store.delete_file(temporary)
    return number


def entries(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The entries of a version, by default of the last one."""
    known = versions(folder)
    if not known:
        raise FileNotFoundError(f"{folder} has no version")
    named = described(folder, known[-1] if version is None else version)["entries"]
    return spark.read.parquet(*(f"{folder}/{e}" for e in named))


def change(spark: SparkSession, folder: str, new: Callable[[DataFrame], DataFrame], parent: int | None = None) -> int:
    """A version with the entries that `new` makes of the parent's, by default of the last one; its number. Data files stay where they are."""
    parent = versions(folder)[-1] if parent is None else parent
    made = f"_entries/{uuid.uuid4().hex}"
    before = entries(spark, folder, parent)
    new(before).select(before.columns).write.parquet(f"{folder}/{made}")
    try:
        return create(folder, parent, [made])
    except Conflict:
        store, base = store_of(folder)
        store.delete_dir(f"{base}/{made}")
        raise


def moved(before: DataFrame, places: DataFrame, key: str, column: str) -> DataFrame:
    """Entries with the column changed to that of places (key, column), where it has the key; a null takes the entry out."""
    to = places.select(F.col(key).alias("_key"), F.struct(F.col(column).cast(before.schema[column].dataType).alias("to")).alias("_new"))
    both = before.join(to, F.col(key).eqNullSafe(F.col("_key")), "left")
    changed = F.when(F.col("_new").isNull(), F.col(column)).otherwise(F.col("_new.to"))
    return both.where(F.col("_new").isNull() | F.col("_new.to").isNotNull()).withColumn(column, changed).select(before.columns)


def collect(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Removes all but the last `keep` versions and the data files that these don't name; the files' names. Not while others write or read older versions."""
    from pyarrow import fs

    store, base = store_of(folder)
    known = versions(folder)
    for number in known[:-keep]:
        store.delete_file(version_path(base, number))
    kept = {e.split("/")[1] for number in known[-keep:] for e in described(folder, number)["entries"]}
    for info in store.get_file_info(fs.FileSelector(f"{base}/_entries", allow_not_found=True)):
        if info.base_name not in kept:
            store.delete_dir(info.path)
    there = [i.base_name for i in store.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True))]
    names = None
    for number in known[-keep:]:
        some = entries(spark, folder, number).select("file").distinct()
        names = some if names is None else names.unionByName(some)
    found = spark.createDataFrame([(f"data/{n}",) for n in there], "file string")
    gone = [r["file"] for r in found.join(names, "file", "left_anti").collect()] if there else []  # names of files, as the listing is
    for file in gone:
        store.delete_file(f"{base}/{file}")
    return sorted(gone)
