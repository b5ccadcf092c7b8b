"""Files that tasks write themselves: open by URI on any file system that Arrow knows, commit by a manifest.

A task writes files with names of their own for each attempt; only those that the driver lists in the
manifest, once all tasks are through, belong to the table. So a lost executor, a retry or a speculative copy
leaves at most a stray file that no reader sees.
"""

from __future__ import annotations

import json
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

MANIFEST = "_manifest.json"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, as the session resolves it; tasks can open that."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(quote(uri, safe="/:@%?=&,+"))


def create(uri: str) -> pa.NativeFile:
    """A new file for writing; folders above it are made."""
    where, path = _at(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(path)


def open_at(uri: str) -> pa.NativeFile:
    """A file for random access; one on a local disk is mapped, so that what is read is not copied."""
    where, path = _at(uri)
    return pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)


def size_of(uri: str) -> int:
    where, path = _at(uri)
    return where.get_file_info(path).size


def names_in(uri: str) -> list[str]:
    """Names of the plain files in a folder, sorted; hidden ones (``_`` or ``.``) are left out."""
    where, path = _at(uri)
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def is_file(uri: str) -> bool:
    where, path = _at(uri)
    return where.get_file_info(path).type == fs.FileType.File


def remove(uri: str) -> None:
    where, path = _at(uri)
    if where.get_file_info(path).type == fs.FileType.File:
        where.delete_file(path)


def commit(folder: str, listed: dict) -> None:
    """Makes ``listed`` the content of the table in ``folder``: written aside, then moved in place."""
    where, path = _at(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{MANIFEST}.new") as out:
        out.write(json.dumps(listed).encode())
    where.move(f"{path}/{MANIFEST}.new", f"{path}/{MANIFEST}")


def committed(folder: str) -> dict | None:
    """What ``commit`` wrote, or None."""
    if not is_file(f"{folder}/{MANIFEST}"):
        return None
    with open_at(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())
