"""Writing items as files of their own: all files of a write become visible, or none of it.

Tasks write to a staging folder beside the vault, each try to a folder of its own, and leave a table of what they wrote, in
which Spark's committer keeps one try of each task. Tasks then look for paths that are there twice or already, and move
the files to their places; the staging folder goes in any case. No paths pass through the driver. Paths are those that
pyarrow's file systems reach.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.lineage import cut


def inside(path: str) -> str:
    """A relative path without leading slash or steps upwards."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or path.startswith("/"):
        raise ValueError(f"not a path below the vault: {path!r}")
    return "/".join(parts)


def files(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else f"/{root}")


def staged(root: str, staging: str):
    """Batches (path, content) to files below a folder of this try, and to rows (path, folder)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files(root)
        folder, made = uuid4().hex, set()
        for batch in batches:
            paths = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                paths.append(inside(path))
                to = f"{at}/{staging}/{folder}/{paths[-1]}"
                parent = to.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(to, compression=None) as out:
                    out.write((content or "").encode("utf-8"))
            yield pa.RecordBatch.from_pydict({"path": paths, "folder": [folder] * len(paths)})

    return write


def staged_lines(root: str, staging: str):
    """Batches (path, line), with all lines of a path behind one another, to files below a folder of this try, and to rows (path, folder)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files(root)
        folder, made, last, out = uuid4().hex, set(), None, None
        try:
            for batch in batches:
                paths = []
                for path, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if path != last:
                        if out is not None:
                            out.close()
                        paths.append(inside(path))
                        to = f"{at}/{staging}/{folder}/{paths[-1]}"
                        parent = to.rsplit("/", 1)[0]
                        if parent not in made:
                            system.create_dir(parent, recursive=True)
                            made.add(parent)
                        last, out = path, system.open_output_stream(to, compression=None)
                    out.write(f"{line or ''}\n".encode("utf-8"))
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "folder": pa.array([folder] * len(paths), pa.string())})
        finally:
            if out is not None:
                out.close()

    return write


def present(root: str):
    """Those of the paths that are there already."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files(root)
        for batch in batches:
            paths = batch.column(0).to_pylist()
            there = system.get_file_info([f"{at}/{p}" for p in paths])
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, x in zip(paths, there) if x.type != fs.FileType.NotFound], pa.string())})

    return look


def below(root: str):
    """Folders (folder), relative to the root, to the folders and files in them (path, is_dir)."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for part in entries(system, f"{at}/{folder}".rstrip("/")):
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}".lstrip("/") for name, _ in part], "is_dir": pa.array([d for _, d in part], pa.bool_())})

    return look


def entries(system: fs.FileSystem, folder: str, size: int = 10_000) -> Iterator[list[tuple[str, bool]]]:
    """Names in a folder, and whether they are folders, in parts of this size; those that begin with a dot or underscore are hidden."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:  # one after the other: a folder may hold millions
            names = ((x.name, x.is_dir()) for x in found if x.name[0] not in "._")
            while part := list(islice(names, size)):
                yield part
        return
    names = [(x.base_name, x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(folder)) if x.base_name[0] not in "._"]
    for i in range(0, len(names), size):
        yield names[i:i + size]


def contents(root: str):
    """Paths to (path, content, bytes), in batches of about 16 MB."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files(root)
        for batch in batches:
            held, size = [], 0
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{at}/{path}", compression=None) as f:
                    held.append((path, f.read()))
                size += len(held[-1][1])
                if size > 16 << 20:
                    yield read_rows(held)
                    held, size = [], 0
            if held:
                yield read_rows(held)

    return read


def read_rows(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary()), pa.array([len(c) for _, c in held], pa.int64())], ["path", "content", "bytes"])


def read_items(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), content (bytes) and length of all files: tasks list the folders, level by level, and read the files.

    Spark's own file sources keep the listing, and each task's share of it, on the driver; here it stays in tables.
    """
    root, found = root.rstrip("/"), []
    folders = spark.createDataFrame([("",)], "folder string")
    while True:
        level = cut(folders.repartition("folder").mapInArrow(below(root), "path string, is_dir boolean"))
        found.append(level.filter("not is_dir").select("path"))
        folders = level.filter("is_dir").select(F.col("path").alias("folder"))
        if folders.isEmpty():
            break
    paths = reduce(DataFrame.unionByName, found)
    return paths.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(contents(root), "path string, content binary, bytes long")


def moved(root: str, staging: str):
    """Files to their places; counts. A task that is tried again finds some of its files moved."""
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files(root)
        made = set()
        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source, to = f"{at}/{staging}/{folder}/{path}", f"{at}/{path}"
                parent = to.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                try:
                    system.move(source, to)
                except OSError:
                    gone, there = system.get_file_info([source, to])
                    if gone.type != fs.FileType.NotFound or there.type == fs.FileType.NotFound:
                        raise
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return move


def write_items(rows: DataFrame, root: str, replace: bool = False) -> None:
    """Write each row (path, content) to its own file. Unless ``replace``, a file that is there already is an error and nothing is written."""
    put(rows.select("path", "content"), staged, root, replace)


def write_lines(rows: DataFrame, root: str, order: str, replace: bool = False) -> None:
    """Write the rows (path, line) of each path as the lines of one file, in this order; else as ``write_items``. No file is held whole."""
    put(rows.repartition("path").sortWithinPartitions("path", order).select("path", "line"), staged_lines, root, replace)


def put(rows: DataFrame, stage, root: str, replace: bool) -> None:
    root, staging = root.rstrip("/"), f"_staging-{uuid4().hex}"
    try:
        written = cut(rows.mapInArrow(stage(root, staging), "path string, folder string"))
        if not written.groupBy("path").count().filter("count > 1").isEmpty():
            raise ValueError("two rows have the same path")
        if not replace and (there := written.select("path").mapInArrow(present(root), "path string").first()):
            raise FileExistsError(there.path)
        written.mapInArrow(moved(root, staging), "n long").agg(F.sum("n")).first()
    finally:
        system, at = files(root)
        if system.get_file_info(f"{at}/{staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{at}/{staging}")
