"""Files written as a Spark data source: each task writes its own, and one commit makes all of them count.

df.write.format("archive_files").option("root", ...).mode("append").save() takes path (below root, with slashes), content
and, if given, mtime_ms. A task writes its files and an index of them to a folder of its attempt, below staged/<job>; its
commit message names that folder. The commit creates one manifest that names the folders of the tasks that counted and
removes those of attempts that didn't, so its work is one line a task, not one a file; an abort removes the job's folder
and notes the job, as tasks that are being killed may still write: what they leave goes with the next commit or sweep.
Nothing needs a rename or a lock, so any store that Arrow's file systems reach will do, and a lost task, executor or
driver leaves no file that readers see.

A later job's file replaces an earlier one of the same path. With option replaces, a list of extensions such as
".zip,.xaero", it also replaces those that differ from it by extension only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_INDEX = pa.schema([("path", pa.string()), ("place", pa.string()), ("bytes", pa.int64()), ("mtime_ms", pa.int64())])
INDEX = "path string, place string, bytes long, mtime_ms long, version string, replaces string"


def store(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of root and root's path there."""
    return pyarrow.fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pyarrow.fs.LocalFileSystem(), root)


def checked(path: str) -> str:
    """A path below root: relative, without empty parts, dots or back-slashes."""
    parts = path.split("/")
    if not path or "\\" in path or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a path below the root: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    bytes: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.replaces = options["root"].rstrip("/"), options.get("replaces", "")
        self.version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = store(self.root)
        context = TaskContext.get()
        folder = f"staged/{self.version}/{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        index: dict[str, list] = {n: [] for n in _INDEX.names}
        try:
            for batch in iterator:
                times = batch.column("mtime_ms") if "mtime_ms" in batch.schema.names else pa.nulls(len(batch), pa.int64())
                for path, content, mtime in zip(batch.column("path"), batch.column("content"), times):
                    place = f"{folder}/{checked(path.as_py())}"
                    fs.create_dir(f"{base}/{place}".rpartition("/")[0])
                    data = content.as_buffer() or b""
                    with fs.open_output_stream(f"{base}/{place}") as out:
                        out.write(data)
                    for name, value in zip(_INDEX.names, (path.as_py(), place, len(data), mtime.as_py())):
                        index[name].append(value)
            fs.create_dir(f"{base}/{folder}")
            pq.write_table(pa.table(index, schema=_INDEX), f"{base}/{folder}/.index.parquet", filesystem=fs)
        except BaseException:
            _remove(fs, f"{base}/{folder}")
            raise
        return Written(folder, len(index["path"]), sum(index["bytes"]))

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = store(self.root)
        kept = [m for m in messages if m is not None]
        counted = {m.folder for m in kept}
        for other in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/staged/{self.version}", allow_not_found=True)):
            if f"staged/{self.version}/{other.base_name}" not in counted:
                _remove(fs, other.path)
        manifest = {"version": self.version, "replaces": self.replaces, "files": sum(m.files for m in kept), "bytes": sum(m.bytes for m in kept), "folders": sorted(m.folder for m in kept if m.files)}
        fs.create_dir(f"{base}/manifest")
        with fs.open_output_stream(f"{base}/manifest/{self.version}.new") as out:
            out.write(json.dumps(manifest).encode())
        fs.move(f"{base}/manifest/{self.version}.new", f"{base}/manifest/{self.version}.json")
        sweep(self.root)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = store(self.root)
        fs.create_dir(f"{base}/aborted")
        with fs.open_output_stream(f"{base}/aborted/{self.version}"):
            pass
        _remove(fs, f"{base}/staged/{self.version}")


def _remove(fs: pyarrow.fs.FileSystem, path: str) -> None:
    if fs.get_file_info(path).type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(path)


def sweep(root: str) -> None:
    """Remove what tasks of aborted jobs still wrote."""
    fs, base = store(root)
    for job in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/aborted", allow_not_found=True)):
        _remove(fs, f"{base}/staged/{job.base_name}")


def manifests(root: str) -> list[dict]:
    """The jobs that were committed, oldest first."""
    fs, base = store(root)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/manifest", allow_not_found=True))
    out = []
    for info in sorted((x for x in found if x.path.endswith(".json")), key=lambda x: x.base_name):
        with fs.open_input_stream(info.path) as f:
            out.append(json.loads(f.read()))
    return out


class Folders(InputPartition):
    """What one task reads: the index of one writing task."""

    def __init__(self, folder: str, version: str, replaces: str):
        super().__init__(folder)
        self.folder, self.version, self.replaces = folder, version, replaces


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"].rstrip("/")

    def partitions(self) -> list[Folders]:
        return [Folders(f, m["version"], m["replaces"]) for m in manifests(self.root) for f in m["folders"]]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, base = store(self.root)
        for batch in pq.read_table(f"{base}/{partition.folder}/.index.parquet", filesystem=fs).to_batches():
            same = [pa.array([v] * len(batch), pa.string()) for v in (partition.version, partition.replaces)]
            yield pa.record_batch([*batch.columns, *same], names=[*batch.schema.names, "version", "replaces"])


class ArchiveFiles(DataSource):
    """archive_files: written as (path, content, mtime_ms), read as the index of all jobs."""

    @classmethod
    def name(cls) -> str:
        return "archive_files"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files of earlier jobs stay until later ones replace them: use mode append")
        return Writer(self.options)


def save(files: DataFrame, root: str, replaces: tuple[str, ...] = ()) -> None:
    """Write files (path, content, perhaps mtime_ms) below root as one job."""
    files.sparkSession.dataSource.register(ArchiveFiles)
    files.write.format("archive_files").option("root", root).option("replaces", ",".join(replaces)).mode("append").save()


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, place (below root), bytes, mtime_ms of the files that count: of each path the last job's.

    Of files that a job replaces by extension only the job's own counts; within one job the greatest place does.
    """
    spark.dataSource.register(ArchiveFiles)
    rows = spark.read.format("archive_files").option("root", root).load()
    extension = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    alike = (extension != "") & F.array_contains(F.split("replaces", ","), extension)
    rows = rows.withColumns({"stem": F.when(alike, F.left("path", F.length("path") - F.length(extension))).otherwise(F.col("path")), "at": F.struct("version", "place")})
    best = rows.groupBy("path").agg(F.max_by(F.struct("place", "bytes", "mtime_ms", "stem"), "at").alias("f"), F.max("at.version").alias("version"))
    # What a job that replaces by extension says of a stem counts against older files of any of its extensions.
    said = rows.where("stem <> path").select("stem", "version", F.explode(F.split("replaces", ",")).alias("extension")).select(F.concat("stem", "extension").alias("path"), "version")
    newest = said.groupBy("path").agg(F.max("version").alias("newer"))
    kept = best.join(newest, "path", "left").where("newer is null or version >= newer")
    return kept.select("path", "f.place", "f.bytes", "f.mtime_ms")


def contents(files: DataFrame, root: str) -> DataFrame:
    """files with content, read where they lie: one at a time, nothing is listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root.rstrip("/"))
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                with fs.open_input_stream(f"{base}/{one.column('place')[0].as_py()}") as f:
                    yield pa.record_batch([*one.columns, pa.array([f.read()], pa.binary())], names=[*one.schema.names, "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{fields}, content binary")


def place(files: DataFrame, root: str, target: str) -> DataFrame:
    """Copy files of a listing to their own paths below target: path, bytes and what was done.

    A file that is there with as many bytes is left alone, so a copy that was broken off goes on where it ended. Each is
    written beside its place and moved, and on a local disk gets its time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        fs, base = store(root.rstrip("/"))
        to, top = store(target.rstrip("/"))
        for batch in batches:
            done = []
            for path, own, size, mtime in zip(*(batch.column(c).to_pylist() for c in ("path", "place", "bytes", "mtime_ms"))):
                goal = f"{top}/{checked(path)}"
                info = to.get_file_info(goal)
                if info.type == pyarrow.fs.FileType.File and info.size == size:
                    done.append("present")
                    continue
                to.create_dir(goal.rpartition("/")[0])
                beside = f"{goal}.{uuid.uuid4().hex}.tmp-xt"
                pyarrow.fs.copy_files(f"{base}/{own}", beside, fs, to)
                to.move(beside, goal)
                if mtime is not None and isinstance(to, pyarrow.fs.LocalFileSystem):
                    os.utime(goal, ns=(mtime * 10**6, mtime * 10**6))
                done.append("copied")
            yield pa.record_batch({"path": batch.column("path"), "bytes": batch.column("bytes"), "did": pa.array(done, pa.string())})

    return files.select("path", "place", "bytes", "mtime_ms").mapInArrow(run, "path string, bytes long, did string")


def save_missing(files: DataFrame, root: str) -> None:
    """Write those of files whose path isn't there yet: a second run changes nothing that someone may have edited."""
    there = listing(files.sparkSession, root).select("path")
    save(files.join(there, "path", "left_anti").select(*files.columns), root)


def dimension_settings(folders: DataFrame) -> DataFrame:
    """The settings file (path, content) of each world's dimension folder (world, folder, mw, dim), for a fresh archive."""
    text = F.concat(F.lit("MWName:"), "mw", F.lit(":Map 1\ncaveModeType:0\ndimensionTypeId:"), "dim", F.lit("\n"))
    return folders.select(F.concat_ws("/", "world", "folder", F.lit("dimension_config.txt")).alias("path"), F.encode(text, "UTF-8").alias("content"))
