"""FASTA as a Spark data source: files in, plain or gzip; one FASTA and one JSONL file per group out.

    register(spark)
    spark.read.format("spanloom_fasta").option("path", "...").load()          # name, sequence, file
    write_groups(rows, "...", "clade", "id", "seq")                           # clade.fasta, clade.jsonl

Paths are absolute or ``file:`` names of a folder that the driver and all executors share, or any URI that pyarrow's file
systems know.  Reading plans a partition per file; a record is read line by line, so memory holds one record.  Writing goes
to a staging folder; only files that finished tasks report are moved into place, all at the end, so a failed task or job
leaves nothing, and a repeated task leaves one copy.  An existing target is refused.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "spanloom_fasta"
ENDINGS = (".fa", ".fasta", ".fna", ".faa", ".fa.gz", ".fasta.gz", ".fna.gz", ".faa.gz")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def file_name(group: object) -> str:
    """A group as a file name, different for different groups; ``%null`` for null, ``%empty`` for the empty one."""
    return "%null" if group is None else quote(str(group), safe=" ").replace(".", "%2E") or "%empty"


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Headers without ``>`` and their sequences; what precedes the first header is skipped, an empty record stays."""
    name, parts = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            name, parts = line[1:], []
        else:
            parts.append(line.strip())
    if name is not None:
        yield name, "".join(parts)


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        """A file per partition, in order of their names; a folder is searched, a missing path is an error."""
        system, path = _open(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == fs.FileType.File:
            return [File(path)]
        inside = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [File(p) for p in sorted(x.path for x in inside if x.type == fs.FileType.File and x.path.endswith(ENDINGS))]

    def read(self, partition: File) -> Iterator[tuple[str, str, str]]:
        if partition is None:  # a folder without files
            return
        system, _ = _open(self.path)
        with system.open_input_stream(partition.path, compression=None) as raw:
            stream = gzip.open(raw) if partition.path.endswith(".gz") else raw
            for name, sequence in records(io.TextIOWrapper(io.BufferedReader(stream) if stream is raw else stream, "utf-8", "replace")):
                yield name, sequence, partition.path


@dataclass
class Finished(WriterCommitMessage):
    task: int
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """Rows have to come sorted by group within a partition, else a group has several files of a task."""

    def __init__(self, path: str, group: str, name: str, sequence: str):
        system, self.root = _open(path)
        self.path, self.columns, self.staging = path, (group, name, sequence), f"{self.root}/_staging-{uuid.uuid4().hex}"
        if system.get_file_info(self.root).type != fs.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, rows: Iterator[Row]) -> Finished:
        system, _ = _open(self.path)
        group, name, sequence = self.columns
        own = f"{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        files, pair, held = [], (), object()
        try:
            for row in rows:
                if row[group] != held or not pair:
                    for f in pair:
                        f.close()
                    held, stem = row[group], f"{own}/{len(files)}"
                    files.append((file_name(held), stem))
                    pair = tuple(system.open_output_stream(f"{stem}.{kind}", compression=None) for kind in ("fasta", "jsonl"))
                pair[0].write(f">{row[name]}\n{row[sequence] or ''}\n".encode())
                pair[1].write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
        finally:
            for f in pair:
                f.close()
        return Finished(TaskContext.get().partitionId(), files)

    def commit(self, messages: list[Finished | None]) -> None:
        """``group.fasta`` where one task had the group, else ``group-00000.fasta`` and on in order of tasks."""
        system, _ = _open(self.path)
        system.create_dir(self.root, recursive=True)
        stems: dict[str, list[str]] = {}
        for message in sorted((m for m in messages if m), key=lambda m: m.task):
            for group, stem in message.files:
                stems.setdefault(group, []).append(stem)
        for group, parts in stems.items():
            for n, stem in enumerate(parts):
                for kind in ("fasta", "jsonl"):
                    system.move(f"{stem}.{kind}", f"{self.root}/{group}.{kind}" if len(parts) == 1 else f"{self.root}/{group}-{n:05}.{kind}")
        self._clear(system, self.staging)

    def abort(self, messages: list[Finished | None]) -> None:
        """The target did not exist before, so it goes as a whole."""
        self._clear(_open(self.path)[0], self.root)

    @staticmethod
    def _clear(system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, sequence string, file string"

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        return Writer(self.options["path"], self.options["group"], self.options["header"], self.options["sequence"])


def group_of(file: Column) -> Column:
    """The group that a file written with ``whole`` is named after."""
    stem = F.regexp_extract(file, r"([^/]*)\.fasta$", 1)
    return F.when(stem == "%empty", "").when(stem != "%null", F.try_url_decode(stem))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fasta)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence and file of the records of a file, or of all FASTA files in a folder."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).load()


def write_groups(rows: DataFrame, path: str, group: str, name: str, sequence: str, whole: bool = True) -> None:
    """One FASTA and one JSONL file per group, in order of names; all columns go to the JSONL.

    With ``whole`` a group is written by one task, line by line.  Without, groups are dealt by ranges of (group, name), so a
    large group is written by several tasks, into numbered files.
    """
    register(rows.sparkSession)
    dealt = rows.repartition(group) if whole else rows.repartitionByRange(group, name)
    target = dealt.sortWithinPartitions(group, name).write.format(FORMAT).mode("append").option("path", path)
    target.option("group", group).option("header", name).option("sequence", sequence).save()
