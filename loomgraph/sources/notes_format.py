"""Folders of markdown notes as a Spark data source: ``spark.read.format("notes")``.

The batch reader lists a folder once on the driver, names only, and cuts the list into
partitions of about equal bytes; tasks open the files. The stream reader hands on the files whose
(modification time, path) lies behind its offset, cut the same way; a file with an older time that
is put there later is not seen. The writer puts one file per row: a task writes under a hidden
name of its attempt and reports its files; the commit gives them the time and renames them into
place, an abort removes them, so readers never see half a file and a task that runs twice leaves
one copy. Mode ``overwrite`` removes the notes that the job did not write.

Rows: path (relative, with "/"), modified_date, content_hash (sha1 of the bytes), content (UTF-8,
bad bytes replaced, line ends LF), title, all as ``scan_corpus`` gives them. Hidden files and
folders are skipped. The writer needs columns path and content; others are ignored, a null
content is an empty file, a path that leaves the folder ends the job. Of several rows of one path
any one stays. Files have to lie where driver and executors can open them (a shared mount).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, modified_date timestamp, content_hash string, content string, title string"


def _root(options: dict) -> str:
    path = options.get("path")
    if not path:
        raise ValueError("the notes format needs a path")
    local = re.sub(r"^file:/+", "/", path)
    if re.match(r"[a-z][a-z0-9+.-]*:", local):
        raise ValueError(f"the notes format reads mounted folders, not {path}")
    return local.rstrip("/") or "/"


def _listed(root: str) -> list[tuple[int, str, int]]:
    """(modification time in ns, relative path, bytes) of all notes, in that order."""
    out, todo = [], [""]
    while todo:
        rel = todo.pop()
        with os.scandir(os.path.join(root, rel)) as entries:
            for e in entries:
                name = f"{rel}/{e.name}" if rel else e.name
                if e.name.startswith("."):
                    continue
                if e.is_dir():
                    todo.append(name)
                elif e.name.endswith(".md"):
                    s = e.stat()
                    out.append((s.st_mtime_ns, name, s.st_size))
    return sorted(out)


@dataclass
class Files(InputPartition):
    """Relative paths that one task reads."""

    paths: list[str]


def _parts(files: list[tuple[int, str, int]], part_bytes: int) -> list[Files]:
    parts, size = [Files([])], 0
    for _, path, n in files:
        if parts[-1].paths and size + n > part_bytes:
            parts.append(Files([]))
            size = 0
        parts[-1].paths.append(path)
        size += n + 4096  # opening a file costs about as much as a few kilobytes of it
    return parts


def _rows(root: str, paths: list[str]) -> Iterator[tuple]:
    for rel in paths:
        try:
            with open(os.path.join(root, rel), "rb") as f:
                data = f.read()
                at = os.fstat(f.fileno()).st_mtime
        except FileNotFoundError:  # removed since it was listed
            continue
        text = data.decode("utf-8", "replace").replace("\r\n", "\n")
        name = rel.rsplit("/", 1)[-1]
        yield rel, dt.datetime.fromtimestamp(at), hashlib.sha1(data).hexdigest(), text, name.removesuffix(".md")


class NotesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.part_bytes = _root(options), int(options.get("partBytes", 64 << 20))

    def partitions(self) -> list[Files]:
        return _parts(_listed(self.root), self.part_bytes)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.root, partition.paths)


class NotesStream(DataSourceStreamReader):
    """Offsets are {"at": ns, "path": last path}: files come in order of both. A file changed again comes again."""

    def __init__(self, options: dict):
        self.root, self.part_bytes = _root(options), int(options.get("partBytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:
        found = _listed(self.root)
        return {"at": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["at"], o["path"]) for o in (start, end))
        return _parts([f for f in _listed(self.root) if low < f[:2] <= high], self.part_bytes)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.root, partition.paths)

    def commit(self, end: dict) -> None:
        """Nothing is kept of past batches."""


@dataclass
class Written(WriterCommitMessage):
    """Names that a task wrote: (hidden, final), relative."""

    names: list[tuple[str, str]]


class NotesWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        missing = {"path", "content"} - set(columns)
        if missing:
            raise ValueError(f"the notes format needs columns {sorted(missing)}")
        self.root, self.overwrite, self.job = _root(options), overwrite, f".job-{uuid.uuid4().hex}"
        os.makedirs(os.path.join(self.root, self.job))

    def write(self, rows: Iterator) -> Written:
        attempt, names = f"{self.job}/{uuid.uuid4().hex}", []
        os.mkdir(os.path.join(self.root, attempt))  # fails where the job is over
        for k, row in enumerate(rows):
            path = os.path.normpath(row["path"] or "")
            if path.startswith(("/", "..")) or path == "." or not path.endswith(".md"):
                raise ValueError(f"not the path of a note: {row['path']!r}")
            hidden = f"{attempt}/{k}"
            with open(f"{self.root}/{hidden}", "wb", buffering=0) as f:
                f.write((row["content"] or "").encode("utf-8", "replace"))
            names.append((hidden, path))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        # A few calls a file: each folder is made once, and the set of paths is kept only where it is needed.
        placed, made, root = set(), set(), self.root
        for m in messages:
            for hidden, path in m.names if m else ():
                folder = path.rpartition("/")[0]
                if folder not in made:
                    os.makedirs(f"{root}/{folder}", exist_ok=True)
                    made.add(folder)
                os.utime(f"{root}/{hidden}")
                os.replace(f"{root}/{hidden}", f"{root}/{path}")
                if self.overwrite:
                    placed.add(path)
        if self.overwrite:
            for _, path, _ in _listed(self.root):
                if path not in placed:
                    os.remove(os.path.join(self.root, path))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """The hidden names go, attempts that failed included. They are moved first, so that a task
        which outlives its job has no folder left to write into."""
        job = os.path.join(self.root, self.job)
        os.rename(job, job + ".over")
        shutil.rmtree(job + ".over")


class NotesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NotesReader:
        return NotesReader(self.options)

    def streamReader(self, schema) -> NotesStream:
        return NotesStream(self.options)

    def writer(self, schema, overwrite: bool) -> NotesWriter:
        return NotesWriter(self.options, schema.names, overwrite)


def register_notes(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(NotesSource)
