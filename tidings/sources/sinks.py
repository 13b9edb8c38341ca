"""Sinks: dated feed files and versioned table snapshots."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def _open(path: str):
    """File system and path in it, of a URI or a local path."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # (day, staged file)


class DailyWriter(DataSourceWriter):
    """Tasks write documents to a staging folder of this write; the commit
    moves each to its place, an abort removes the folder."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/_staged-{uuid.uuid4().hex}"
        fs, folder = _open(self.staging)
        fs.create_dir(folder, recursive=True)  # tasks don't: what is left running after an abort finds no folder

    def write(self, rows) -> Staged:
        from pyspark import TaskContext

        fs, folder = _open(self.staging)
        attempt = TaskContext.get().taskAttemptId()
        done: list[tuple[str, str]] = []
        try:
            for i, row in enumerate(rows):
                day, payload = row["date"], row["payload"]
                if day is None or payload is None or not DAY.fullmatch(day):
                    raise ValueError(f"no document of a day: {day!r}")
                file = f"{folder}/{day}-{attempt}-{i}"
                done.append((day, file))
                with fs.open_output_stream(file) as out:
                    out.write(payload.encode("utf-8"))
        except BaseException:
            for _, file in done:
                if fs.get_file_info(file).is_file:
                    fs.delete_file(file)
            raise
        return Staged(done)

    def commit(self, messages) -> None:
        fs, folder = _open(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        days = [day for day, _ in files]
        try:
            if len(set(days)) < len(days):
                raise ValueError("two documents of one day")
            for day, file in files:
                fs.move(file, f"{folder}/{day}.json")
        finally:
            self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        fs, folder = _open(self.staging)
        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


class DailyDocuments(DataSource):
    """``(date, payload)`` rows as files ``<path>/<date>.json``."""

    @classmethod
    def name(cls) -> str:
        return "daily_documents"

    def schema(self) -> str:
        return "date string, payload string"

    def writer(self, schema, overwrite: bool) -> DailyWriter:
        return DailyWriter(self.options["path"])


def publish_feed(payload: DataFrame, out_dir: str) -> tuple[bool, Exception | None]:
    """The day's JSON document as ``<out_dir>/<date>.json``.

    Documents are staged beside their place and moved there once all are
    written: a rerun replaces the days present in ``payload`` and leaves other
    days alone, a failing task leaves everything as it was.
    """
    from ..session import ship_package
    try:
        ship_package()
        payload.sparkSession.dataSource.register(DailyDocuments)
        payload.select("date", "payload").write.format("daily_documents").mode("overwrite").save(out_dir)
        return True, None
    except Exception as e:  # surfaced to the caller like the reference does
        return False, e


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a new version of a table to a fresh path (never the path being
    read).  Returns the path."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
