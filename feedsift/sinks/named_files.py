"""Named text files as a Spark data source (K9): one file per row, under the name that the row gives.

``df.write.format("named_text").mode("append").save(folder)`` takes rows of ``file_name`` and ``content``. Tasks write into a
hidden folder of their job beside the files; only the commit moves them to their names, and leaves out names that exist
already (with ``mode("overwrite")`` it replaces them). A failed job deletes its hidden folder, and a task that is tried
again writes files of its own, of which the commit only knows those of the attempt that ended. If two rows give one
name, the first of the lowest partition is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: (name, path in the hidden folder)."""

    partition: int
    files: list[tuple[str, str]]


def _plain(name: str | None) -> str:
    """A usable file name; one that would leave the folder or be hidden is an error."""
    if not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"not a file name: {name!r}")
    return name


class NamedTextWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def _fs(self):
        """The file system of the folder (local, or any other that pyarrow knows by its URI) and its path there."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        system, path = self._fs()
        task = TaskContext.get()
        hidden = f"{path}/_{self.job}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        system.create_dir(hidden, recursive=True)
        files = []
        for n, row in enumerate(rows):
            files.append((_plain(row["file_name"]), f"{hidden}/{n}"))
            with system.open_output_stream(files[-1][1]) as out:
                out.write((row["content"] or "").encode())
        return Written(task.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = self._fs()
        system.create_dir(path, recursive=True)
        taken = set() if self.overwrite else {f.base_name for f in system.get_file_info(fs.FileSelector(path))}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for name, hidden in m.files:
                if name not in taken:
                    system.move(hidden, f"{path}/{name}")
                    taken.add(name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, path = self._fs()
        if system.get_file_info(f"{path}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_{self.job}")


class NamedText(DataSource):
    """Write-only source ``named_text``."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def writer(self, schema: StructType, overwrite: bool) -> NamedTextWriter:
        if not {"file_name", "content"} <= set(schema.fieldNames()):
            raise ValueError("named_text writes the columns file_name and content")
        return NamedTextWriter(self.options["path"], overwrite)


def register_named_text(spark: SparkSession) -> None:
    spark.dataSource.register(NamedText)
