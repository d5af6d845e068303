"""Data sources that write finished CSV files: one per job, or one for a whole table.

Tasks stream their lines into files of a staging folder, so memory holds one batch at a time.
Nothing stands under its final name before every task is done; if one fails for good, the
staging folder goes and nothing was written. What a lost or repeated task
left there is removed with it. The driver hears one message per task, not per file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

LINE_END = "\r\n"
BUFFER = 1 << 20


def arrow_uri(location: str) -> str:
    """A Spark location as Arrow's file systems spell it."""
    if location.startswith("s3a://"):
        return "s3://" + location.removeprefix("s3a://")
    if location.startswith("file:/"):
        return "/" + location.removeprefix("file:").lstrip("/")
    return location


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote."""

    part: int
    folder: str | None


class _Staging(DataSourceArrowWriter):
    def __init__(self, location: str):
        self.location, self.run = location, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        """File system, final place, staging folder beside it or in it."""
        filesystem, root = fs.FileSystem.from_uri(arrow_uri(self.location))
        return filesystem, root, f"{root}.staged-{self.run}"

    def _folder(self) -> tuple[fs.FileSystem, str]:
        filesystem, _, staging = self._open()
        folder = f"{staging}/{uuid.uuid4().hex}"
        filesystem.create_dir(folder, recursive=True)
        return filesystem, folder

    def abort(self, messages: list[Staged | None]) -> None:
        filesystem, _, staging = self._open()
        if filesystem.get_file_info(staging).type != fs.FileType.NotFound:
            filesystem.delete_dir(staging)


class JobFilesWriter(_Staging):
    """Rows (job_id, line) with the lines of a job behind one another and in order."""

    def __init__(self, location: str, suffix: str):
        super().__init__(location)
        self.suffix = suffix

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        filesystem, folder = self._folder()
        job, out = None, None
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for own, lines in groupby(rows, key=lambda row: row[0]):
                text = LINE_END.join(line for _, line in lines)
                if out is None or own != job:
                    if out is not None:
                        out.close()
                    job, out = own, filesystem.open_output_stream(f"{folder}/{own}{self.suffix}", buffer_size=BUFFER)
                else:
                    text = LINE_END + text
                out.write(text.encode("utf-8"))
        if out is not None:
            out.close()
        return Staged(TaskContext.get().partitionId(), folder)

    def commit(self, messages: list[Staged | None]) -> None:
        filesystem, root, _ = self._open()
        filesystem.create_dir(root, recursive=True)
        for message in messages:
            if message is not None:
                for file in filesystem.get_file_info(fs.FileSelector(message.folder)):
                    filesystem.move(file.path, f"{root}/{file.base_name}")
        self.abort(messages)


class CsvFileWriter(_Staging):
    """Rows (line), the partitions in their order, as one file under one header; each line has its end."""

    def __init__(self, location: str, header: str):
        super().__init__(location)
        self.header = header

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        filesystem, folder = self._folder()
        with filesystem.open_output_stream(f"{folder}/lines", buffer_size=BUFFER) as out:
            for batch in batches:
                out.write("".join(line + LINE_END for line in batch.column(0).to_pylist()).encode("utf-8"))
        return Staged(TaskContext.get().partitionId(), folder)

    def commit(self, messages: list[Staged | None]) -> None:
        """Joins the parts by copying them through a buffer of fixed size."""
        filesystem, root, staging = self._open()
        filesystem.create_dir(staging, recursive=True)
        with filesystem.open_output_stream(f"{staging}/whole", buffer_size=BUFFER) as out:
            out.write((self.header + LINE_END).encode("utf-8"))
            for message in sorted((m for m in messages if m is not None), key=lambda m: m.part):
                with filesystem.open_input_stream(f"{message.folder}/lines") as part:
                    while data := part.read(BUFFER):
                        out.write(data)
        filesystem.move(f"{staging}/whole", root)
        self.abort(messages)


class JobFiles(DataSource):
    """``format("job_files")``, option ``suffix``: a file ``<path>/<job_id><suffix>`` per job, no line end after the last line."""

    @classmethod
    def name(cls) -> str:
        return "job_files"

    def writer(self, schema: StructType, overwrite: bool) -> JobFilesWriter:
        return JobFilesWriter(self.options["path"], self.options.get("suffix", ""))


class CsvFile(DataSource):
    """``format("csv_file")``, option ``header``: the file ``path`` itself."""

    @classmethod
    def name(cls) -> str:
        return "csv_file"

    def writer(self, schema: StructType, overwrite: bool) -> CsvFileWriter:
        return CsvFileWriter(self.options["path"], self.options["header"])
