"""One file per page, as a Spark data source.

``rows.write.format("page_files").mode("append").save(directory)`` writes each row of ``(name, text)``
to a file of that name; ``text`` is a string or binary. Tables are the usual output (``sinks``); this is for consumers that want
files, and for as many pages as a file system takes.

A file appears under its name only when it is complete: it is written beside under a name of the
task's attempt and then moved. The name and content of a file depend on the row alone, so an
attempt that runs again replaces what the one before has left, and no second file stays. Files of
attempts that did not end are removed with the commit, which then leaves ``_SUCCESS``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "page_files"
ATTEMPTS = "_attempts"


@dataclass
class Written(WriterCommitMessage):
    files: int


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"name", "text"} <= set(schema.names):
            raise ValueError("page files need the columns name and text")
        return PageFilesWriter(self.options["path"], overwrite)


class PageFilesWriter(DataSourceWriter):
    def __init__(self, directory: str, overwrite: bool):
        self.directory = directory.rstrip("/")
        if overwrite:
            files, path = file_system(self.directory)
            files.create_dir(path)
            files.delete_dir_contents(path)

    def write(self, iterator: Iterator) -> Written:
        files, path = file_system(self.directory)
        attempts = f"{path}/{ATTEMPTS}"
        files.create_dir(attempts, recursive=True)
        written = 0
        for row in iterator:
            if row["name"] is None or row["text"] is None:
                continue
            text = row["text"]
            attempt = f"{attempts}/{uuid.uuid4().hex}"
            with files.open_output_stream(attempt, compression=None) as out:
                out.write(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text)
            files.move(attempt, f"{path}/{file_name(row['name'])}")
            written += 1
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = file_system(self.directory)
        self._clean(files, path)
        with files.open_output_stream(f"{path}/_SUCCESS", compression=None) as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, path = file_system(self.directory)
        self._clean(files, path)

    @staticmethod
    def _clean(files, path: str) -> None:
        from pyarrow.fs import FileType

        if files.get_file_info(f"{path}/{ATTEMPTS}").type == FileType.Directory:
            files.delete_dir(f"{path}/{ATTEMPTS}")


def file_system(directory: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(directory)


def file_name(name: str) -> str:
    """``name`` as the name of a file in the directory itself, whatever it holds."""
    plain = name.replace("/", "_").replace("\\", "_")
    return f"_{plain}" if plain in ("", ".", "..", "_SUCCESS", ATTEMPTS) else plain


def write_page_files(rows: DataFrame, directory: str, name: str, text: str) -> None:
    """The column ``text`` of each row to a file named by ``name``; rows where one is null have none.

    Names must be unique, as those of results are. A binary column is written byte by byte as it is.
    """
    rows.sparkSession.dataSource.register(PageFiles)
    content = F.col(text) if dict(rows.dtypes)[text] == "binary" else F.col(text).cast("string")
    rows.select(F.col(name).cast("string").alias("name"), content.alias("text")).write.format(FORMAT).mode("append").save(directory)
