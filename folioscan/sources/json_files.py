"""One JSON file per record: a data source that writes whole or not at all.

    spark.dataSource.register(JsonFiles)
    df.write.format("json_files").mode("append").option("name", "chunk_id").save(folder)

`name` is the column that names the files; it is kept in the records unless
`drop_name` is true.  Tasks write to a folder beside the target; when all have
ended, the job looks whether a file is there already (an error without
`force=true`) or named twice (an error), and only then moves the files into place.
A job that fails leaves the target as it was.  Nulls are left out of records.

The folder is one that all workers see, given as a path or as an address that
pyarrow's file systems know.  Names are made safe: all but letters, digits, dots,
dashes and underscores becomes two underscores.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def file_name(name: str | None) -> str:
    safe = re.sub(r"[^A-Za-z0-9._-]+", "__", name or "")
    if not safe.strip("._"):
        raise ValueError(f"no file can have the name {name!r}")
    return f"{safe}.json"


def without_nulls(value):
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class JsonFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        options = {k.lower(): v for k, v in self.options.items()}
        if not options.get("path") or not options.get("name"):
            raise ValueError("json_files wants a path and the option name")
        return _Writer(options["path"], options["name"], options.get("force") == "true", options.get("drop_name") == "true")


class _Writer(DataSourceWriter):
    def __init__(self, path: str, name: str, force: bool, drop: bool):
        self.path, self.column, self.force, self.drop = path.rstrip("/"), name, force, drop
        self.part = f"_part-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = self._open()
        folder = f"{root}/{self.part}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        names = []
        for row in rows:
            record = row.asDict(recursive=True)
            name = file_name(record.pop(self.column) if self.drop else record[self.column])
            text = json.dumps(without_nulls(record), indent=2, ensure_ascii=False) + "\n"
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(text.encode())
            names.append(f"{folder.rpartition('/')[2]}/{name}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._open()
        made = [n for m in messages if m for n in m.names]
        targets = [n.rpartition("/")[2] for n in made]
        if len(set(targets)) < len(targets):
            twice = next(n for i, n in enumerate(targets) if n in targets[:i])
            self.abort(messages)
            raise ValueError(f"two records are named {twice}")
        there = {f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True))}
        if not self.force and (found := sorted(there & set(targets))):
            self.abort(messages)
            raise FileExistsError(f"{found[0]} is in {self.path} already")
        for n, target in zip(made, targets, strict=True):
            files.move(f"{root}/{self.part}/{n}", f"{root}/{target}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Also tidies up after a commit: nothing but the parts' folder goes."""
        files, root = self._open()
        if files.get_file_info(f"{root}/{self.part}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.part}")


def write_records(df: DataFrame, folder: str, name: str, force: bool = False, drop_name: bool = False) -> None:
    df.sparkSession.dataSource.register(JsonFiles)
    writer = df.write.format("json_files").mode("append").option("name", name)
    writer.option("force", str(force).lower()).option("drop_name", str(drop_name).lower()).save(folder)
