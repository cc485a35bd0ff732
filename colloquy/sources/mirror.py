"""Mirrors as a data source: one JSON file a sample, in the folder of its status.

    spark.dataSource.register(MirrorSource)
    samples.write.format("mirror").mode("append").save(path)
    spark.read.format("mirror").load(path)

Tasks write to a folder of the job's own. Committing moves its files into place and removes what older copies of the same ids
lie in the other folders; a job that is aborted leaves nothing. The path is one that driver and workers share: a mounted folder,
or a URI that pyarrow reads. A mirror has as many files as samples and its commit one move a file, so it is for what people
look at, not for whole corpora.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from colloquy.sources.files import FOLDERS, SAMPLE

#: Files that one task reads.
FILES_A_TASK = 1000
_STAGING = ".staging-"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def folder_of(status: str | None) -> str:
    return FOLDERS.get(status or "", "raw")


def file_name(key: object) -> str:
    """An id as a file name: what could be read as a path or a hidden file is escaped."""
    name = quote(str(key), safe="")
    return f"{'%2E' + name[1:] if name.startswith('.') else name}.json"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, float]]):
        super().__init__(len(files))
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[_Files]:
        files, root = _open(self.path)
        found = []
        for folder in sorted(set(FOLDERS.values())):
            listed = files.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True))
            found += [(x.path, folder, x.mtime.timestamp() if x.mtime else 0.0) for x in sorted(listed, key=lambda x: x.path) if x.is_file and x.extension == "json"]
        return [_Files(found[i : i + FILES_A_TASK]) for i in range(0, len(found), FILES_A_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, _ = _open(self.path)
        kinds = {f.name: f.dataType.typeName() for f in self.schema.fields}
        for path, folder, mtime in partition.files:
            with files.open_input_stream(path) as stream:
                raw = stream.read().decode("utf-8", "replace")
            try:
                own = json.loads(raw)
                if not isinstance(own, dict) or own.get("id") is None:
                    raise ValueError("no sample")
                own["_corrupt"] = None
                yield tuple(_value({**own, "folder": folder, "mtime": mtime, "file": path}.get(n), kind) for n, kind in kinds.items())
            except (ValueError, TypeError, AttributeError):
                yield tuple({"_corrupt": raw, "folder": folder, "mtime": mtime, "file": path}.get(n) for n in kinds)


def _value(value: object, kind: str) -> object:
    if value is None:
        return None
    if kind == "double":
        return float(value)
    if kind == "array":
        return [(m.get("role"), m.get("content")) for m in value]
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:  # noqa: ANN401
        """Each attempt of a task has a folder of its own; a later row of an id replaces an earlier one."""
        files, root = _open(self.path)
        own, there = f"{root}/{_STAGING}{self.job}/{uuid.uuid4().hex}", set()
        for row in rows:
            sample = row.asDict(recursive=True)
            if sample.get("id") is None:
                raise ValueError("a sample without an id has no mirror")
            at = f"{own}/{folder_of(sample.get('status'))}"
            if at not in there:
                files.create_dir(at, recursive=True)
                there.add(at)
            with files.open_output_stream(f"{at}/{file_name(sample['id'])}") as out:
                out.write(json.dumps(sample, ensure_ascii=False, default=str).encode())
        message = WriterCommitMessage()
        message.folder = own
        return message

    def commit(self, messages: list) -> None:
        files, root = _open(self.path)
        folders, kept = sorted(set(FOLDERS.values())), set()
        for folder in folders:
            files.create_dir(f"{root}/{folder}", recursive=True)
        for message in (m for m in messages if m is not None):
            for x in files.get_file_info(fs.FileSelector(message.folder, recursive=True, allow_not_found=True)):
                if x.is_file:
                    folder, name = x.path.split("/")[-2:]
                    files.move(x.path, f"{root}/{folder}/{name}")
                    kept.add((folder, name))
        names = {}
        for folder, name in kept:
            names[name] = folder
        for folder in folders:
            for x in files.get_file_info(fs.FileSelector(f"{root}/{folder}")):
                stale = names.get(x.base_name, folder) != folder if not self.overwrite else (folder, x.base_name) not in kept
                if x.is_file and stale:
                    files.delete_file(x.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:  # noqa: ARG002
        files, root = _open(self.path)
        at = f"{root}/{_STAGING}{self.job}"
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)


class MirrorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mirror"

    def schema(self) -> str:
        return f"{SAMPLE}, folder string, mtime double, file string, _corrupt string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:  # noqa: ARG002
        return _Writer(self.options["path"], overwrite)
