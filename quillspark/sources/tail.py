"""[A33] The last lines of files, read from their ends: a Python data source.

    spark.dataSource.register(TailSource)
    spark.read.format("quill_tail").option("paths", "uri;uri").option("lines", 50).load()

Each file is a partition. Its task reads one block of bytes after the other from the end, until it has as many line ends as it needs: a file of any
size costs some blocks. Rows: path, from_end (1 for the last line), line. An empty file has no lines; an end of line at the end of the file begins no other line;
bytes that are no UTF-8 become replacement characters. One line must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.sources.publish import _place

BLOCK = 1 << 20


def last_lines(files: fs.FileSystem, path: str, lines: int, block: int = BLOCK) -> list[str]:
    """The last lines of a file, in their order."""
    with files.open_input_file(path) as source:
        at = source.size()
        pieces: list[bytes] = []
        ends = 0
        while at > 0 and ends <= lines:
            size = min(block, at)
            at -= size
            pieces.append(source.read_at(size, at))
            ends += pieces[-1].count(b"\n")
    text = b"".join(reversed(pieces)).removesuffix(b"\n")
    own = text.split(b"\n")[-lines:] if text or ends else []
    return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in own]


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.lines, self.block = [p for p in options["paths"].split(";") if p], int(options.get("lines", 100)), int(options.get("block", BLOCK))

    def partitions(self) -> list[InputPartition]:
        out = []
        for uri in self.paths:
            files, path = _place(uri)
            info = files.get_file_info(path)
            inner = files.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
            out += [InputPartition((uri, x.path)) for x in inner if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            uri, path = partition.value
            own = last_lines(_place(uri)[0], path, self.lines, self.block)
            yield from ((path, len(own) - k, line) for k, line in enumerate(own))


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_tail"

    def schema(self) -> str:
        return "path string, from_end int, line string"

    def reader(self, schema) -> DataSourceReader:
        return TailReader(self.options)
