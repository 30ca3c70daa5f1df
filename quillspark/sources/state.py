"""[A27] State that is kept in several places: a Python data source that reads each shard from the first place where it is sound.

    spark.dataSource.register(StateSource)
    spark.read.format("quill_state").option("places", "remote=uri;mirror=uri;local=uri").option("shards", 16).load()

A shard is a JSON file `shard-N.json` of a place: {"version": 1, "entries": [{"key", "value"}, ...]}. A place fails for a shard, by a reason of its own, if
it has no such file (missing), the file can't be read (unreadable), isn't JSON (damaged), has another version (version) or entries of another form
(form). Each shard is a partition, so places are tried in parallel, and one bad shard doesn't turn all others to the next place. Rows: shard, place,
failures (place:reason of those tried before), key, value; a shard that no place has gives one row with a null place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.sources.publish import _place

VERSION = 1


def sound_shard(uri: str, shard: int) -> tuple[list[tuple[str, str | None]] | None, str | None]:
    """Entries of a shard, or why there are none."""
    files, root = _place(uri)
    path = f"{root.rstrip('/')}/shard-{shard}.json"
    try:
        if files.get_file_info(path).type != fs.FileType.File:
            return None, "missing"
        with files.open_input_stream(path) as source:
            raw = source.read()
    except OSError:
        return None, "unreadable"
    try:
        state = json.loads(raw)
    except ValueError:
        return None, "damaged"
    if not isinstance(state, dict) or state.get("version") != VERSION:
        return None, "version"
    entries = state.get("entries")
    if not isinstance(entries, list) or not all(isinstance(e, dict) and isinstance(e.get("key"), str) and isinstance(e.get("value"), (str, type(None))) for e in entries):
        return None, "form"
    return [(e["key"], e.get("value")) for e in entries], None


class StateReader(DataSourceReader):
    def __init__(self, options: dict):
        self.places = [tuple(p.split("=", 1)) for p in options["places"].split(";") if p]
        self.shards = int(options.get("shards", 16))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.shards)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        failures = []
        for name, uri in self.places:
            entries, reason = sound_shard(uri, partition.value)
            if entries is not None:
                yield from ((partition.value, name, ",".join(failures), key, value) for key, value in entries)
                return
            failures.append(f"{name}:{reason}")
        yield partition.value, None, ",".join(failures), None, None


class StateSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_state"

    def schema(self) -> str:
        return "shard int, place string, failures string, key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return StateReader(self.options)
