"""A stream of what changes in a folder: a Python data source that compares snapshots.

An offset is the number of a snapshot: a file that lists, under ``state``, every file of the
folder with its size, its time and its identity on the disk. Two snapshots give the rows between
them, so a batch that is run again gives the same rows, and a query that starts again from its
checkpoint repeats nothing and misses nothing.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, event string, action string, old_path string, size long, modified_ns long"
#: What is done about each event.
ACTIONS = {"created": "upsert", "modified": "upsert", "deleted": "delete", "moved": "move"}
#: Rows of one partition.
ROWS = 1000

Listing = dict[str, list[Any]]


def listed(folder: str, recursive: bool = True) -> Listing:
    """``[size, time, device, number]`` of every file by its path. What goes away meanwhile is left out; links to folders are not followed."""
    out: Listing = {}
    folders = [folder]
    while folders:
        try:
            with os.scandir(folders.pop()) as entries:
                for entry in entries:
                    try:
                        if entry.is_dir(follow_symlinks=False):
                            if recursive:
                                folders.append(entry.path)
                        elif entry.is_file():
                            s = entry.stat()
                            out[entry.path] = [s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino]
                    except OSError:
                        continue
        except OSError:
            continue
    return out


def changed(before: Listing, after: Listing) -> list[tuple]:
    """Rows of ``SCHEMA`` between two snapshots, by path. A file of the same identity, size and time under another path has moved; of several such paths the first one is meant."""
    gone: dict[tuple, list[str]] = {}
    for path in sorted(before.keys() - after.keys(), reverse=True):
        gone.setdefault(tuple(before[path]), []).append(path)
    rows = []
    for path in sorted(after):
        size, time = after[path][:2]
        if path not in before:
            old = gone.get(tuple(after[path]))
            rows.append((path, "moved", ACTIONS["moved"], old.pop(), size, time) if old else (path, "created", ACTIONS["created"], None, size, time))
        elif before[path][:2] != after[path][:2] or before[path][2:] != after[path][2:]:
            rows.append((path, "modified", ACTIONS["modified"], None, size, time))
    rows += [(path, "deleted", ACTIONS["deleted"], None, None, None) for paths in gone.values() for path in paths]
    return sorted(rows, key=lambda r: r[0])


@dataclass
class Rows(InputPartition):
    rows: list[tuple]


class FolderReader(DataSourceStreamReader):
    """Lists and compares in the driver; tasks are given the rows, so only the driver has to see the folder."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.state = options["path"], options["state"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        os.makedirs(self.state, exist_ok=True)

    def _file(self, number: int) -> str:
        return os.path.join(self.state, f"{number:012}.json")

    def _snapshot(self, number: int) -> Listing:
        if not number:
            return {}
        with open(self._file(number), encoding="utf-8") as f:
            return json.load(f)

    def _last(self) -> int:
        return max([int(n.removesuffix(".json")) for n in os.listdir(self.state) if n.endswith(".json")], default=0)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        last, now = self._last(), listed(self.folder, self.recursive)
        if now != self._snapshot(last):
            last += 1
            hidden = f"{self._file(last)}.new"
            with open(hidden, "w", encoding="utf-8") as f:
                json.dump(now, f)
            os.replace(hidden, self._file(last))
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = changed(self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"]))
        return [Rows(rows[at : at + ROWS]) for at in range(0, len(rows), ROWS)] or [Rows([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Snapshots before the committed one are not asked for again."""
        for name in os.listdir(self.state):
            if name.endswith(".json") and int(name.removesuffix(".json")) < end["snapshot"]:
                os.remove(os.path.join(self.state, name))


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes").option("path", ...).option("state", ...)``; option ``recursive`` (true)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(dict(self.options))
