"""Files written by tasks, all of them or none.

A write has a drafts folder of its own inside the target. Tasks write drafts
there; the commit renames those that Spark accepted and drops the folder, with
whatever failed, repeated or lost attempts left in it; an abort drops the folder
alone. Readers that list the target see finished files only.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark.sql.datasource import WriterCommitMessage

DRAFTS = "_drafts-"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class Drafted(WriterCommitMessage):
    """What one task wrote: (draft, final name) pairs."""

    files: list[tuple[str, str]] = field(default_factory=list)


class Drafts:
    """The drafts folder of one write; ``name`` tells it from those of other writes to the target."""

    def __init__(self, target: str, name: str | None = None):
        self.target, self.folder = target, f"{target.rstrip('/')}/{DRAFTS}{name or uuid.uuid4().hex}"

    def write(self, content: bytes) -> str:
        """Store a draft under a name of its own and return that."""
        name = uuid.uuid4().hex
        with self.stream(name) as out:
            out.write(content)
        return name

    def stream(self, name: str):
        fs, folder = opened(self.folder)
        fs.create_dir(folder, recursive=True)
        return fs.open_output_stream(f"{folder}/{name}", compression=None)

    def commit(self, messages: list[Drafted | None]) -> None:
        fs, folder = opened(self.folder)
        target = opened(self.target)[1]
        fs.create_dir(target, recursive=True)
        for draft, name in (f for m in messages if m is not None for f in m.files):
            fs.move(f"{folder}/{draft}", f"{target}/{name}")
        self.abort()

    def abort(self) -> None:
        fs, folder = opened(self.folder)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)
