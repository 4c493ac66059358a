"""Two-phase commit of files that many tasks write.

Every attempt of a task writes below a folder of its own, `_data/<write>/<attempt>/`.
Only when all tasks are done does the driver publish a manifest, `_commits/<write>.json`,
with the files of the attempts that counted; readers take nothing below `_data` that no
manifest names. So a task that was retried, ran twice or was lost half-way leaves nothing
that is read, and a write is seen as a whole or not at all. What other attempts left is
deleted, by commit or abort.

Files that others put into the folder are read as they are. A write in mode overwrite
publishes a manifest that hides all that was in the folder before.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

DATA, COMMITS = "_data", "_commits"


@dataclass
class Written(WriterCommitMessage):
    """The files of one attempt, relative to the folder."""

    files: list[str]


class Commit:
    """One write: made with the writer on the driver and sent to its tasks."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite
        self.id = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        from .files import store

        filesystem, root = store(self.path)
        return filesystem, root.rstrip("/")

    def attempt(self) -> tuple[fs.FileSystem, str, str]:
        """(filesystem, folder, names' beginning) for the files of this task's attempt."""
        from pyspark import TaskContext

        filesystem, root = self._store()
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{self.id[-8:]}-{task.taskAttemptId()}"
        folder = f"{root}/{DATA}/{self.id}/{name}"
        filesystem.create_dir(folder, recursive=True)
        return filesystem, folder, name

    def written(self, paths: list[str]) -> Written:
        """The message of an attempt that has closed these files."""
        root = self._store()[1]
        return Written([p[len(root) + 1 :] for p in paths])

    def publish(self, messages) -> None:
        filesystem, root = self._store()
        files = [f for m in messages if m is not None for f in m.files]
        filesystem.create_dir(f"{root}/{COMMITS}", recursive=True)
        part = f"{root}/{COMMITS}/{self.id}.part"
        with filesystem.open_output_stream(part) as f:
            f.write(json.dumps({"files": files, "replaces": self.overwrite}).encode())
        filesystem.move(part, f"{root}/{COMMITS}/{self.id}.json")
        counted = {f.rsplit("/", 1)[0] for f in files}
        for x in filesystem.get_file_info(fs.FileSelector(f"{root}/{DATA}/{self.id}", allow_not_found=True)):
            if x.path[len(root) + 1 :] not in counted:
                self._dropped(filesystem, x.path)

    def cancel(self) -> None:
        filesystem, root = self._store()
        self._dropped(filesystem, f"{root}/{DATA}/{self.id}")

    @staticmethod
    def _dropped(filesystem: fs.FileSystem, folder: str) -> None:
        """Delete a folder; an attempt that still writes there may make it fail, and what
        it leaves is never read."""
        try:
            filesystem.delete_dir(folder)
        except OSError:
            pass


def logical(path: str) -> str:
    """A path without the folders of its write and attempt."""
    head, found, tail = path.partition(f"{DATA}/")
    return head + tail.split("/", 2)[2] if found and tail.count("/") >= 2 else path


def visible(filesystem: fs.FileSystem, root: str, infos: list[fs.FileInfo]) -> list[fs.FileInfo]:
    """Of all files below root, those that readers take."""
    base = lambda path, mark: path[: path.index(mark)] if mark in path else None
    manifests: dict[str, list[str]] = {}
    for x in infos:
        folder = base(x.path, f"{COMMITS}/")
        if folder is not None and x.path.endswith(".json"):
            manifests.setdefault(folder, []).append(x.path)
    named, replaced = set(), []
    for folder, paths in manifests.items():
        for path in sorted(paths, reverse=True):
            with filesystem.open_input_file(path) as f:
                own = json.loads(f.read())
            named.update(folder + x for x in own["files"])
            if own["replaces"]:
                replaced.append(folder)
                break
    out = []
    for x in infos:
        if f"{COMMITS}/" in x.path[len(root) :] or (f"{DATA}/" in x.path[len(root) :] and x.path not in named):
            continue
        if x.path in named or not any(x.path.startswith(folder) for folder in replaced):
            out.append(x)
    return out
