"""A committed sink for image files: one file per row.

Tasks write below ``_temporary/<id of the write>`` of the target, each attempt
in a folder of its own. Only when all tasks are done does the commit move the
files to their places, so a killed or repeated task leaves no half file, no
file of a failed write is ever seen, and what an attempt left goes with the
temporary folder. ``_SUCCESS`` is written last.

Files are reached through ``pyarrow.fs`` (local and shared folders, S3, GCS,
HDFS where its client library is installed), by the tasks and by the commit."""

from __future__ import annotations

import posixpath
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "panelscope-image-folder"
TEMPORARY = "_temporary"
#: Files written between two looks at the free space; bytes copied at a time.
CHECK_EVERY, COPY_BYTES = 500, 1 << 20
#: Files that the commit moves at a time.
THREADS = 16


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path[len("file:") :] if path.startswith("file:") else path
    return pafs.FileSystem.from_uri(path.replace(" ", "%20"))


def free_bytes(files: pafs.FileSystem, path: str) -> int | None:
    """Free space of the file system that holds ``path``; None where there is no such figure (object stores)."""
    if not isinstance(files, pafs.LocalFileSystem):
        return None
    return shutil.disk_usage(path).free


def check_free(files: pafs.FileSystem, path: str, least: int) -> None:
    free = free_bytes(files, path)
    if free is not None and free < least:
        raise OSError(f"Writing stops: {free / 2**20:.2f} MiB are free on the target's file system, {least / 2**20:.2f} MiB must remain.")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    skipped: int


class ImageFolder(DataSource):
    """Rows (name, content): ``content`` becomes the file ``name`` (with folders)
    below ``path``. Rows (name, source): the file at ``source`` is copied there.

    With ``append`` a file that exists already is an error, or kept as it is with ``existing=keep``;
    ``overwrite`` removes what the target held before. Rows with a null are skipped."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL("name string, content binary")

    def writer(self, schema: T.StructType, overwrite: bool) -> "ImageFolderWriter":
        if [f.name for f in schema] not in (["name", "content"], ["name", "source"]):
            raise ValueError("The image sink takes the columns name and content, or name and source.")
        return ImageFolderWriter(dict(self.options), overwrite)


class ImageFolderWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.target = options["path"].rstrip("/")
        self.least = int(options.get("minfreebytes", options.get("minFreeBytes", "0")))
        self.keep = options.get("existing", "error") == "keep"
        self.overwrite = overwrite
        self.stage = f"{TEMPORARY}/{uuid.uuid4().hex}"
        files, root = filesystem(self.target)
        files.create_dir(posixpath.join(root, self.stage), recursive=True)  # here only: a task that outlives a failed write must not bring it back

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.target)
        task = TaskContext.get()
        folder = posixpath.join(root, self.stage, f"{task.partitionId()}-{task.taskAttemptId()}")
        files.create_dir(folder, recursive=False)
        made, names, n, skipped = set(), set(), 0, 0
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name is None or not content.is_valid:
                    skipped += 1
                    continue
                parts = posixpath.normpath(name)
                if parts.startswith(("..", "/")) or parts.startswith(TEMPORARY):
                    raise ValueError(f"{name!r} lies outside the target folder.")
                if n % CHECK_EVERY == 0:
                    check_free(files, folder, self.least)
                path = posixpath.join(folder, parts)
                if path in names:
                    raise ValueError(f"Two rows have the file name {name!r}.")
                names.add(path)
                steps = posixpath.dirname(parts).split("/")
                for k in range(1, len(steps) + 1) if steps[0] else ():
                    if (inner := posixpath.join(folder, *steps[:k])) not in made:
                        files.create_dir(inner, recursive=False)
                        made.add(inner)
                with files.open_output_stream(path) as out:
                    if pa.types.is_string(content.type):
                        origin, at = filesystem(content.as_py())
                        with origin.open_input_stream(at) as source:
                            while block := source.read(COPY_BYTES):
                                out.write(block)
                    else:
                        out.write(content.as_buffer())
                n += 1
        return Written(folder, n, skipped)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.target)
        done = [m for m in messages if m is not None]
        check_free(files, root, self.least)
        with ThreadPoolExecutor(THREADS) as pool:
            self._place(files, root, done, pool)
        self._clean(files, root)
        with files.open_output_stream(posixpath.join(root, "_SUCCESS")):
            pass

    def _place(self, files: pafs.FileSystem, root: str, done: list[Written], pool: ThreadPoolExecutor) -> None:
        """Moves the files of the tasks to their places, many at a time: a file system takes most of its time to answer."""

        def of_task(m: Written) -> list[tuple[str, str]]:
            found = files.get_file_info(pafs.FileSelector(m.folder, recursive=True, allow_not_found=True))
            return [(f.path, posixpath.join(root, posixpath.relpath(f.path, m.folder))) for f in found if f.type == pafs.FileType.File]

        moves = [pair for part in pool.map(of_task, done) for pair in part]
        targets = [t for _, t in moves]
        if len(set(targets)) != len(targets):
            raise ValueError("Two rows have the same file name; nothing was written.")
        if self.overwrite:
            for f in files.get_file_info(pafs.FileSelector(root)):
                if posixpath.basename(f.path) != TEMPORARY:
                    (files.delete_dir if f.type == pafs.FileType.Directory else files.delete_file)(f.path)
        else:
            parts = [targets[k : k + 1000] for k in range(0, len(targets), 1000)]
            there = {f.path for found in pool.map(files.get_file_info, parts) for f in found if f.type != pafs.FileType.NotFound}
            if there and not self.keep:
                raise FileExistsError(f"{len(there)} file(s) exist already, {min(there)!r} among them; nothing was written.")
            moves = [m for m in moves if m[1] not in there]
        for parent in sorted({posixpath.dirname(t) for _, t in moves}):
            files.create_dir(parent, recursive=True)

        def move(part: list[tuple[str, str]]) -> None:
            for source, target in part:
                files.move(source, target)

        list(pool.map(move, (moves[k : k + 100] for k in range(0, len(moves), 100))))

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*filesystem(self.target))

    def _clean(self, files: pafs.FileSystem, root: str) -> None:
        for folder in (posixpath.join(root, self.stage), posixpath.join(root, TEMPORARY)):
            inside = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            if files.get_file_info(folder).type == pafs.FileType.Directory and (folder.endswith(self.stage) or not inside):
                files.delete_dir(folder)
