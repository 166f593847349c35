"""A sink that writes rows as files: all of them, or none."""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def files_at(path: str):
    """The file system and the path in it; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]  # of the files 0, 1, … in the folder


class FilesWriter(DataSourceWriter):
    """Tasks write below a folder of this job's own; what a failed or repeated task leaves there is never moved out of it."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_files-{uuid.uuid4().hex}"
        system, base = files_at(self.path)
        system.create_dir(f"{base}/{self.job}", recursive=True)

    def write(self, iterator: Iterator) -> Staged:
        system, base = files_at(self.path)
        own, names, seen = f"{base}/{self.job}/{uuid.uuid4().hex}", [], set()
        system.create_dir(own, recursive=False)  # fails once the job's folder is gone, so that a late task leaves nothing
        for i, row in enumerate(iterator):
            name = row["name"]
            if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"a file can't be named {name!r}")
            if name in seen:
                raise ValueError(f"two rows are named {name!r}")
            seen.add(name)
            with system.open_output_stream(f"{own}/{i}") as f:
                f.write(bytes(row["content"]))
            names.append(name)
        return Staged(own, names)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = files_at(self.path)
        names = [name for m in messages if m for name in m.names]
        try:
            if len({*names}) < len(names):
                twice = next(n for n, k in Counter(names).items() if k > 1)
                raise ValueError(f"two rows are named {twice!r}")
            with ThreadPoolExecutor(16) as pool:  # a file takes a few calls to the store, and there may be a million
                if not self.overwrite:
                    parts = [[f"{base}/{n}" for n in names[a : a + 1000]] for a in range(0, len(names), 1000)]
                    for found in pool.map(system.get_file_info, parts):
                        if there := next((i.path for i in found if i.type.name != "NotFound"), None):
                            raise FileExistsError(f"{there.removeprefix(f'{base}/')!r} is there already")
                for folder in sorted({f"{base}/{n}".rpartition("/")[0] for n in names}):
                    system.create_dir(folder, recursive=True)
                move = lambda m: [system.move(f"{m.folder}/{i}", f"{base}/{name}") for i, name in enumerate(m.names)]
                list(pool.map(move, [m for m in messages if m]))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, base = files_at(self.path)
        for attempt in range(10):
            if system.get_file_info(f"{base}/{self.job}").type.name != "Directory":
                return
            try:
                system.delete_dir(f"{base}/{self.job}")
            except OSError:  # a task that was just writing
                time.sleep(0.1 * attempt)


class Files(DataSource):
    """Format ``named_files``: rows (name, content) become files of these names below the path.

    Names may have folders. Nothing appears before every task has ended well; then files are moved to
    their places. In mode append a name that is there already fails the job before a file is moved; in
    mode overwrite it is replaced, and other files stay.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if {*schema.names} != {"name", "content"}:
            raise ValueError("rows of named files have a name and a content")
        return FilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes rows (name, content as bytes or text) as files below ``path``."""
    rows.sparkSession.dataSource.register(Files)
    rows.selectExpr("cast(name as string) as name", "cast(content as binary) as content").write.format("named_files").mode("overwrite" if overwrite else "append").save(path)
