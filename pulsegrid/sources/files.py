"""File systems for readers and writers that run in Python, on the driver or in tasks."""

from __future__ import annotations

import re


def file_system(path: str):
    """A file system and a path in it, for file:, hdfs:, s3: and the like, or a plain local path."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def files_in(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file ``path``, or of the files with an ending in the folder, by path."""
    from pyarrow import fs

    system, base = file_system(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(base))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending))
