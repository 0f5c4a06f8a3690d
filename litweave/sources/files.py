"""Files opened inside tasks, wherever they lie."""

from __future__ import annotations


def open_fs(path: str):
    """(file system, path in it) of a local path or a URI (file, hdfs, s3, gs ...)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str, suffix: str) -> list[str]:
    """The files of a folder with a suffix, or the one file itself, as paths for ``open_fs``."""
    from pyarrow import fs

    system, at = open_fs(path)
    head = path[: len(path) - len(at)] if "://" in path and path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type != fs.FileType.Directory:
        return [path]
    return sorted(head + f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(suffix))
