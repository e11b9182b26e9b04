"""Files inside tasks and planners, wherever a path names them: Arrow's file systems (local, HDFS, object stores).

Small operations only: sizes, seeks, ranges. A path without a scheme, or with ``file:``, is local."""

from __future__ import annotations

from pyarrow import fs as arrow


def at(path: str) -> tuple[arrow.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow.FileSystem.from_uri(path)
    return arrow.LocalFileSystem(), path


def listed(folder: str, suffix: str, recursive: bool = False) -> list[tuple[str, int]]:
    """(path, size) of a folder's files with a suffix, by path; a path of one file gives that file. Names that start with a dot
    or an underscore are others' temporary files."""
    fs, inner = at(folder)
    head = folder[: len(folder) - len(inner)] if "://" in folder else ""
    info = fs.get_file_info(inner)
    found = [info] if info.type == arrow.FileType.File else fs.get_file_info(arrow.FileSelector(inner, allow_not_found=True, recursive=recursive))
    return sorted((head + f.path, f.size) for f in found if f.type == arrow.FileType.File and f.path.endswith(suffix) and f.base_name[0] not in "._")


def read(path: str, start: int, stop: int) -> bytes:
    fs, inner = at(path)
    with fs.open_input_file(inner) as f:
        f.seek(start)
        return f.read(stop - start)


def moved(source: str, target: str) -> None:
    """Rename within one store; replaces the target."""
    fs, inner = at(source)
    fs.move(inner, at(target)[1])


def removed(path: str) -> None:
    """Remove a file if it is there."""
    fs, inner = at(path)
    if fs.get_file_info(inner).type == arrow.FileType.File:
        fs.delete_file(inner)


def exists(path: str) -> bool:
    fs, inner = at(path)
    return fs.get_file_info(inner).type != arrow.FileType.NotFound


def folder(path: str) -> None:
    fs, inner = at(path)
    fs.create_dir(inner, recursive=True)


def opened(path: str):
    """An output stream to a new or replaced file."""
    fs, inner = at(path)
    return fs.open_output_stream(inner, compression=None)
