"""Bytes of files under a path that all machines see: local folders, or any store that pyarrow opens."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", path))


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path in the store, bytes) of a file, or of the files in a folder and below, in the order of their
    names; names that start with '_' or '.' are passed over, folders of that kind too."""
    store, root = opened(path)
    found = store.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.is_file:
        return [(found.path, found.size)]
    files = store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: re.search(r"(^|/)[_.]", p[len(root.rstrip("/")) + 1 :])
    return sorted((x.path, x.size) for x in files if x.is_file and x.path.endswith(suffix) and not hidden(x.path))


def pieces(files: list[tuple[str, int]], size: int) -> list[list[tuple[str, int, int]]]:
    """Tasks of about `size` bytes: each a list of (path, first byte, end). Long files are cut, short ones share a task."""
    tasks, room = [], 0
    for path, total in files:
        for start in range(0, max(total, 1), size):
            end = min(total, start + size)
            if not tasks or end - start > room:
                tasks.append([])
                room = size
            tasks[-1].append((path, start, end))
            room -= max(end - start, size // 1000)  # opening a file costs something, too
    return tasks
