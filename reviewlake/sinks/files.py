"""Small files that a driver or a task writes by itself, on any file system pyarrow knows."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a path or URI, and the folder's path on it."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def read_entry(files: fs.FileSystem, path: str) -> dict:
    """A JSON file, empty if there is none."""
    try:
        with files.open_input_stream(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {}


def write_entry(files: fs.FileSystem, path: str, entry: dict) -> None:
    """A JSON file that readers see whole: it takes its name in one step."""
    folder = path.rpartition("/")[0]
    files.create_dir(folder, recursive=True)
    waiting = f"{folder}/_{uuid.uuid4().hex}"
    with files.open_output_stream(waiting) as out:
        out.write(json.dumps(entry).encode())
    files.move(waiting, path)


def delete_file(files: fs.FileSystem, path: str) -> None:
    try:
        files.delete_file(path)
    except FileNotFoundError:
        pass


def names(files: fs.FileSystem, folder: str) -> list[str]:
    """Names in a folder that do not begin with _ or ., none if there is no folder."""
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name[0] not in "_.")
