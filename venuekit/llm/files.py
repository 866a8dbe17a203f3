"""Binary files in a folder that the driver and all executors reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow.fs


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


def put(folder: str, name: str, parts: Iterable[bytes]) -> None:
    """Write a file under a temporary name and move it: a task that runs again leaves the same file."""
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    fs.move(draft, f"{root}/{name}")


def get(folder: str, name: str) -> bytes:
    fs, root = open_folder(folder)
    with fs.open_input_stream(f"{root}/{name}") as source:
        return source.read()
