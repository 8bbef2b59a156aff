"""Files that tasks write to and read from the cluster's shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file named by path or URI."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def make_folder(path: str) -> None:
    system, place = file_system(path)
    system.create_dir(place, recursive=True)


def attempt_name(label: str, suffix: str) -> str:
    """A name no other attempt of the same task uses. What a failed or repeated
    attempt leaves is never listed in a manifest and so never read."""
    return f"{label}-{uuid.uuid4().hex}{suffix}"


@contextmanager
def written(path: str):
    system, place = file_system(path)
    with system.open_output_stream(place, compression=None) as out:
        yield out


@contextmanager
def opened(path: str):
    system, place = file_system(path)
    with system.open_input_file(place) as source:
        yield source
