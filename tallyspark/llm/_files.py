"""Files in the shared folder, opened from Python tasks through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def create(uri: str):
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_stream(uri: str):
    system, path = place(uri)
    return system.open_input_stream(path, compression=None)


def open_random(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)


def parquet_files(uri: str) -> list[tuple[fs.FileSystem, str]]:
    system, path = place(uri)
    return [(system, f.path) for f in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.path) if f.path.endswith(".parquet")]
