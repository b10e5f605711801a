"""Files and folders in any file system that pyarrow knows."""

from __future__ import annotations


def filesystem(uri: str):
    """(file system, path in it) of a URI or a local path."""
    import re

    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def open_binary(uri: str, mode: str = "r"):
    """An open file; a file that is written gets its folder."""
    import posixpath

    files, path = filesystem(uri)
    if mode == "r":
        return files.open_input_file(path)
    files.create_dir(posixpath.dirname(path), recursive=True)
    return files.open_output_stream(path)
