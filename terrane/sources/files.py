"""Files by path or address, readable and seekable on the driver and in tasks without a JVM."""

from __future__ import annotations


def open_at(path: str):
    """A seekable binary file: a plain path, or an address such as s3://, gs://, hdfs:// or file:// that pyarrow has a file system for.

    A path without a scheme must be one that all executors see; object stores are read by ranges.
    """
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)
