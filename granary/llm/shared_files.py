"""Files of the shared folder as tasks see them (the session's own file system lives in the JVM)."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyarrow import fs

#: names that the store's own library does not know, and the one it does
_SAME = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI of any kind that the session's ``spark.checkpoint.dir`` may have."""
    scheme = urlsplit(uri).scheme
    if not scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "viewfs":
        return fs.HadoopFileSystem.from_uri(uri), urlsplit(uri).path
    return fs.FileSystem.from_uri(_SAME.get(scheme, scheme) + uri[len(scheme) :])
