"""Files that tasks write and read in the shared folder, by any file system pyarrow knows."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit


def _place(path: str):
    from pyarrow import fs

    if urlsplit(path).scheme:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class NewFile:
    """A file that appears under its name only when whole.

    A task that is run again, or twice at once, writes the same bytes under a
    name of its own and moves them into place, so readers never see half a file.
    """

    closed = False

    def __init__(self, path: str):
        self.system, self.path = _place(path)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(self.draft)
        self.size = 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.size += len(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        pass

    def close(self) -> None:
        pass

    def finish(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.path)

    def __enter__(self) -> NewFile:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.finish()
        else:
            self.stream.close()
            self.system.delete_file(self.draft)


def open_file(path: str):
    """A file opened for reads at any offset (``read_at``)."""
    system, path = _place(path)
    return system.open_input_file(path)


def exists(path: str) -> bool:
    from pyarrow import fs

    system, path = _place(path)
    return system.get_file_info(path).type == fs.FileType.File


def remove(path: str) -> None:
    """Remove a file; it may have gone already."""
    if exists(path):
        system, path = _place(path)
        system.delete_file(path)
