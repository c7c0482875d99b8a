"""Shard files in the shared folder: tasks write them under names that no other attempt has, and the rows that tell of
them count only once the task is committed. What a lost attempt wrote is never read."""

from __future__ import annotations

import uuid

from .common import local_file


class ShardWriter:
    """Appends byte strings to files of about ``most`` bytes in ``folder``."""

    def __init__(self, folder: str, suffix: str, most: int) -> None:
        self.folder, self.suffix, self.most = folder, suffix, most
        self.path, self.out, self.at = "", None, 0

    def place(self) -> tuple[str, int]:
        """The file and offset at which the next bytes go."""
        if self.out is None or self.at >= self.most:
            self.close()
            self.path = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            fs, inner = local_file(self.path)
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            self.out, self.at = fs.open_output_stream(inner, compression=None), 0
        return self.path, self.at

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self, end: bytes = b"") -> None:
        if self.out is not None:
            self.out.write(end)
            self.out.close()
            self.out = None


class RangeReader:
    """Ranges of a file, through one block that is read ahead; memory is bounded by the block and the range asked for."""

    def __init__(self, path: str, block: int = 1 << 20) -> None:
        fs, inner = local_file(path)
        self.file, self.block, self.start, self.held = fs.open_input_file(inner), block, 0, b""
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, self.block))
        return self.held[at - self.start : at - self.start + n]

    def range(self, at: int, n: int) -> bytes:
        """Exactly this range from the file, nothing read ahead."""
        return self.file.read_at(n, at)

    def find(self, marks: tuple[bytes, ...], at: int) -> int:
        """The first place from ``at`` on where one of ``marks`` stands; the file's size if there is none."""
        overlap = max(map(len, marks)) - 1
        while at < self.size:
            data = self.read(at, self.block)
            found = [i for m in marks if (i := data.find(m)) >= 0]
            if found:
                return at + min(found)
            at += max(1, len(data) - overlap)
            if len(data) <= overlap:
                break
        return self.size

    def close(self) -> None:
        self.file.close()
