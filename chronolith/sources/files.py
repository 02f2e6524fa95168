"""Files of repositories, on a mounted path or on any store that Arrow knows by URI (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs

from chronolith.errors import LimitExceeded, NotFound

#: Bytes fetched at once from a pack, and how many such pieces a task keeps.
PIECE, PIECES = 1 << 20, 64


class Store:
    """The files below one path."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/") or "/"

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def is_file(self, name: str) -> bool:
        return self.fs.get_file_info(self.at(name)).type == pafs.FileType.File

    def is_dir(self, name: str) -> bool:
        return self.fs.get_file_info(self.at(name)).type == pafs.FileType.Directory

    def names(self, name: str) -> list[str]:
        """Base names in a folder, sorted; none where there is no folder."""
        found = self.fs.get_file_info(pafs.FileSelector(self.at(name), allow_not_found=True))
        return sorted(f.base_name for f in found)

    def below(self, name: str) -> Iterator[str]:
        """Files of a folder and its folders, as paths from the root, sorted."""
        found = self.fs.get_file_info(pafs.FileSelector(self.at(name), recursive=True, allow_not_found=True))
        start = self.at("").rstrip("/")
        for path in sorted(f.path for f in found if f.type == pafs.FileType.File):
            yield path[path.index(start) + len(start) + 1 :]

    def read(self, name: str, limit: int | None = None, first: int | None = None) -> bytes:
        """A whole file of less than `limit` bytes, or its first bytes."""
        try:
            with self.fs.open_input_file(self.at(name)) as f:
                if limit is not None and f.size() >= limit:
                    raise LimitExceeded(name)
                return f.read(first) if first is not None else f.read()
        except FileNotFoundError as e:
            raise NotFound(name) from e


class Pieces:
    """A long file as bytes that are fetched piece by piece: only what is read of it is in memory."""

    def __init__(self, store: Store, name: str, limit: int):
        self.file = store.fs.open_input_file(store.at(name))
        self.size, self.held = self.file.size(), {}
        if self.size >= limit:
            raise LimitExceeded(name)

    def __len__(self) -> int:
        return self.size

    def piece(self, i: int) -> bytes:
        if (got := self.held.pop(i, None)) is None:
            got = self.file.read_at(min(PIECE, self.size - i * PIECE), i * PIECE)
            while len(self.held) >= PIECES:
                del self.held[next(iter(self.held))]
        self.held[i] = got  # the last in the order of use
        return got

    def __getitem__(self, k: int | slice):
        if isinstance(k, int):
            return self.piece(k // PIECE)[k % PIECE]
        start, stop, _ = k.indices(self.size)
        if stop <= start:
            return b""
        parts = [self.piece(i)[max(0, start - i * PIECE) : stop - i * PIECE] for i in range(start // PIECE, (stop - 1) // PIECE + 1)]
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def all(self) -> Iterator[bytes]:
        """The pieces from the beginning, none of them kept."""
        for a in range(0, self.size, PIECE):
            yield self.file.read_at(min(PIECE, self.size - a), a)
