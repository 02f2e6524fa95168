"""Data source "gitrepo": on-disk repositories as tables.

    register(spark); spark.read.format("gitrepo").option("path", "/a,/b").option("table", "objects").load()

Tables: objects (loose and packed, each packed object with its deltas applied), pack_entries (as stored), pack_index,
refs. Options: path (comma-parted list; each the work tree or a bare repository, or a folder followed by /* for all
repositories in it; a path, or the URI of a store that Arrow knows; its text is the repo_id), mode (FAILFAST or
PERMISSIVE, which adds an error column), verify (none, trailer or full; full re-hashes packed objects), the limits of
schemas.LIMITS, and encoding of names. Equality filters on oid and type are taken over.

Partitions are groups of loose folders and, of each pack, ranges of its objects in the order of the pack. Planning reads
1,032 bytes of each pack index. A pack's checksum is verified by the task of its first range alone; all tasks read only
the pieces of the pack that their objects and the bases of those lie in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from chronolith import schemas
from chronolith.errors import CorruptedObject, InvalidPath, MalformedObject, MalformedRef, NotAGitRepo, NotFound, RepoError
from chronolith.functions import codec
from chronolith.sources.files import Pieces, Store

#: Packed objects of one partition.
RANGE = 20_000
#: Partitions of a repository's 256 loose folders.
LOOSE = 8
#: Inflated objects that a task keeps as delta bases, in bytes.
KEPT = 128 << 20


def git_dir(path: str) -> tuple[str, bool]:
    """(folder of the repository, whether it is bare)."""
    if not path or len(path.encode()) > 4096:
        raise InvalidPath(path)
    store = Store(path)
    if store.is_dir(".git"):
        return path.rstrip("/") + "/.git", False
    if store.is_file("HEAD") and store.is_dir("objects"):
        return path, True
    raise NotAGitRepo(path)


def repositories(paths: str) -> list[str]:
    """The paths of an option, folders with /* replaced by the repositories in them."""
    out = []
    for path in (p.strip() for p in paths.split(",") if p.strip()):
        if path.endswith("/*"):
            out += [f"{path[:-2]}/{name}" for name in Store(path[:-2]).names("")]
        else:
            out.append(path)
    return out


def packs(store: Store) -> list[str]:
    """Names of packs that have both files, without extension."""
    names = store.names("objects/pack")
    have = set(names)
    return [n[:-4] for n in names if n.endswith(".idx") and n[:-4] + ".pack" in have]


class Pack:
    """An open pack: its index, the pieces of it that were read, and the objects inflated so far."""

    def __init__(self, store: Store, name: str, limits: dict[str, int], verify: bool):
        self.index = codec.PackIndex(store.read(f"objects/pack/{name}.idx", limits["pack_file_max"]))
        self.data = Pieces(store, f"objects/pack/{name}.pack", limits["pack_file_max"])
        if len(self.data) < 32 or self.data[0:8] != b"PACK\0\0\0\2":
            raise MalformedObject("pack magic or version")
        if self.index.pack_sha != self.data[len(self.data) - 20 : len(self.data)]:
            raise CorruptedObject("index of another pack")
        if verify:
            self.verify()
        self.limits = limits
        self.known: dict[int, tuple[str, bytes, int]] = {}
        self.held = 0

    def verify(self) -> None:
        sha, left = hashlib.sha1(), len(self.data) - 20
        for piece in self.data.all():
            sha.update(memoryview(piece)[: max(0, left)])
            left -= len(piece)
        if sha.digest() != self.index.pack_sha:
            raise CorruptedObject("pack trailer")

    def entry(self, offset: int) -> tuple:
        return codec.read_entry(self.data, offset, self.limits["pack_object_max"])

    def resolve(self, offset: int, outside, used: int = 0) -> tuple[str, bytes, int] | None:
        found = codec.resolve_chain(offset, self.entry, outside, self.limits["delta_depth_max"], self.known, self.index.find, used)
        if found is not None and len(found[1]) < KEPT // 8:
            if self.held > KEPT:
                self.known.clear()
                self.held = 0
            self.known[offset] = found
            self.held += len(found[1])
        return found


class Part(InputPartition):
    def __init__(self, repo: str, kind: str, name: str, start: int = 0, stop: int = 0):
        super().__init__((repo, kind, name, start, stop))
        self.repo, self.kind, self.name, self.start, self.stop = repo, kind, name, start, stop


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repos = repositories(options.get("path", ""))
        if not options.get("path", "").strip():
            raise InvalidPath("option path")
        self.folders = {p: git_dir(p)[0] for p in self.repos}
        self.table, self.check = options.get("table", "objects"), options.get("verify", "trailer")
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.limits = {k: int(options.get(k, v)) for k, v in schemas.LIMITS.items()}
        self.oids: set[str] | None = None
        self.types: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("oid",) and self.table == "objects":
                self.oids = values if self.oids is None else self.oids & values
            elif values is not None and f.attribute == ("type",) and self.table == "objects":
                self.types = values if self.types is None else self.types & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for repo, folder in self.folders.items():
            if self.table == "refs":
                out.append(Part(repo, "refs", ""))
                continue
            store = Store(folder)
            if self.table == "objects":
                out += [Part(repo, "loose", "", i, i + 256 // LOOSE) for i in range(0, 256, 256 // LOOSE) if self.oids is None or any(o and i <= int(o[:2], 16) < i + 256 // LOOSE for o in self.oids)]
            for name in packs(store):
                try:
                    n = codec.index_count(store.read(f"objects/pack/{name}.idx", first=8 + 1024))
                except RepoError:
                    n = 1  # the task that reads it reports what is wrong
                out += [Part(repo, "pack", name, a, min(a + RANGE, n)) for a in range(0, n, RANGE)]
        return out or [Part("", "none", "")]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.kind == "none":
            return
        store = Store(self.folders[part.repo])
        if part.kind == "refs":
            yield from self._refs(part.repo, store)
        elif part.kind == "loose":
            yield from self._loose(part, store)
        else:
            try:
                pack = Pack(store, part.name, self.limits, self.check != "none" and part.start == 0)
            except (RepoError, OSError) as e:
                if not self.permissive:
                    raise
                if part.start == 0 and self.oids is None and self.types is None:
                    yield self._bad(part.repo, part.name, e)
                return
            yield from self._packed(part, store, pack)

    def _loose(self, part: Part, store: Store) -> Iterator[tuple]:
        limit = self.limits["loose_object_max"]
        for first in (f"{i:02x}" for i in range(part.start, part.stop)):
            if self.oids is not None and not any(o and o.startswith(first) for o in self.oids):
                continue
            for name in store.names(f"objects/{first}"):
                oid = first + name
                if len(name) == 38 and (self.oids is None or oid in self.oids):
                    yield from self._kept(part.repo, oid, "loose", lambda oid=oid, name=name, first=first: codec.read_loose(store.read(f"objects/{first}/{name}", limit), oid, limit))

    def _packed(self, part: Part, store: Store, pack: Pack) -> Iterator[tuple]:
        chosen = pack.index.in_pack_order(part.start, part.stop)
        error = (None,) if self.permissive else ()
        if self.table == "pack_index":
            yield from ((part.repo, part.name, oid, offset, *error) for offset, oid in chosen)
            return
        if self.table == "pack_entries":
            for offset, oid in chosen:
                try:
                    yield part.repo, part.name, offset, oid, *pack.entry(offset), *error
                except RepoError as e:
                    if not self.permissive:
                        raise
                    yield part.repo, part.name, offset, oid, None, None, None, None, None, e.code
            return
        others: dict[str, Pack] = {}

        def outside(oid: str, used: int) -> tuple[str, bytes, int]:
            """A base that another pack or a loose file holds."""
            for name in packs(store):
                other = pack if name == part.name else others[name] if name in others else others.setdefault(name, Pack(store, name, self.limits, False))
                if (offset := other.index.find(oid)) is not None:
                    return other.resolve(offset, outside, used)
            limit = self.limits["loose_object_max"]
            return *codec.read_loose(store.read(f"objects/{oid[:2]}/{oid[2:]}", limit), oid, limit), 0

        for offset, oid in chosen:
            if self.oids is None or oid in self.oids:
                yield from self._kept(part.repo, oid, "pack", lambda offset=offset, oid=oid: self._checked(oid, pack.resolve(offset, outside)[:2]))

    def _checked(self, oid: str, found: tuple[str, bytes]) -> tuple[str, bytes]:
        if self.check == "full" and codec.object_id(*found) != oid:
            raise CorruptedObject(oid)
        return found

    def _bad(self, repo: str, name: str, e: Exception) -> tuple:
        """The row of a pack that cannot be opened: no object, only the error."""
        code = e.code if isinstance(e, RepoError) else "IoFailed"
        if self.table == "objects":
            return repo, None, None, None, None, "pack", code
        width = {"pack_entries": 6, "pack_index": 1}[self.table]
        return repo, name, None, None, *[None] * (width - 1), code

    def _kept(self, repo: str, oid: str, storage: str, read) -> Iterator[tuple]:
        error = (None,) if self.permissive else ()
        try:
            kind, content = read()
        except (RepoError, OSError) as e:
            if not self.permissive:
                raise
            if self.types is None:
                yield repo, oid, None, None, None, storage, e.code if isinstance(e, RepoError) else "IoFailed"
            return
        if self.types is None or kind in self.types:
            yield (repo, oid, kind, len(content), content, storage, *error)

    def _refs(self, repo: str, store: Store) -> Iterator[tuple]:
        found = []
        for name in [*(["HEAD"] if store.is_file("HEAD") else []), *store.below("refs")]:
            text = store.read(name).decode("utf-8", "surrogateescape").rstrip(" \t\r\n")
            if text.startswith("ref: ") and text[5:]:
                found.append((name, None, text[5:], "loose", None))
            else:
                good = len(text) == 40 and all(c in "0123456789abcdefABCDEF" for c in text)
                found.append((name, text.lower() if good else None, None, "loose", None if good else "MalformedRef"))
        if store.is_file("packed-refs"):
            for line in store.read("packed-refs").decode("utf-8", "surrogateescape").split("\n"):
                if line and line[0] not in "#^":
                    oid, _, name = line.partition(" ")
                    good = len(oid) == 40 and all(c in "0123456789abcdefABCDEF" for c in oid) and bool(name)
                    found.append((name, oid.lower() if good else None, None, "packed", None if good else "MalformedRef"))
        for name, oid, target, source, error in found:
            if error and not self.permissive:
                raise MalformedRef(name)
            yield (repo, name, oid, target, source, *([error] if self.permissive else []))


class GitRepo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitrepo"

    def schema(self) -> str:
        base = {"objects": schemas.OBJECTS, "pack_entries": schemas.PACK_ENTRIES, "pack_index": schemas.PACK_INDEX, "refs": schemas.REFS}[self.options.get("table", "objects")]
        return base + (", error string" if self.options.get("mode", "").upper() == "PERMISSIVE" else "")

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session; a reader that takes filters over needs the setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitRepo)
