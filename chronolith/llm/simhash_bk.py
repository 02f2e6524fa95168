"""Near-duplicates by SimHash fingerprints and BK-trees.

1. Fingerprints: one Arrow pass; XXH64 of every 4-word shingle, a bit set where over half the hashes have it.
2. Equal fingerprints are one vertex (the smallest doc_id), found with a minimum per fingerprint.
3. Shards: fingerprints within radius 4 that are cut into m blocks share at least m - 4 of them whole. Each choice of
   m - 4 blocks with their bits names a shard; every vertex enters one shard per choice, so that each link lies in
   at least one shard. m rises with the number of fingerprints (m = 6, 7 or 8) to keep shards small; each m is exact.
4. BK-trees: within a shard a tree is built, children keyed by their distance to the parent, and searched along the
   edges within the radius only. A shard beyond TILE fingerprints is cut into tiles, and the tree of a tile goes, with
   each other tile, to a task of its own: trees reach the queries through the shuffle, as all trees together
   grow with the corpus and could not be broadcast within a bound. A tile's links leave it as a spanning forest.
5. Components over the forests' links (components.py); every document gets its fingerprint's component.

No fingerprint or link comes to the driver. Texts without words have fingerprint zero and are linked like others, null
texts too. Repeated rows each get a row; rows with a null doc_id get a fingerprint and, if a document with an id has
the same one, its component. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import Workspace, join_hot, sized, table
from chronolith.llm.components import connected_components

RADIUS = 4
WORDS = 4
SEED = 42
#: Fingerprints of one shard that meet in one task at most (twice that, for two tiles).
TILE = 512
#: Mean fingerprints a shard, beyond which one more block is cut.
CROWDED = 8


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one whole text."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    line, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    if n == 1:
        return int(hashes[0])
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 256:
        set_bits = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        set_bits = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


class BKTree:
    """A BK-tree over 64-bit fingerprints under Hamming distance; equal fingerprints share a node."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of the value."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while d := (self.values[at] ^ value).bit_count():
            if (below := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below
        return at

    def search(self, value: int, radius: int = RADIUS) -> list[int]:
        """Nodes within the radius."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            open_ += [below for k, below in self.children[at].items() if d - radius <= k <= d + radius]
        return found

    def search_all(self, values: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the values within the radius), all values descending together."""
        open_ = [(0, np.arange(len(values)))] if self.values else []
        while open_:
            at, who = open_.pop()
            d = np.bitwise_count(values[who] ^ np.uint64(self.values[at])).astype(np.int16)
            if (near := d <= radius).any():
                yield at, who[near]
            for k, below in self.children[at].items():
                if (along := np.abs(d - k) <= radius).any():
                    open_.append((below, who[along]))


def forest(values: np.ndarray, side: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (positions) that connect what the links within the radius connect.

    side: None for links among all the values, else booleans: only links between the two sides.
    """
    n = len(values)
    if side is not None:
        first, second = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(first) or not len(second):
            return []
    else:
        first = second = np.arange(n)
    tree, at = BKTree(), []
    for v in values[first].tolist():
        at.append(tree.add(v))
    holder = dict(zip(at, first.tolist(), strict=True))
    label, links = np.arange(n), []
    asked = values[second]
    hits = tree.search_all(asked, radius) if len(second) > 24 else ((node, np.array([j])) for j, v in enumerate(asked.tolist()) for node in tree.search(v, radius))
    for node, who in hits:
        root, near = holder[node], second[who]
        while len(new := near[label[near] != label[root]]):
            links.append((root, int(new[0])))
            label[label == label[new[0]]] = label[root]
    return links


def block_widths(m: int) -> list[tuple[int, int]]:
    """(shift, bits) of m blocks of 64 bits."""
    size, more = divmod(64, m)
    out, at = [], 0
    for i in range(m):
        out.append((at, size + (i < more)))
        at += out[-1][1]
    return out


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The least number of blocks (radius + 2 to radius + 4) with few fingerprints a shard."""
    for m in (radius + 2, radius + 3):
        if n <= CROWDED << sum(sorted(w for _, w in block_widths(m))[: m - radius]):
            return m
    return radius + 4


def shards(fps: DataFrame, m: int, radius: int = RADIUS) -> DataFrame:
    """(k, key, fp, v): one row for each choice k of m - radius blocks, key holding their bits."""
    widths, keys = block_widths(m), []
    for k, chosen in enumerate(combinations(range(m), m - radius)):
        mask = sum(((1 << widths[b][1]) - 1) << widths[b][0] for b in chosen)
        keys.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return fps.select(F.explode(F.array(*keys)).alias("x"), "fp", "v").select("x.k", "x.key", "fp", "v")


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, key, i, j, t, fp, v) sorted by the first four: the forest of each run of equal ones."""

    def done(run: list[np.ndarray], i: int, j: int) -> list[tuple[int, int]]:
        t, fp, v = (np.concatenate([r[c] for r in run]) for c in range(3))
        return [(int(v[a]), int(v[b])) for a, b in forest(fp, None if i == j else t == i)] if len(fp) > 1 else []

    held: list = []
    last = None
    for batch in batches:
        k, key, i, j, t, fp, v = (np.asarray(c) for c in batch.columns)
        if not len(k):
            continue
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out: list[tuple[int, int]] = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
            now = (k[a], key[a], i[a], j[a])
            if last is not None and now != last:
                out += done(held, last[2], last[3])
                held = []
            last = now
            held.append((t[a:b], fp[a:b], v[a:b]))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
    if held:
        out = done(held, last[2], last[3])
        yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer. row: a long column of docs that goes along."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    along = [f"`{row}`"] if row else []
    return docs.selectExpr("cast(doc_id as long) doc_id", "text", *along).mapInArrow(each, ", ".join(["doc_id long, fp long", *[f"{c} long" for c in along]]))


def links_within(fps: DataFrame, work: Workspace, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between vertices v of (fp, v) that connect all that lie within the radius. fps is a written table."""
    spread = shards(fps, blocks_for(fps.count(), radius), radius)
    crowds = work.write("crowds", spread.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = spread.join(crowds, ["k", "key"]).withColumn("tiles", F.expr(f"cast(ceil(n / {tile}) as int)")).withColumn("t", F.expr("cast(pmod(xxhash64(fp), tiles) as int)"))
    dealt = met.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).selectExpr("k", "key", "least(t, other) i", "greatest(t, other) j", "t", "fp", "v")
    # by v within a run, so that shards of the same fingerprints find the same links, of which one of each stays
    found = dealt.repartition("k", "key", "i", "j").sortWithinPartitions("k", "key", "i", "j", "v").mapInArrow(_tiled, "a long, b long")
    return found.selectExpr("least(a, b) a", "greatest(a, b) b").distinct()


def near_duplicates(docs: DataFrame, work: Workspace | None = None, row: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    row: a long column of docs that tells all rows apart; it goes along and stands for doc_id in component_id, so that
    rows with a null doc_id are linked like others.
    """
    work = work or Workspace(docs.sparkSession, "simhash")
    own = row or "doc_id"
    prints = work.write("prints", fingerprints(docs, row))
    vertices = work.write("vertices", prints.filter(F.col(own).isNotNull()).groupBy("fp").agg(F.min(own).alias("v")))
    named = vertices.selectExpr("fp", "v component_id")
    links = work.write("links", links_within(vertices, work)) if sized(vertices) else None
    if links is not None and sized(links):
        found = connected_components(links, work)
        named = work.write("named", vertices.join(found, "v", "left").selectExpr("fp", "coalesce(component, v) component_id"))
        for done in ("vertices", "crowds", "links", "components-edges"):
            work.drop(done)
    return join_hot(prints, named, ["fp"], "left").select("doc_id", *([row] if row else []), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash_bk": op6_simhash_bk}
ORACLES: dict[str, str] = {}
