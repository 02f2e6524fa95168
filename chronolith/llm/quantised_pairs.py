"""Near-duplicate embeddings by int8 tile products with per-vector error bounds.

Vectors are compared by cosine within equal labels. A unit vector u is kept as integers q of at most 127 and a scale s;
e = u - s q is known, and so are the norms of s q and e. For two vectors the product of their integers, exact in a
float matrix product as it stays below 2^24, gives the cosine up to |s q||e'| + |e||s' q'| + |e||e'| plus a slack for
rounding. Pairs surely above the threshold are links, pairs surely below are not, and only those between are computed
again from the full vectors in double precision.

Equal vectors of a label are one class (their cosine is 1), which has a number of its own and carries its size and
smallest vec_id. Classes of a label are dealt to tiles of about TILE by hash, and each pair of tiles is multiplied in one task, so
a label with a third of all rows spreads over many. A tile pair returns, per class, how many vectors it links to, and a
spanning forest of its links, never all pairs; components are found from the forests.

A vector that is null or zero or holds null or non-finite components, or whose label is null, links with nothing and is
its own component. Vectors of different lengths are not linked. Repeated vec_ids each get a row (rows that link with
one another count as links, whatever their ids, and a row's links do not pass to other rows of its id); a null vec_id
links with nothing. An empty table gives no rows.

Vectors travel to the tiles as they came (float stays float, four bytes a component) and are quantised there: pairs near
the threshold need the full vectors, and sending those pairs elsewhere could mean all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, FloatType, ShortType

from chronolith.llm.common import Workspace, join_hot, sized, table
from chronolith.llm.components import connected_components

THRESHOLD = 0.93
#: Classes of one side of a product.
TILE = 1024
#: Rows and columns multiplied at once within a task.
BLOCK = 512
#: Room for rounding in float and double sums, far beyond what vectors of a few thousand components can need.
SLACK = 1e-6
#: Integer products up to this many components are exact in float32.
EXACT = 1024

TILE_OUT = "a long, b long, links long"


class Quantised:
    """Unit vectors with their int8 form and error norms."""

    def __init__(self, vectors: np.ndarray):
        full = vectors.astype(np.float64)
        full /= np.abs(full).max(axis=1, keepdims=True)  # neither huge nor tiny components lose their square
        self.norm = np.sqrt(np.einsum("ij,ij->i", full, full))
        self.full = full
        unit = full / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.q * self.scale[:, None]
        self.size = np.sqrt(np.einsum("ij,ij->i", near, near))
        rest = unit - near
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest))

    def product(self, i: slice, other: Quantised, j: slice) -> tuple[np.ndarray, np.ndarray]:
        """Approximate cosines of a tile and the bound on what they are off."""
        dot = np.zeros((i.stop - i.start, j.stop - j.start))
        for a in range(0, self.q.shape[1], EXACT):
            dot += self.q[i, a : a + EXACT].astype(np.float32) @ other.q[j, a : a + EXACT].astype(np.float32).T
        cosine = dot * self.scale[i, None] * other.scale[None, j]
        bound = np.outer(self.size[i], other.error[j]) + np.outer(self.error[i], other.size[j] + other.error[j]) + SLACK
        return cosine, bound


def linked(one: Quantised, two: Quantised, threshold: float = THRESHOLD, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in one, in two) of linked pairs, block after block; same: both are one set and pairs come once."""
    for a in range(0, len(one.q), BLOCK):
        i = slice(a, min(a + BLOCK, len(one.q)))
        for b in range(a if same else 0, len(two.q), BLOCK):
            j = slice(b, min(b + BLOCK, len(two.q)))
            cosine, bound = one.product(i, two, j)
            possible = cosine + bound >= threshold
            if same and a == b:
                possible &= np.triu(np.ones(possible.shape, bool), 1)
            x, y = np.nonzero(possible)
            unsure = np.flatnonzero(cosine[x, y] - bound[x, y] < threshold)
            sure = np.ones(len(x), bool)
            for c in range(0, len(unsure), 1 << 16):
                u = unsure[c : c + (1 << 16)]
                p, q = x[u] + a, y[u] + b
                sure[u] = np.einsum("ij,ij->i", one.full[p], two.full[q]) / (one.norm[p] * two.norm[q]) >= threshold
            if sure.any():
                yield x[sure] + a, y[sure] + b


def _tile_pair(key: tuple, table_: pa.Table) -> pa.Table:
    """Links between the classes of one or two tiles: rows (a, b, null) of a forest and (v, null, links)."""
    _, _, i, j = (k.as_py() for k in key)
    v, n, t = (np.asarray(table_.column(c)) for c in ("v", "n", "t"))
    flat = table_.column("embedding").combine_chunks()
    vectors = np.asarray(flat.flatten(), np.float64).reshape(len(v), -1)
    first = np.flatnonzero(t == i)
    second = first if i == j else np.flatnonzero(t == j)
    out_a, out_b, count = [], [], np.zeros(len(v), np.int64)
    if len(first) and len(second):
        one = Quantised(vectors[first])
        two = one if i == j else Quantised(vectors[second])
        label = np.arange(len(v))
        for x, y in linked(one, two, same=i == j):
            p, q = first[x], second[y]
            count += np.bincount(p, n[q], len(v)).astype(np.int64) + np.bincount(q, n[p], len(v)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(p)) + 1
            for c, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
                a, near = int(p[c]), q[c:e]
                while len(near := near[label[near] != label[a]]):  # only links between two trees join the forest
                    out_a.append(int(v[a]))
                    out_b.append(int(v[near[0]]))
                    label[label == label[near[0]]] = label[a]
    some = np.flatnonzero(count)
    return pa.table(
        {
            "a": pa.array([*out_a, *v[some].tolist()], pa.int64()),
            "b": pa.array([*out_b, *[None] * len(some)], pa.int64()),
            "links": pa.array([*[None] * len(out_a), *count[some].tolist()], pa.int64()),
        }
    )


def embedding_links(frame: DataFrame, work: Workspace | None = None, tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    work = work or Workspace(frame.sparkSession, "quantised")
    kind = frame.schema["embedding"].dataType
    of = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, ByteType, ShortType)) else "double"
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{of}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    # adding 0 makes the two zeros one, so that equal vectors are equal bit by bit
    rows = rows.withColumn("embedding", F.expr(f"transform(embedding, x -> x + {of}(0))"))
    fine = f"vec_id is not null and label is not null and coalesce(size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < {of}('Infinity')) and exists(embedding, x -> x <> 0), false)"
    rows = rows.select("vec_id", "label", "embedding", F.expr(fine).alias("fine"))
    good = rows.filter("fine")
    classes = work.write("classes", good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).select("label", F.size("embedding").alias("d"), "embedding", F.monotonically_increasing_id().alias("v"), "first", "n"))
    sizes = work.write("sizes", classes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("m")))
    dealt = classes.join(sizes, ["label", "d"]).withColumn("tiles", F.expr(f"cast(ceil(m / {tile}) as int)"))
    dealt = dealt.withColumn("t", F.expr("cast(pmod(xxhash64(v), tiles) as int)")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    pairs = dealt.selectExpr("label", "d", "least(t, other) i", "greatest(t, other) j", "t", "v", "n", "embedding")
    found = work.write("found", pairs.groupBy("label", "d", "i", "j").applyInArrow(_tile_pair, TILE_OUT))
    links = work.write("links", found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"))
    named = classes.join(counts, "v", "left").selectExpr("label", "embedding", "v", "first", "n - 1 + coalesce(links, 0) n_links")
    if sized(links):
        # classes are linked by their numbers; what a component is called is its smallest vec_id
        met = work.write("met", named.select("v", "first").join(connected_components(links, work), "v", "left").selectExpr("v", "coalesce(component, v) component", "first"))
        least = met.groupBy("component").agg(F.min("first").alias("component_id"))
        of_class = join_hot(met, least, ["component"]).select("v", "component_id")
        named = named.join(of_class, "v").selectExpr("label", "embedding", "n_links", "component_id")
    else:
        named = named.selectExpr("label", "embedding", "n_links", "first component_id")
    # vectors meet their class by a hash first, then by themselves
    key = F.xxhash64("label", "embedding").alias("h")
    named = work.write("named", named.select("*", key))
    for done in ("classes", "sizes", "found", "links", "met", "components-edges"):
        work.drop(done)
    out = join_hot(good.select("vec_id", "label", "embedding", key), named, ["h", "label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not fine").selectExpr("vec_id", "0L n_links", "vec_id component_id")
    return out.union(alone).selectExpr("vec_id", "cast(n_links as long) n_links", "component_id", "coalesce(vec_id = component_id, true) kept")


def op2_quantised_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT a AS v, a AS m FROM links UNION SELECT l.b, r.m FROM reach r JOIN links l ON l.a = r.v),
comp AS (SELECT v, min(m) AS c FROM reach GROUP BY v),
deg AS (SELECT a AS v, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON comp.v = vec_id LEFT JOIN deg ON deg.v = vec_id
"""

QUERIES = {"op2_quantised_pairs": op2_quantised_pairs}
ORACLES = {"op2_quantised_pairs": SQL}
