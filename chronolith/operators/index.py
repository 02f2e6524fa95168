"""Changed-path index: per commit the paths that differ from its first parent, exactly and as a Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith import schemas
from chronolith.errors import LimitExceeded, NotFound
from chronolith.functions import codec
from chronolith.operators.refs import ref_tips, tips_digest
from chronolith.operators.treediff import changed_paths, diff_steps
from chronolith.workspace import Workspace

PARENTS_MAX = 255


def bloom_bits(n: Column) -> Column:
    """Bits of a filter of n members, whole bytes."""
    bits = F.ceil(n * F.lit(4.605170185988091 / 0.6931471805599453**2))
    return (F.when(n == 0, F.lit(0)).otherwise(F.floor((bits + 7) / 8) * 8)).cast("long")


@F.arrow_udf(T.BinaryType())
def bloom_of(members: pa.Array) -> pa.Array:
    """Filter of an array of strings; empty for an empty or null one."""
    return pa.array([codec.bloom_build(m or []) for m in members.to_pylist()], pa.binary())


@F.arrow_udf(T.BooleanType())
def bloom_might_contain(bloom: pa.Array, member: pa.Array) -> pa.Array:
    """False only for what surely is no member."""
    return pa.array([codec.bloom_might_contain(b, m) for b, m in zip(bloom.to_pylist(), member.to_pylist(), strict=True)], pa.bool_())


def build_index(commits: DataFrame, tree_entries: DataFrame, refs: DataFrame, reached: DataFrame | None = None, work: Workspace | None = None) -> DataFrame:
    """commit_index of all commits (or those reached from the tips). Roots have no changed paths.

    A parent that is missing is NotFound, more than PARENTS_MAX parents LimitExceeded.
    """
    work = work or Workspace(commits.sparkSession, "index")
    own = commits if reached is None else commits.join(reached.select("repo_id", "oid"), ["repo_id", "oid"], "left_semi")
    columns = ["repo_id", "oid", "tree", "committer_time", "parents"]
    # one join finds the first parents' trees and which parents are missing
    edges = own.select(*columns, F.posexplode_outer("parents").alias("place", "parent"))
    edges = edges.join(commits.selectExpr("repo_id", "oid parent", "tree old_tree", "true _there"), ["repo_id", "parent"], "left")
    steps = edges.select(*columns, "old_tree", F.coalesce("place", F.lit(0)).alias("place"), (F.col("parent").isNotNull() & F.col("_there").isNull()).alias("missing"), F.monotonically_increasing_id().alias("pair"))
    steps = work.write("steps", steps)
    found = steps.agg(F.max("missing").alias("missing"), F.max(F.size("parents")).alias("most")).first()
    if (found.most or 0) > PARENTS_MAX:
        raise LimitExceeded("parents")
    if found.missing:
        raise NotFound("a parent")
    first = steps.filter("place = 0")
    changes = diff_steps(tree_entries, first.filter("size(parents) > 0").selectExpr("pair", "repo_id", "old_tree", "tree new_tree"), work)
    digests = tips_digest(ref_tips(refs)).selectExpr("repo_id", "digest ref_tips_digest")
    out = first.join(changed_paths(changes, ("pair",)), "pair", "left").join(digests, "repo_id", "left")
    listed = F.coalesce("paths", F.array().cast("array<string>"))
    return out.select("repo_id", "oid", "tree", "committer_time", "parents", listed.alias("changed_paths"), bloom_of(listed).alias("bloom"), "ref_tips_digest")


def write_index(index: DataFrame, path: str, files: int | None = None) -> None:
    """Writes the index, ranges of ids to a file each so that readers can skip by id.

    Ids are hashes, so their leading digits deal them out evenly, without a sample. Filters are made after that.
    """
    n = files or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("oid", 1, 6), 16, 10).cast("long") * n / F.lit(1 << 24)).cast("int")
    dealt = index.drop("bloom").repartitionById(n, F.coalesce(place, F.lit(0))).sortWithinPartitions("oid", "repo_id")
    dealt.withColumn("bloom", bloom_of("changed_paths")).select(index.columns).write.mode("overwrite").parquet(path)


def pack_index(index: DataFrame, limit: int = schemas.LIMITS["index_file_max"]) -> DataFrame:
    """commit_index -> (repo_id, data): the index of each repository as one binary file, records in the order of ids.

    A file is one value, so a repository's records meet in one task; more than `limit` bytes are LimitExceeded.
    """

    def each(key: tuple, rows: pa.Table) -> pa.Table:
        data = codec.write_index([(r["oid"], r["tree"], r["committer_time"], r["parents"], r["bloom"]) for r in rows.to_pylist()], rows.column("ref_tips_digest")[0].as_py() or "")
        if len(data) >= limit:
            raise LimitExceeded("index file")
        return pa.table({"repo_id": pa.array([key[0].as_py()], pa.string()), "data": pa.array([data], pa.binary())})

    return index.select("repo_id", "oid", "tree", "committer_time", "parents", "bloom", "ref_tips_digest").groupBy("repo_id").applyInArrow(each, "repo_id string, data binary")


def unpack_index(files: DataFrame) -> DataFrame:
    """(repo_id, data) -> records (repo_id, oid, tree, committer_time, parents, bloom, ref_tips_digest) of binary index files."""
    record = pa.struct([("oid", pa.string()), ("tree", pa.string()), ("committer_time", pa.int64()), ("parents", pa.list_(pa.string())), ("bloom", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                digest, records = codec.read_index(data.as_py())
                for a in range(0, len(records), 10_000):
                    part = [dict(zip(("oid", "tree", "committer_time", "parents", "bloom"), r, strict=True)) for r in records[a : a + 10_000]]
                    made = pa.array(part, record)
                    yield pa.RecordBatch.from_arrays([pa.array([repo] * len(part), pa.string()), *made.flatten(), pa.array([digest] * len(part), pa.string())], names=["repo_id", *[f.name for f in record], "ref_tips_digest"])

    return files.select("repo_id", "data").mapInArrow(each, "repo_id string, oid string, tree string, committer_time long, parents array<string>, bloom binary, ref_tips_digest string")


def open_index(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """The rows of repositories whose tips are still those that the index was made for; others must be built again."""
    now = tips_digest(ref_tips(refs)).selectExpr("repo_id", "digest ref_tips_digest")
    return spark.read.parquet(path).join(now, ["repo_id", "ref_tips_digest"], "left_semi")


def might_contain(asked: DataFrame, index: DataFrame, exact: bool = True) -> DataFrame:
    """(repo_id, oid, path) -> with might_contain: by the exact paths, or by the filter; true for unknown commits."""
    rows = asked.join(index.select("repo_id", "oid", "changed_paths", "bloom"), ["repo_id", "oid"], "left")
    flag = F.array_contains("changed_paths", F.col("path")) if exact else F.when(F.col("changed_paths").isNotNull(), bloom_might_contain("bloom", "path"))
    return rows.select("repo_id", "oid", "path", F.coalesce(flag, F.lit(True)).alias("might_contain"))


def touching(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo_id, path) -> (repo_id, path, oid): the commits that change the wanted paths."""
    return index.select("repo_id", "oid", F.explode("changed_paths").alias("path")).join(wanted.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
