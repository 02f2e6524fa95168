"""Trees: entries of tree objects, walks, path lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolith import schemas
from chronolith.errors import LimitExceeded, NotFound
from chronolith.functions import codec
from chronolith.workspace import Workspace

ENTRY = pa.list_(pa.struct([("mode", pa.string()), ("name", pa.string()), ("oid", pa.string())]))


def tree_entries(objects: DataFrame, strict: bool = True, encoding: str = "utf-8") -> DataFrame:
    """tree objects -> tree_entries. strict: a malformed entry fails; else it and the rest of its tree are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[dict(zip(("mode", "name", "oid"), e, strict=True)) for e in codec.parse_tree(c, strict, encoding)] for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, ENTRY)], names=["repo_id", "tree_oid", "entries"])

    parsed = objects.filter("type = 'tree'").select("repo_id", "oid", "content").mapInArrow(each, "repo_id string, tree_oid string, entries array<struct<mode:string,name:string,oid:string>>")
    return parsed.select("repo_id", "tree_oid", F.posexplode("entries").alias("ordinal", "e")).select("repo_id", "tree_oid", "ordinal", "e.mode", "e.name", "e.oid")


#: Fixed value of the object format: the id of a tree without entries, which no entry names.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def walk_trees(entries: DataFrame, roots: DataFrame, depth_max: int = schemas.LIMITS["tree_depth_max"], work: Workspace | None = None, mode: str = "FAILFAST") -> DataFrame:
    """(repo_id, root_tree) -> tree_files: every entry below the roots, directories included, one join a level.

    A tree without entries that is not the empty one is missing: FAILFAST raises NotFound, PERMISSIVE adds an `error`
    column and a row for it, with the folder's path and no mode.
    """
    work = work or Workspace(entries.sparkSession, "walk")
    below = entries.select("repo_id", F.col("tree_oid").alias("at"), "mode", "name", "oid")
    front = roots.select("repo_id", "root_tree").distinct().selectExpr("repo_id", "root_tree", "'' prefix", "root_tree at")
    levels, n = [], 0
    while True:
        if n > depth_max:
            raise LimitExceeded("tree depth")
        level = front.join(below, ["repo_id", "at"], "left").filter(F.col("name").isNotNull() | (F.col("at") != EMPTY_TREE))
        path = F.coalesce(F.concat("prefix", "name"), F.rtrim("prefix", F.lit("/")))
        level = work.write(f"l{n}", level.select("repo_id", "root_tree", path.alias("path"), F.lit(n).alias("depth"), "mode", "oid", F.when(F.col("name").isNull(), "NotFound").alias("error")))
        levels.append(level)
        seen = level.select(F.max(F.col("error")).alias("error"), F.max(F.col("mode") == "directory").alias("deeper")).first()
        if seen.error and mode != "PERMISSIVE":
            raise NotFound("a tree")
        if not seen.deeper:
            break
        front = level.filter("mode = 'directory'").selectExpr("repo_id", "root_tree", "concat(path, '/') prefix", "oid at")
        n += 1
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out if mode == "PERMISSIVE" else out.drop("error")


def in_walk_order(files: DataFrame) -> DataFrame:
    """tree_files with `rank`, from 0: each directory before what is in it, names in the object format's order."""
    key = F.concat("path", F.when(F.col("mode") == "directory", "/").otherwise(""))
    return files.withColumn("rank", F.row_number().over(W.partitionBy("repo_id", "root_tree").orderBy(key)) - 1)


def list_tree(entries: DataFrame, trees: DataFrame) -> DataFrame:
    """Entries of single trees (repo_id, tree_oid), nothing below them."""
    return entries.join(trees.select("repo_id", "tree_oid").distinct(), ["repo_id", "tree_oid"], "left_semi")


def find_paths(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo_id, root_tree, path) -> with oid and mode, null where there is no such file; directories are no files.

    A join for each component of the longest path; only trees on the way are touched.
    """
    named = entries.select("repo_id", F.col("tree_oid").alias("at"), F.col("name").alias("_name"), F.col("mode").alias("_mode"), F.col("oid").alias("_oid"))
    at = wanted.select("repo_id", "root_tree", "path").distinct().withColumn("parts", F.split("path", "/", -1)).withColumn("at", F.col("root_tree")).withColumn("oid", F.lit(None).cast("string")).withColumn("mode", F.lit(None).cast("string"))
    most = at.select(F.max(F.size("parts"))).first()[0] or 0
    for i in range(most):
        last = F.size("parts") == i + 1
        at = at.withColumn("_name", F.get("parts", F.lit(i))).join(named, ["repo_id", "at", "_name"], "left")
        at = at.select(
            "repo_id",
            "root_tree",
            "path",
            "parts",
            F.when(~last & (F.col("_mode") == "directory"), F.col("_oid")).alias("at"),
            F.when(last & (F.col("_mode") != "directory"), F.col("_oid")).otherwise(F.col("oid")).alias("oid"),
            F.when(last & (F.col("_mode") != "directory"), F.col("_mode")).otherwise(F.col("mode")).alias("mode"),
        )
    return at.select("repo_id", "root_tree", "path", "oid", "mode")
