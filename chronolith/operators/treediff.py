"""File-level differences of two trees.

Paths on one side alone are added or deleted; on both sides with the same mode but another id, modified; with another
mode, deleted and added. Directories are never reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.errors import NotFound
from chronolith.operators.trees import EMPTY_TREE
from chronolith.workspace import Workspace


def _changes(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, path, old_mode, old_oid, new_mode, new_oid) -> one row per change."""
    none = F.lit(None).cast("string")
    row = lambda kind, old, new: F.struct(F.lit(kind).alias("kind"), old.alias("old_oid"), new.alias("new_oid"))
    old, new = F.col("old_oid"), F.col("new_oid")
    kinds = (
        F.when(F.col("old_mode").isNull(), F.array(row("added", none, new)))
        .when(F.col("new_mode").isNull(), F.array(row("deleted", old, none)))
        .when(F.col("old_mode") != F.col("new_mode"), F.array(row("deleted", old, none), row("added", none, new)))
        .otherwise(F.array(row("modified", old, new)))
    )
    differing = joined.filter(~(F.col("old_mode").eqNullSafe(F.col("new_mode")) & old.eqNullSafe(new)))
    return differing.select(*keys, "path", F.explode(kinds).alias("c")).select(*keys, "c.kind", "path", "c.old_oid", "c.new_oid")


def diff_files(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Two file sets (keys, path, mode, oid) -> file_changes: one full outer join on the path."""
    side = lambda files, name: files.filter("mode <> 'directory'").select(*keys, "path", F.col("mode").alias(f"{name}_mode"), F.col("oid").alias(f"{name}_oid"))
    return _changes(side(old, "old").join(side(new, "new"), [*keys, "path"], "full_outer"), list(keys))


def listings(entries: DataFrame) -> DataFrame:
    """tree_entries -> (repo_id, at, listed): a tree as one row, as it is one object; an entry is its mode, id and name, parted by NUL, which no name has."""
    return entries.groupBy("repo_id", F.col("tree_oid").alias("at")).agg(F.collect_list(F.concat_ws("\0", "mode", "oid", "name")).alias("listed"))


def diff_steps(entries: DataFrame, steps: DataFrame, work: Workspace, mode: str = "FAILFAST") -> DataFrame:
    """(pair, repo_id, old_tree?, new_tree?), pair a number of its own for each row -> (pair, kind, path, old_oid, new_oid).

    A level takes two joins with the trees and one grouping of what differs: entries equal on both sides are struck
    out where the two listings meet, before anything is exploded.
    """
    trees = work.write("trees", listings(entries))
    front = steps.filter("not (old_tree <=> new_tree)").selectExpr("pair", "repo_id", "'' prefix", "old_tree old_at", "new_tree new_at")
    out, n = None, 0
    side = lambda name: trees.selectExpr("repo_id", f"at {name}_at", f"listed {name}")
    one = lambda name, other: F.transform(F.array_except(name, other), lambda x: F.struct(F.lit(name == "old").alias("is_old"), x.alias("x")))
    none = F.array().cast("array<string>")
    empty = lambda name: F.when(F.col(name).isNotNull(), F.col(name)).when(F.col(f"{name}_at").isNull() | (F.col(f"{name}_at") == EMPTY_TREE), none)
    while True:
        met = front.join(side("old"), ["repo_id", "old_at"], "left").join(side("new"), ["repo_id", "new_at"], "left")
        met = met.select("pair", "repo_id", "prefix", "old_at", "new_at", empty("old").alias("old"), empty("new").alias("new"))
        # a side that is null now is a missing tree: a row without a name, whose id takes the entry's place
        lost = F.filter(F.array(*[F.when(F.col(x).isNull(), F.struct(F.lit(x == "old").alias("is_old"), F.concat(F.lit("-\0"), F.col(f"{x}_at")).alias("x"))) for x in ("old", "new")]), lambda x: x.isNotNull())
        met = met.withColumn("lost", lost).withColumn("old", F.coalesce("old", none)).withColumn("new", F.coalesce("new", none))
        rows = met.select("pair", "repo_id", "prefix", F.explode(F.concat(one("old", "new"), one("new", "old"), "lost")).alias("e"))
        part = F.split("e.x", "\0", 3)
        rows = rows.select("pair", "repo_id", "prefix", "e.is_old", F.get(part, F.lit(0)).alias("mode"), F.get(part, F.lit(1)).alias("oid"), F.get(part, F.lit(2)).alias("name"))
        of = lambda old, c: F.max(F.when(F.col("is_old") == old, F.col(c)))
        level = rows.groupBy("pair", "repo_id", "prefix", "name", (F.col("mode") == "directory").alias("is_dir")).agg(of(True, "mode").alias("old_mode"), of(True, "oid").alias("old_oid"), of(False, "mode").alias("new_mode"), of(False, "oid").alias("new_oid"))
        level = work.write(f"l{n}", level.withColumn("path", F.coalesce(F.concat("prefix", "name"), F.rtrim("prefix", F.lit("/")))))
        seen = level.select(F.max(F.col("name").isNull()).alias("missing"), F.max("is_dir").alias("deeper")).first()
        if seen.missing and mode != "PERMISSIVE":
            raise NotFound("a tree")
        leaves = _changes(level.filter("name is not null and not is_dir"), ["pair"])
        if seen.missing:
            leaves = leaves.union(level.filter("name is null").selectExpr("pair", "'error' kind", "path", "old_oid", "new_oid"))
        out = leaves if out is None else out.union(leaves)
        if not seen.deeper:
            return out
        front = level.filter("is_dir").selectExpr("pair", "repo_id", "concat(path, '/') prefix", "old_oid old_at", "new_oid new_at")
        n += 1


def diff_trees(entries: DataFrame, pairs: DataFrame, work: Workspace | None = None, mode: str = "FAILFAST") -> DataFrame:
    """(repo_id, old_tree?, new_tree?) -> those with kind, path, old_oid, new_oid; a null side is an empty tree.

    Level by level: entries equal on both sides are dropped before anything below them is read, so the work goes with
    what differs and not with the trees. A tree without entries that is not the empty one is missing: FAILFAST raises
    NotFound, PERMISSIVE gives a row of kind `error` with the folder's path and the missing id as its old or new one.
    """
    work = work or Workspace(entries.sparkSession, "treediff")
    # a number stands for each pair, so that rows which are shuffled stay short
    numbered = work.write("pairs", pairs.select("repo_id", "old_tree", "new_tree").distinct().withColumn("pair", F.monotonically_increasing_id()))
    return diff_steps(entries, numbered, work, mode).join(numbered, "pair").select("repo_id", "old_tree", "new_tree", "kind", "path", "old_oid", "new_oid")


def changed_paths(changes: DataFrame, keys: tuple[str, ...] = ("repo_id", "oid")) -> DataFrame:
    """file_changes per commit -> (keys, paths): the sorted distinct paths. One commit's paths meet in one row."""
    return changes.groupBy(*keys).agg(F.array_sort(F.collect_set("path")).alias("paths"))
