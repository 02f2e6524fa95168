"""Commit log: what tips reach, longest distances, and the order in which a log shows commits."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolith.workspace import Workspace, sized

REACHED = "repo_id string, oid string, depth int, pops int"


def walk(times: dict[str, int], parents: dict[str, list[str]], tips: list[str]) -> tuple[dict[str, int], list[str]]:
    """Longest distances from the tips, and the order of a walk that always takes the newest commit it has seen.

    Commits that are missing are skipped, tips too. Among equal times the smaller id comes first.
    """
    seen = {t for t in tips if t in times}
    heap = [(-times[t], t) for t in seen]
    heapq.heapify(heap)
    order = []
    while heap:
        _, at = heapq.heappop(heap)
        order.append(at)
        for p in parents[at]:
            if p in times and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (-times[p], p))
    waits = dict.fromkeys(seen, 0)
    for at in seen:
        for p in set(parents[at]):
            if p in seen:
                waits[p] += 1
    depth, ready = dict.fromkeys(seen, 0), [at for at in seen if not waits[at]]
    while ready:
        at = ready.pop()
        for p in set(parents[at]):
            if p in seen:
                depth[p] = max(depth[p], depth[at] + 1)
                waits[p] -= 1
                if not waits[p]:
                    ready.append(p)
    return depth, order


def reachable(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo_id, oid, depth, pops): depth is the longest distance from a tip, pops the place in the newest-first walk.

    One task holds the skeleton (ids, parents, times) of one repository: about 100 bytes a commit. For one repository
    beyond a task's memory use reachable_contracted.
    """

    def each(key: tuple, rows: pa.Table) -> pa.Table:
        repo = key[0].as_py()
        ids, times, lists, tip = (rows.column(c).to_pylist() for c in ("oid", "committer_time", "parents", "is_tip"))
        depth, order = walk(dict(zip(ids, times, strict=True)), dict(zip(ids, [p or [] for p in lists], strict=True)), [i for i, t in zip(ids, tip, strict=True) if t])
        return pa.table({"repo_id": pa.array([repo] * len(order), pa.string()), "oid": pa.array(order, pa.string()), "depth": pa.array([depth[o] for o in order], pa.int32()), "pops": pa.array(range(len(order)), pa.int32())})

    marked = commits.select("repo_id", "oid", "committer_time", "parents").join(tips.select("repo_id", "oid").distinct().withColumn("is_tip", F.lit(True)), ["repo_id", "oid"], "left")
    return marked.groupBy("repo_id").applyInArrow(each, REACHED)


def reachable_by_rounds(commits: DataFrame, tips: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(repo_id, oid): the same set by breadth-first rounds of joins, for repositories of any size; a round per generation."""
    work = work or Workspace(commits.sparkSession, "reachable")
    edges = commits.select("repo_id", "oid", F.explode_outer("parents").alias("parent"))
    front = work.write("f0", tips.select("repo_id", "oid").distinct().join(commits.select("repo_id", "oid"), ["repo_id", "oid"], "left_semi"))
    seen, n = work.write("s0", front), 0
    while sized(front):
        n += 1
        found = front.join(edges, ["repo_id", "oid"]).selectExpr("repo_id", "parent oid").filter("oid is not null").distinct()
        found = found.join(commits.select("repo_id", "oid"), ["repo_id", "oid"], "left_semi")
        front = work.write(f"f{n}", found.join(seen, ["repo_id", "oid"], "left_anti"))
        seen = work.write(f"s{n}", seen.union(front))
        work.drop(f"s{n - 1}")
        work.drop(f"f{n - 1}")
    return seen


def distances(lengths: dict[str, dict[str, int]], tips: list[str]) -> dict[str, int]:
    """Longest distance from the tips of each vertex that they reach, over edges (from, to: length)."""
    seen, ready = set(tips), list(tips)
    while ready:
        for p in lengths.get(ready.pop(), ()):
            if p not in seen:
                seen.add(p)
                ready.append(p)
    waits = dict.fromkeys(seen, 0)
    for at in seen:
        for p in lengths.get(at, ()):
            waits[p] += 1
    far, ready = dict.fromkeys(seen, 0), [at for at in seen if not waits[at]]
    while ready:
        at = ready.pop()
        for p, length in lengths.get(at, {}).items():
            far[p] = max(far[p], far[at] + length)
            waits[p] -= 1
            if not waits[p]:
                ready.append(p)
    return far


def reachable_contracted(commits: DataFrame, tips: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(repo_id, oid, depth) as from `reachable`, for a repository beyond one task's memory.

    Commits with one parent, one child and no tip are inner; pointer doubling (log2 of the longest run, in joins) finds
    each one's nearest descendant that is not, its head, and how far that is. What meets in a task is a repository's
    contracted graph alone: its merges, branch points, tips and ends, about 100 bytes each, however long the runs are.
    """
    work, key = work or Workspace(commits.sparkSession, "contracted"), ["repo_id", "oid"]
    known = commits.select(*key).distinct()
    edges = commits.select(*key, F.explode("parents").alias("parent")).distinct()
    edges = work.write("edges", edges.join(known.selectExpr("repo_id", "oid parent"), ["repo_id", "parent"], "left_semi"))
    asked = tips.select(*key).distinct().withColumn("is_tip", F.lit(True))
    down = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n_down"))
    up = edges.groupBy("repo_id", F.col("parent").alias("oid")).agg(F.count(F.lit(1)).alias("n_up"), F.min("oid").alias("child"))
    nodes = known.join(down, key, "left").join(up, key, "left").join(asked, key, "left")
    inner = F.coalesce((F.col("n_down") == 1) & (F.col("n_up") == 1) & F.col("is_tip").isNull(), F.lit(False))
    nodes = work.write("nodes", nodes.select(*key, "child", inner.alias("inner"), F.coalesce("is_tip", F.lit(False)).alias("is_tip")))
    jump, n = work.write("j0", nodes.filter("inner").selectExpr("repo_id", "oid", "child to", "1L hops", "true open")), 0
    while sized(jump.filter("open")) and n < 64:  # a ring of inner commits, which no tip reaches, would never end
        n += 1
        further = jump.selectExpr("repo_id", "oid to", "to _to", "hops _hops")
        moved = jump.join(further, ["repo_id", "to"], "left").selectExpr("repo_id", "oid", "coalesce(_to, to) to", "hops + coalesce(_hops, 0L) hops", "_to is not null open")
        jump = work.write(f"j{n}", moved)
        work.drop(f"j{n - 1}")
    heads = jump.filter("not open").selectExpr("repo_id", "oid", "to head", "hops")
    ends = nodes.filter("not inner")
    bones = edges.join(ends.selectExpr("repo_id", "oid parent"), ["repo_id", "parent"], "left_semi").join(heads, key, "left")
    bones = bones.selectExpr("repo_id", "coalesce(head, oid) oid", "parent", "coalesce(hops, 0L) + 1 length").groupBy(*key, "parent").agg(F.max("length").alias("length"))
    rows = bones.unionByName(ends.filter("is_tip").select(*key), allowMissingColumns=True)

    def each(group: tuple, rows: pa.Table) -> pa.Table:
        repo, lengths, tip = group[0].as_py(), {}, []
        for oid, parent, length in zip(*(rows.column(c).to_pylist() for c in ("oid", "parent", "length")), strict=True):
            if parent is None:
                tip.append(oid)
            else:
                lengths.setdefault(oid, {})[parent] = length
        far = distances(lengths, tip)
        return pa.table({"repo_id": pa.array([repo] * len(far), pa.string()), "oid": pa.array(list(far), pa.string()), "depth": pa.array(list(far.values()), pa.int64())})

    far = work.write("far", rows.groupBy("repo_id").applyInArrow(each, "repo_id string, oid string, depth long"))
    inside = heads.join(far.selectExpr("repo_id", "oid head", "depth"), ["repo_id", "head"]).selectExpr("repo_id", "oid", "depth + hops depth")
    return far.unionByName(inside).withColumn("depth", F.col("depth").cast("int"))


def ranked_by_ranges(found: DataFrame, order: list, work: Workspace) -> DataFrame:
    """`rank` from 0 within repo_id, without a repository in one task: ranges are ranked alone and follow each other."""
    ranges = work.write("ranges", found.repartitionByRange("repo_id", *order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("repo_id", "_range").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("repo_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("repo_id", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    local = ranges.withColumn("rank", F.row_number().over(W.partitionBy("repo_id", "_range").orderBy(*order)) - 1)
    return local.join(before, ["repo_id", "_range"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_range", "_before")


def log(commits: DataFrame, tips: DataFrame, order: str = "time", offset: int | None = None, limit: int | None = None, spread: bool = False) -> DataFrame:
    """The reachable commits with `rank`, from 0, per repository.

    order='time' sorts by committer time, newest first, then depth and id: no commit precedes a child of its own second.
    order='traversal' is the walk that takes the newest commit seen so far, which differs where a parent is newer than
    its child. offset and limit page through each repository. spread=True is for repositories beyond a task's memory:
    the same rows in time order from the contracted graph and by ranges; the walk is one sequence and has no such form.
    """
    if spread and order == "traversal":
        raise ValueError("a walk in the order of traversal is one sequence; spread works for order='time'")
    by = [F.col("pops")] if order == "traversal" else [F.col("committer_time").desc(), F.col("depth"), F.col("oid")]
    if spread:
        work = Workspace(commits.sparkSession, "log")
        ranked = ranked_by_ranges(commits.join(reachable_contracted(commits, tips, work), ["repo_id", "oid"]), by, work)
    else:
        found = commits.join(reachable(commits, tips), ["repo_id", "oid"])
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy(*by)) - 1).drop("pops")
    if offset is not None:
        ranked = ranked.filter(F.col("rank") >= offset)
    if limit is not None:
        ranked = ranked.filter(F.col("rank") < (offset or 0) + limit)
    return ranked


def page_after(ranked: DataFrame, committer_time: int, depth: int, oid: str, limit: int) -> DataFrame:
    """The next page of a time-ordered log after a row's full sort key."""
    t, d, o = F.col("committer_time"), F.col("depth"), F.col("oid")
    later = (t < committer_time) | ((t == committer_time) & ((d > depth) | ((d == depth) & (o > oid))))
    return ranked.filter(later).orderBy(t.desc(), d, o).limit(limit)


def first_parent_chain(commits: DataFrame, tips: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(repo_id, tip, oid, depth): each tip's chain of first parents, by pointer doubling.

    A round doubles the length that is known, so a chain of n commits takes about log2(n) joins.
    """
    work = work or Workspace(commits.sparkSession, "chain")
    jump = work.write("j0", commits.select("repo_id", "oid", F.get("parents", F.lit(0)).alias("to")).filter("to is not null").join(commits.selectExpr("repo_id", "oid to"), ["repo_id", "to"], "left_semi"))
    chain = work.write("c0", tips.select("repo_id", "oid").distinct().join(commits.select("repo_id", "oid"), ["repo_id", "oid"], "left_semi").selectExpr("repo_id", "oid tip", "oid", "0L depth"))
    step, n = 1, 0
    while True:
        n += 1
        further = work.write(f"x{n}", chain.join(jump, ["repo_id", "oid"]).selectExpr("repo_id", "tip", "to oid", f"depth + {step} depth"))
        if not sized(further):
            return chain
        chain = work.write(f"c{n}", chain.union(further))
        jump = work.write(f"j{n}", jump.join(jump.selectExpr("repo_id", "oid to", "to _far"), ["repo_id", "to"]).selectExpr("repo_id", "oid", "_far to"))
        step *= 2
