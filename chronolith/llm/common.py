"""Tables, the shared work folder and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from chronolith.session import importable
from chronolith.workspace import Workspace, sized


__all__ = ["Workspace", "carried", "first_of_each", "held_out", "held_out_py", "join_hot", "labelled_texts", "resident", "sized", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any file system it knows will do."""
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def held_out_py(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


_RESIDENT: dict = {}


def resident(key: tuple, make):
    """What a Python worker keeps between tasks: one object at a time, that of the stage at hand.

    Workers serve one stage after another; tables, models and caches of the last one go before the next are made.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def carried(frame: DataFrame, names: list[str], *more: StructField) -> StructType:
    """The schema of columns that go along through Arrow and of new ones; as a type, so that any name is right at any depth."""
    return StructType([*(StructField(n, frame.schema[n].dataType, True) for n in names), *more])


#: A key is hot from this share of a table's rows on, so that there are no more hot keys than its inverse.
HOT = 1 / 1000
#: Rows below which no key is looked for: whatever the keys, one task holds them.
FEW = 2_000_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", few: int = FEW) -> DataFrame:
    """left joined with right, which has one row a key at most, without all rows of a hot key meeting in one task.

    left is a written table. Keys with more than HOT of its rows, of which there are fewer than 1 / HOT, find their row of
    right by broadcast of just those rows; all others meet by shuffle.
    """
    n = left.count()
    if n <= few:
        return left.join(right, keys, how)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n * HOT).drop("_n")
    some = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    rest = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    return rest.unionByName(some)


#: Parts that a key is cut into before its first rows meet.
PARTS = 64


def first_of_each(rows: DataFrame, key: str, order: list[str], k: int, parts: int = PARTS) -> DataFrame:
    """The first k rows of each key, with their rank r from 1; order begins with a hash column.

    Each key is cut into parts by the hash and the first k of every part are taken before those meet, so that at most
    parts * k rows of a key reach one task, however many tasks have read it.
    """
    part = F.pmod(F.xxhash64(order[0]), F.lit(parts))
    some = rows.withColumn("_part", part).withColumn("r", F.row_number().over(W.partitionBy(key, "_part").orderBy(*order))).filter(F.col("r") <= k)
    return some.drop("_part", "r").withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("r") <= k)


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, per_class: int, chars: int) -> list[tuple[str, int]]:
    """(text, label) of rows that are not held out, for fitting: a bounded sample whose bounds are parameters.

    Of each class the per_class labels with the least hashes of doc_id are taken, from them the documents of at most
    `chars` characters; of documents with one id that with the least hash of its text. So at most 2 * per_class texts of
    `chars` characters reach the driver, however often an id is repeated. The chosen labels, 2 * per_class rows, are what
    is broadcast. Null labels and ids are left out; an id with both labels counts with both.
    """
    rows = labels.selectExpr("cast(doc_id as long) doc_id", f"cast({column} as int) y").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = [rows.filter(F.col("y") == y).distinct().withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(per_class).select("doc_id", "y") for y in (0, 1)]
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").filter(F.length(F.coalesce("text", F.lit(""))) <= chars)
    met = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    got = met.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "x.text", "y").collect()
    return [(r.text, r.y) for r in sorted(got, key=lambda r: (r.doc_id, r.y, r.text))]
