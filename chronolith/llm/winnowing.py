"""Benchmark decontamination by winnowing, with DataFrame functions alone.

A text is the sequence of its words. Of its K-word hashes, those are kept that are the least in some run of SPAN
neighbours (K + SPAN - 1 = WINDOW words), so every shared run of WINDOW words shares a kept hash. Kept hashes of documents
and items are joined; each hit is extended word by word to both sides, up to WINDOW - K words, and counts when the
equal run is WINDOW words or longer. As every occurring window holds a kept hash, the counted runs cover exactly the
words of all occurring windows. Items of fewer than WINDOW words are one window, joined by the hash of all their words
against all runs of that length.

The item side is broadcast while it has at most BROADCAST_ROWS hashes whose words take at most BROADCAST_BYTES (checked
bounds); beyond them the documents are written with a number for each row, the join shuffles their hashes, without
their words, and comes back to them by that number. Hashes of one document
and item that have the same surroundings in the item are one row, so repeated lines do not multiply.

Null texts have no words; a null doc_id is a document like others, and so are repeated rows and ids: decisions are
by row. Null item ids count as no
item but their windows hit. An empty benchmark hits nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import Workspace, table

WINDOW = 10
K = 5
SPAN = WINDOW - K + 1
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever is neither an ASCII digit or small letter nor beyond ASCII parts words.
PARTS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text after A-Z is lower-cased; an empty array for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), PARTS), lambda w: w != "")


def gram_hashes(w: str, m: int) -> Column:
    """The hash of the m words from each position of array column w; empty if there are fewer."""
    at = ", ".join(f"get({w}, i + {j})" if j else f"get({w}, i)" for j in range(m))
    return F.expr(f"transform(slice(sequence(0, greatest(size({w}) - {m}, 0)), 1, greatest(size({w}) - {m - 1}, 0)), i -> xxhash64({at}))")


def run_minima(h: str) -> Column:
    """The least hash of each SPAN neighbours; shorter arrays give none."""
    least = ", ".join(f"get({h}, i + {j})" if j else f"get({h}, i)" for j in range(SPAN))
    return F.expr(f"transform(slice(sequence(0, greatest(size({h}) - {SPAN}, 0)), 1, greatest(size({h}) - {SPAN - 1}, 0)), i -> least({least}))")


def kept(h: str, low: str) -> Column:
    """(pos, h) of the hashes that are the least of a run."""
    among = " or ".join(f"x = get({low}, i - {j})" if j else f"x = get({low}, i)" for j in range(SPAN))
    pairs = f"transform({h}, (x, i) -> if({among}, struct(i as pos, x as h), null))"
    return F.expr(f"filter({pairs}, x -> x is not null)")


def long_prints(frame: DataFrame, text: str, *columns: str) -> DataFrame:
    """The columns with w (words) and prints (kept hashes). Each step is a projection of its own.

    What is exploded from prints must be exploded with explode_outer: for explode, the optimiser adds a filter on the
    array's size, which it pushes below these projections by writing each into the next, to be computed again per word.
    """
    stepped = frame.select(*columns, words(F.col(text)).alias("w"))
    stepped = stepped.withColumn("hs", gram_hashes("w", K))
    stepped = stepped.withColumn("lows", run_minima("hs"))
    return stepped.withColumn("prints", kept("hs", "lows")).drop("hs", "lows")


def item_prints(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of long items: (h, item, words left of the hash, the K words, words right of it); of short: (m, h, item, words)."""
    side = WINDOW - K
    base = items.selectExpr("cast(item_id as string) item", "text")
    long = long_prints(base, "text", "item").filter(f"size(w) >= {WINDOW}").select("item", "w", F.explode_outer("prints").alias("p"))
    long = long.selectExpr(
        "p.h h",
        "item",
        f"slice(w, greatest(p.pos - {side}, 0) + 1, least(p.pos, {side})) before",
        f"slice(w, p.pos + 1, {K}) gram",
        f"slice(w, p.pos + {K} + 1, {side}) after",
    ).distinct()
    short = base.select("item", words(F.col("text")).alias("w")).filter(f"size(w) between 1 and {WINDOW - 1}").distinct()
    hashed = F.expr("case size(w) " + " ".join(f"when {m} then xxhash64(" + ", ".join(f"get(w, {j})" for j in range(m)) + ")" for m in range(1, WINDOW)) + " end")
    return long, short.select(F.size("w").alias("m"), hashed.alias("h"), "item", F.col("w").alias("gram"))


def contaminated_words(docs: DataFrame, items: DataFrame, work: Workspace | None = None, row: str | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and row, its place in docs).

    row: a long column of docs that tells all rows apart and is given back as row.
    """
    spark, side = docs.sparkSession, WINDOW - K
    work = work or Workspace(spark, "winnow")
    long, short = (work.write(n, d) for n, d in zip(("long", "short"), item_prints(items), strict=True))
    lengths = sorted(r.m for r in short.select("m").distinct().collect())  # nine at most
    item_side = long.selectExpr(f"{WINDOW} m", "h", "item", "before", "gram", "after").union(short.selectExpr("m", "h", "item", "cast(array() as array<string>)", "gram", "cast(array() as array<string>)"))
    held = " + ".join(f"octet_length(array_join({c}, ' '))" for c in ("before", "gram", "after"))
    size = item_side.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr(held)).alias("bytes")).first()
    small = size.rows <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    if not small and row is None:  # the numbers must be the same in both scans
        own = work.write("rows", own)
    read = long_prints(own, "text", "doc_id", "row")
    every = F.transform("prints", lambda p: F.struct(F.lit(WINDOW).alias("m"), p["pos"].alias("pos"), p["h"].alias("h")))
    for n in lengths:
        read = read.withColumn(f"h{n}", gram_hashes("w", n))
        every = F.concat(every, F.expr(f"transform(h{n}, (x, i) -> struct({n} as m, i as pos, x as h))"))
    # position -1 stands for the document itself, which goes along with its hits
    prints = F.concat(F.array(F.struct(F.lit(0).alias("m"), F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("h"))), every)
    read = read.withColumn("all", prints)
    if small:
        met = read.select("doc_id", "row", "w", F.explode_outer("all").alias("p")).select("doc_id", "row", "w", "p.m", "p.pos", "p.h").join(F.broadcast(item_side), ["m", "h"], "left")
        met = met.filter("pos < 0 or item is not null or gram is not null")
    else:
        found = read.select("row", F.explode_outer("all").alias("p")).select("row", "p.m", "p.pos", "p.h").join(item_side, ["m", "h"])
        met = read.select("doc_id", "row", "w").join(found, "row", "left")
        met = met.select("doc_id", "row", "w", "m", "h", "pos", "item", "before", "gram", "after").union(read.selectExpr("doc_id", "row", "w", "0", "null", "-1", "null", "null", "null", "null"))
        met = met.filter("pos is not null")
    size = "size(gram)"
    same = f"pos >= 0 and slice(w, pos + 1, {size}) = gram"
    left = " + ".join(_run("w", "before", f"pos - {j}", f"size(before) - {j}", j) for j in range(1, side + 1))
    right = " + ".join(_run("w", "after", f"pos + {size} + {j - 1}", f"{j - 1}", j, forward=True) for j in range(1, side + 1))
    met = met.selectExpr("doc_id", "row", "pos", "m", "item", "size(w) n", f"{size} g", f"if({same}, {left}, null) l", f"if({same}, {right}, null) r")
    hit = f"pos >= 0 and l is not null and (m < {WINDOW} or g + l + r >= {WINDOW})"
    met = met.selectExpr("doc_id", "row", "if(pos < 0, n, null) n", f"if({hit}, struct(pos - l as a, pos + g + r as b), null) run", f"if({hit}, item, null) item").filter("n is not null or run is not null")
    by = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n").cast("long").alias("n_words"), F.sort_array(F.collect_set("run")).alias("runs"), F.array_sort(F.collect_set("item")).alias("hits"))
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], x["b"]).cast("long").alias("end")),
        lambda acc: acc["n"],
    )
    return by.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("hits").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        "row",
    )


def _run(w: str, context: str, at: str, of: str, j: int, forward: bool = False) -> str:
    """1 if the j nearest words on one side are all equal, else 0; summed over j this is the length of the equal run."""
    equal = []
    for i in range(1, j + 1):
        here = at.replace(f"- {j}", f"- {i}") if not forward else at.replace(f"+ {j - 1}", f"+ {i - 1}")
        there = of.replace(f"- {j}", f"- {i}") if not forward else of.replace(f"{j - 1}", f"{i - 1}")
        equal.append(f"coalesce(get({w}, {here}) = get({context}, {there}), false)")
    return f"if({' and '.join(equal)}, 1, 0)"


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS t FROM bw),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT rid, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, sizes WHERE len(w) >= m),
dt AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS t FROM dw),
hit AS (SELECT rid, i, m, item FROM dt JOIN win USING (m, t)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

QUERIES = {"op8_winnowing": op8_winnowing}
ORACLES = {"op8_winnowing": SQL}
