"""Benchmark decontamination: short test items inside long documents.

Size-partitioned MinHash containment search in built-in functions only.  An item's
text is the set of its distinct 5-word shingles (a shorter item: its whole word
sequence).  Items are partitioned by the size of that set (powers of two; items of
fewer than five words by their length), and a partition's items keep a bottom-k MinHash
sketch deep enough for the threshold ``t``: the ``floor((1 - t) * q) + 1`` smallest
hashes of the ``q`` shingles.  A document that holds ``t`` of an item's shingles holds
at least one of its sketch, however long the document is.

1. Every document's shingles are hashed once, for all item lengths together, and
   joined with the sketches alone, a fifth of the items' shingles: the documents that
   meet one are candidates for that partition.
2. Only candidates are read again; their shingles are compared with the partition's
   items as text and counted exactly.

Sketches and items are broadcast only while the items have at most ``BROADCAST_ROWS``
shingles (counted first), candidates while there are at most as many; beyond that the
same joins shuffle.  A passage that many documents hold makes one row a document.

Defined cases: items without words are never found; null and empty texts hold
nothing; item rows with the same id are separate texts of that id, and so are
document rows; the best containment of a pair is returned; a null id is an id of
its own; an empty table on either side gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import stored

WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000
_BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words between ASCII white space."""
    bare = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))


def _hashes(column: str, n: int) -> Column:
    """Hash of the ``n`` words from each position, from the words' hashes."""
    at = F.col(column)
    last = F.size(at) - n
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[at[i + j] for j in range(n)])))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that is computed once a row: the explode of one element
    keeps the optimizer from writing it into each use, inside lambdas too."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _shingled(rows: DataFrame, n: int) -> DataFrame:
    return _once(rows, "wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn("sh", _hashes("wh", n)).drop("wh")


def item_shingles(items: DataFrame, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """One row per item and distinct shingle of ``n`` words: hash, text, set size, size partition, and
    whether it is in the sketch."""
    size = F.least(F.size("w"), F.lit(WORDS))
    rows = (_once(items.select(F.col(id_col).alias("item"), F.col(text_col).alias("t")), "w", words(F.col("t")))
            .where(size == n).withColumn("item_tag", F.xxhash64("t")))
    flat = (_shingled(rows, n).select("item", "item_tag", "w", F.posexplode("sh").alias("i", "h"))
            .select("item", "item_tag", "h", F.concat_ws(" ", F.slice("w", F.col("i") + 1, n)).alias("s")).distinct())
    own = Window.partitionBy("item", "item_tag")
    part = F.when(F.lit(n == WORDS), WORDS + F.floor(F.log2("q"))).otherwise(n).cast("int")
    return (flat.withColumn("q", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("h", "s")))
            .withColumn("in_sketch", F.col("r") <= F.floor((1 - F.lit(threshold)) * F.col("q") + 1e-9) + 1).drop("r")
            .withColumns({"n": F.lit(n), "part": part}))


def candidates(texts: DataFrame, sketches: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """``doc, tag, part``: documents that hold a sketch hash of an item of the size partition."""
    hashed = _once(_once(texts, "w", words(F.col("t"))).select("doc", F.xxhash64("t").alias("tag"), "w"),
                   "wh", F.transform("w", lambda x: F.xxhash64(x)))
    every = F.concat(*[_hashes("wh", n) for n in lengths])
    flat = hashed.select("doc", "tag", F.explode(every).alias("h"))
    return flat.join(F.broadcast(sketches) if small else sketches, "h").select("doc", "tag", "part").distinct()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (item, document) with ``matched`` of the item's ``n_shingles`` shingles in
    the document, where ``matched >= threshold * n_shingles``, and ``containment``."""
    lengths = sorted(r["n"] for r in items.select(F.least(F.size(words(F.col(item_text_col))), F.lit(WORDS)).alias("n")).where("n > 0").distinct().collect()) or [WORDS]
    wanted = item_shingles(items, lengths[0], threshold, item_col, item_text_col)
    for n in lengths[1:]:
        wanted = wanted.unionByName(item_shingles(items, n, threshold, item_col, item_text_col))
    wanted = stored(wanted, "item-shingles")
    small = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    sketches = wanted.where("in_sketch").select("h", "part").distinct()
    near = stored(candidates(texts, sketches, lengths, small), "candidates")
    few = near.limit(broadcast_rows + 1).count() <= broadcast_rows
    held = near.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_set("part").alias("parts"))  # at most one a power of two
    tagged = texts.withColumn("tag", F.xxhash64("t"))
    again = tagged.join(F.broadcast(held) if few else held, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag"))).select("doc", "tag", "parts", "t")
    found = None
    for n in lengths:
        flat = _shingled(_once(again, "w", words(F.col("t"))).select("doc", "tag", "parts", "w"), n).select("doc", "tag", "parts", "w", F.posexplode("sh").alias("i", "h"))
        if not small:  # the shuffle moves the shingle's own words only
            flat = flat.select("doc", "tag", "parts", F.slice("w", F.col("i") + 1, n).alias("w"), F.lit(0).alias("i"), "h")
        own = wanted.where(F.col("n") == n)
        met = flat.join(F.broadcast(own) if small else own, "h").where(
            F.array_contains("parts", F.col("part")) & (F.concat_ws(" ", F.slice("w", F.col("i") + 1, n)) == F.col("s")))
        pairs = (met.groupBy("item", "item_tag", "doc", "tag", "s").agg(F.max("q").alias("q"))
                 .groupBy("item", "item_tag", "doc", "tag").agg(F.count("*").alias("matched"), F.max("q").alias("n_shingles"))
                 .where(F.col("matched") >= F.lit(threshold) * F.col("n_shingles") - 1e-9))
        found = pairs if found is None else found.unionByName(pairs)
    best = found.groupBy("item", "doc").agg(F.max(F.struct(F.col("matched") / F.col("n_shingles"), "matched", "n_shingles")).alias("b"))
    return best.select(F.col("item").alias(item_col), F.col("doc").alias(id_col), F.col("b.matched").alias("matched"),
                       F.col("b.n_shingles").alias("n_shingles"), (F.col("b.matched") / F.col("b.n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that hold an item."""
    hit = contaminated(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("_hit")).distinct()
    return docs.join(hit, docs[id_col].eqNullSafe(F.col("_hit")), "left_anti")
