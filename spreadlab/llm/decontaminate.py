"""Benchmark decontamination with DataFrame functions only.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII.  A benchmark item's windows are its
runs of 13 words, or all its words if it has fewer.  The distinct windows, with a hash of each, are the broadcast
side of a hash join; the other side are the documents' own windows, one for each position and size of window, of which only the
hash is computed.  Where a hash is met the words themselves are compared, so none is reported by hash alone.
Positions are made, joined and dropped within one stage: what leaves it are hits, and one row for each document.

A broadcast holds at most BLOCK_BYTES.  Windows beyond that are dealt out by hash over as many blocks as it takes,
each a broadcast of its own that all documents are held against.

Nulls, ties and odd rows: a null text has no words; a null item text has no windows; an item without id marks words but
is not counted; items with one id count once; repeated documents are rows of their own.  Empty tables of documents or
items give an empty result or clean documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm._session import spool, unused

#: Words of a window, and bytes that are broadcast at once.
WINDOW, BLOCK_BYTES = 13, 48 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What words are made of, in lower and in either case, and what parts them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE, BETWEEN_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null.

    Texts are split, as regexp_extract_all copies the whole text for each match.
    """
    return F.coalesce(F.array_remove(F.split(F.translate(text.cast("string"), UPPER, LOWER), BETWEEN), ""), F.array().cast("array<string>"))


def hashes(w: Column) -> Column:
    """A hash of each word; the hash of a window is that of its words' hashes."""
    return F.transform(w, lambda x: F.xxhash64(x))


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, win, size, h): each item's distinct windows, their words joined by blanks (which no word has), and hashes."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item_id"), words(benchmark[text_col]).alias("w")).where("size(w) > 0")
    size = F.size("w")
    cut = F.when(size >= window, F.transform(F.sequence(F.lit(1), F.greatest(size - window + 1, F.lit(1))), lambda i: F.slice("w", i, window))).otherwise(F.array("w"))
    return items.select("item_id", F.explode(cut).alias("words")).select("item_id", F.array_join("words", " ").alias("win"), F.size("words").alias("size"), F.xxhash64(hashes(F.col("words"))).alias("h")).distinct()


def _small(df: DataFrame, size: int) -> DataFrame:
    """df to be broadcast if its measured ``size`` in bytes allows; else joins shuffle."""
    return F.broadcast(df) if size <= BLOCK_BYTES else df.hint("merge")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: key columns, n_words, hits (start and size of each window found) and items."""
    found = spool(windows(benchmark, window=window), "windows")
    known = found.select("win", "size", "h").distinct()
    total = known.agg(F.sum(F.octet_length("win") + 64).alias("bytes"), F.collect_set("size").alias("sizes")).first()  # sizes: WINDOW numbers at most
    owned = found.agg(F.sum(F.octet_length("win") + F.octet_length("item_id") + 64)).first()[0] or 0
    sizes, blocks = sorted(total.sizes, reverse=True) or [window], max(1, -(-(total.bytes or 0) // BLOCK_BYTES))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), words(docs[text_col]).alias("w"))
    if blocks > 1:
        rows = spool(rows, "words")  # all blocks see the same rows
    key = ["row", "doc_id", "text_hash", "n_words"]

    def block(k: int) -> DataFrame:
        """Hits of the windows in one block; the first block also keeps a row for each document."""
        own = known if blocks == 1 else known.where(F.pmod("h", F.lit(blocks)) == k)
        own = own.select(F.col("h").alias("own_h"), F.col("size").alias("own_size"), F.col("win"))
        spots = rows.select("row", "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "w", hashes(F.col("w")).alias("x"))
        spots = spots.select(*key, "w", "x", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)))).alias("i"))
        spots = spots.withColumn("k", F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*map(F.lit, sizes))))
        spots = spots.withColumn("h", F.xxhash64(F.slice("x", F.col("i") + 1, F.col("k"))))
        # of equal numbers of words, one is the other's beginning only if they are equal; an equation would become a key, made at each position
        same = (F.col("h") == F.col("own_h")) & (F.col("k") == F.col("own_size")) & F.concat(F.array_join(F.slice("w", F.col("i") + 1, F.col("k")), " "), F.lit(" ")).startswith(F.concat("win", F.lit(" ")))
        met = spots.join(F.broadcast(own), same, "left")
        met = met.where(F.col("win").isNotNull() | ((F.col("i") == 0) & (F.col("k") == sizes[0])) if k == 0 else F.col("win").isNotNull())
        return met.select(*key, F.when(F.col("win").isNotNull(), F.struct(F.col("i").alias("start"), F.col("k").alias("size"))).alias("hit"), "win")

    met = reduce(DataFrame.unionByName, map(block, range(blocks)))
    own = met.groupBy(*key).agg(F.collect_set("hit").alias("hits"), F.collect_set("win").alias("wins"))
    owners = found.select("win", "item_id").where("item_id is not null")
    named = own.select(*key, "hits", F.explode_outer("wins").alias("win")).join(_small(owners, owned), "win", "left")
    return named.groupBy(*key).agg(F.first("hits").alias("hits"), F.collect_set("item_id").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash, hit_words) of each document.

    Contaminated: at least one word in ``share`` is inside a benchmark window.
    """
    out = hits(docs, benchmark, id_col, text_col)
    inside = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    out = out.select("doc_id", "n_words", "text_hash", inside.alias("hit_words"), "items").withColumn("n_hit", F.size("hit_words").cast("long"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_hash", "hit_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents") -> DataFrame:
    """docs with its columns, without contaminated documents, or without the words inside windows (remove="spans").

    Decisions are written to the shared folder and join back by id and text, broadcast if their size allows.
    """
    key, mark, hit = unused(docs, "key", "mark", "hit")
    whole = remove == "documents"
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated" if whole else "n_hit > 0")
    bad = bad.select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark), *([] if whole else [F.col("hit_words").alias(hit)]))
    bad = spool(bad.dropDuplicates([key, mark]), "decisions")
    size = bad.agg(F.sum(F.lit(64) if whole else 64 + 4 * F.size(hit))).first()[0] or 0
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(mark))
    if whole:
        return docs.join(_small(bad, size), same, "left_anti")
    text = docs[text_col]
    own, gaps = F.array_remove(F.split(text, BETWEEN_ANY), ""), F.split(text, ANY_CASE)
    left = F.concat(F.array_join(F.transform(own, lambda w, i: F.concat(F.get(gaps, i), F.when(F.array_contains(hit, i), "").otherwise(w))), ""), F.element_at(gaps, -1))
    out = docs.join(_small(bad, size), same, "left")
    return out.select(*(F.when(F.col(hit).isNull(), docs[c]).otherwise(left).alias(c) if c == text_col else docs[c] for c in docs.columns))


#: DuckDB SQL for the rows of op5.
ORACLE_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wb AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 13 THEN list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) ELSE [w] END) AS win FROM b WHERE len(w) > 0),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS n FROM wb),
p AS (SELECT doc_id, sizes.n, unnest(range(1, len(w) - sizes.n + 2)) AS i, w FROM d, sizes WHERE len(w) >= sizes.n),
m AS (SELECT p.doc_id, p.i, p.n, wb.item_id FROM p JOIN wb ON wb.win = p.w[p.i:p.i + p.n - 1]),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
