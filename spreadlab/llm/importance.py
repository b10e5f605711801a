"""Importance resampling towards a target: documents are drawn by how much their hashed n-grams look like the target's.

Features are a text's words and pairs of words, each hashed to a bucket.  Counts of all documents and of all target texts
give each bucket a gain, the logarithm of how much more often the target has it; a document's weight is the mean gain of its
features.  Gumbel noise from the id's hash makes the highest scores a draw without replacement.

Scores are made without exploding: higher-order functions make a document's bucket array, and an aggregate sums element_at of the
gains, an array literal of BUCKETS numbers.  The arrays are written once to the shared folder (some two bytes a feature), for counts and
scores alike, as making them costs far more than reading them.  What shuffles are BUCKETS count totals, one row for each score, and (id, score) of the
documents drawn.  A rank is the number of documents with higher scores, plus the place among equal scores: scores are whole
numbers, at most some 160,000 different ones (gains and noise are logarithms of 64-bit numbers), so that table is broadcast.

Nulls, ties and odd rows: a null text has no words, weight 0; a null id draws its noise as the empty string and comes last
among equals; ties go to the smaller id; rows that repeat an id are ranked one after the other.  Empty tables of documents
give an empty result; without target texts the gains only tell frequent features from rare ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.llm._session import spool
from spreadlab.llm.decontaminate import BETWEEN, LOWER, UPPER

#: Buckets of features, share drawn in per cent, least words of a document that can be drawn, and the noise's seed.
BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, 7


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null.  ASCII texts take the faster way to the same letters."""
    text = text.cast("string")
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, BETWEEN), ""), F.array().cast("array<string>"))


def features(df: DataFrame, *keep: Column, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The kept columns, n_words, and b: the bucket of each word and of each pair of words."""
    rows = df.select(*keep, words(df[text_col]).alias("_w"))

    def bucket(x: Column) -> Column:
        return F.pmod(F.crc32(x), F.lit(buckets)).cast("int")

    ones = F.transform("_w", bucket)
    size = F.size("_w")
    pairs = F.zip_with(F.slice("_w", 1, F.greatest(size - 1, F.lit(0))), F.slice("_w", 2, F.greatest(size - 1, F.lit(0))), lambda x, y: bucket(F.concat(x, F.lit(" "), y)))
    return rows.select(*(c for c in rows.columns if c != "_w"), size.cast("long").alias("n_words"), F.concat(ones, pairs).alias("b"))


def bucket_counts(featured: DataFrame) -> DataFrame:
    """(bucket, n), summed within each task before the totals shuffle.

    An outer explode, as from a plain one Spark infers a filter on the array's size, for which it would be made twice.
    """
    return featured.select(F.explode_outer("b").alias("bucket")).groupBy("bucket").agg(F.count("bucket").alias("n")).where("bucket is not null")


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """1000 times the logarithm of each bucket's share in the target over its share in docs (both featured), each with one count more, rounded down."""
    both = bucket_counts(docs).withColumn("own", F.lit(True)).unionByName(bucket_counts(target).withColumn("own", F.lit(False)))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("n"))
    sums = every.unionByName(both).groupBy("bucket").agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).cast("double").alias("s"), F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).cast("double").alias("t"))
    sums = spool(sums, "buckets")
    total = sums.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1.0) * F.lit(total.s + buckets)) / ((F.col("s") + 1.0) * F.lit(total.t + buckets))
    return [r.gain for r in sums.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]  # BUCKETS rows


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(rows: DataFrame, gain: list[int], id_col: Column, seed: int = SEED) -> DataFrame:
    """Featured rows with n_features, weight and score in place of b; rows stay where they are."""
    keep = [c for c in rows.columns if c != "b"]
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.element_at(table, x + 1))
    rows = rows.select(*keep, id_col.alias("_id"), F.size("b").cast("long").alias("n_features"), total.alias("_sum"))
    n = F.greatest("n_features", F.lit(1).cast("long"))
    rows = rows.withColumn("weight", ((F.col("_sum") - F.pmod("_sum", n)) / n).cast("long"))  # a whole quotient
    return rows.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)).drop("_sum", "_id")


def weighed(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> tuple[DataFrame, list[int]]:
    """Each document's doc_id, n_words, n_features, weight and score, written; and the gains."""
    own = spool(features(docs, docs[id_col].alias("doc_id"), text_col=text_col, buckets=buckets), "features")
    gain = gains(own, features(target, text_col=text_col, buckets=buckets), buckets)
    return spool(scored(own, gain, F.col("doc_id"), seed), "scores"), gain


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of each document; rank counts those drawn, and is null for all others."""
    return ranked(weighed(docs, target, id_col, text_col, buckets, seed)[0], share, least_words)


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Weighed documents with the rank of those drawn."""
    able = F.col("n_words") >= least_words
    down = Window.orderBy(F.desc("score"))  # a row for each whole score
    steps = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    steps = steps.select("score", F.sum("n").over(down).alias("upto"), "n", F.sum("n").over(Window.partitionBy()).alias("total"))
    steps = steps.select("score", (F.col("upto") - F.col("n")).alias("above"), F.floor(share * F.col("total") / F.lit(100)).alias("most")).where("above < most")
    drawn = rows.where(able).join(F.broadcast(steps), "score")
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    drawn = drawn.select("doc_id", "n_features", "weight", "score", place.alias("rank"), "n_words", "most").withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank"))).drop("most")
    others = rows.where(~able).unionByName(rows.where(able).join(F.broadcast(steps.select("score")), "score", "left_anti"))
    return drawn.unionByName(others.withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, with their columns.

    The lowest (score, id) that is drawn is a threshold, so whole rows are filtered where they are read; rows that repeat the id at
    the threshold come all or none.
    """
    rows, gain = weighed(docs, target, id_col, text_col, buckets, seed)
    end = ranked(rows, share, least_words).where("rank is not null").orderBy(F.desc("rank")).first()
    if end is None:
        return docs.limit(0)
    own = F.col("_row")[id_col]
    rows = scored(features(docs, F.struct(*(docs[c] for c in docs.columns)).alias("_row"), text_col=text_col, buckets=buckets), gain, own, seed)
    last = F.lit(True) if end.doc_id is None else F.coalesce(own <= F.lit(end.doc_id), F.lit(False))
    return rows.where((F.col("n_words") >= least_words) & ((F.col("score") > end.score) | ((F.col("score") == end.score) & last))).select("_row.*")


#: DuckDB SQL for the rows of op13.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
fd AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM d),
fb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM b),
crc AS (SELECT list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v, i FROM range(256) q(i)),
tab AS (SELECT list(v ORDER BY i) AS tab FROM crc),
words AS (SELECT DISTINCT x FROM (SELECT x FROM fd UNION ALL SELECT x FROM fb)),
hex AS (SELECT x, hex(encode(x)) AS h FROM words),
hashed AS (
  SELECT x, xor(list_reduce(list_transform(range(1, length(h)::BIGINT + 1, 2), lambda i: (16 * (instr('0123456789ABCDEF', h[i:i]) - 1) + instr('0123456789ABCDEF', h[i + 1:i + 1]) - 1)::BIGINT),
    lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM hex, tab),
bd AS (SELECT doc_id, bucket FROM fd JOIN hashed USING (x)),
s AS (SELECT bucket, count(*) AS s FROM bd GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN hashed USING (x) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
own AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM bd JOIN g USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN own USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN k <= 25 * n // 100 THEN k END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
