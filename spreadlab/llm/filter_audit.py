"""Filter interaction audit: what each filter removes in each order of filters, from one CUBE.

Each document gets one boolean per filter (true: it fails).  Documents are first summed by part and flags, at most
parts x 2 ** filters rows; a SQL CUBE over the flags and the part then makes all grouping sets.  A grouping-set row whose selected
flags are all false counts the documents that pass just those filters: the survivors of that subset, in whatever order it is
applied.  Each step of each order joins two such subsets: the filters before it, and those with it.

The filters of ``document_flags`` see whole texts (null: empty; words are what ASCII white space separates):
A fewer than 100 words; B less than 80 % of the words distinct; C more than 10 % of the code points A-Z; D any of #$%&*|;
E equal to the text of a smaller doc_id.  For E only digests travel: the least id of each text is found with a partial
aggregation and joined back by id, so that a group of copies, however large, is one row a task and never one key of a join.

Nulls, ties and odd rows: a null part is the empty string; a null id never fails E, makes no copy fail, and has no label; rows
that repeat id and text fail E only if a smaller id has the text; of several labels of an id, any 1 counts.  Without documents
there are no parts and no rows; without labels nothing good or toxic is lost.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm._session import spool
from spreadlab.llm.decontaminate import UPPER

#: Filters in the order of their letters; orders are their permutations, so they are few.
FILTERS = ("A", "B", "C", "D", "E")
LEAST_WORDS, DISTINCT, CAPITALS = 100, 80, 10
# What parts words, and the characters of filter D.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
_SUMS = ("n", "good", "toxic")


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of each row."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", "text", F.array_remove(F.split("text", SPACE), "").alias("w"))
    n, length = F.size("w"), F.length("text")
    capitals = length - F.length(F.translate("text", UPPER, ""))
    flags = (n < LEAST_WORDS, 100 * F.size(F.array_distinct("w")) < DISTINCT * n, 100 * capitals > CAPITALS * length, F.col("text").rlike(SYMBOLS))
    light = spool(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(f.alias(x) for f, x in zip(flags, FILTERS, strict=False))), "flags")
    first = light.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id", "digest", F.lit(False).alias("E"))
    known = light.where("doc_id is not null").join(first, ["doc_id", "digest"], "left").withColumn("E", F.coalesce("E", F.lit(True)))
    return known.unionByName(light.where("doc_id is null").withColumn("E", F.lit(False))).select("doc_id", "part", *FILTERS)


def with_labels(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """flagged with good and toxic (0 or 1): whether a label of the id says so."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    known = flagged.where("doc_id is not null").join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    return known.unionByName(flagged.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def survivors(flagged: DataFrame, names: tuple[str, ...] = FILTERS) -> DataFrame:
    """(part, subset, n, good, toxic): what passes each subset of filters, zeros included; subset is a bit mask, bit k being names[k].

    flagged: a row for each document, with part (not null), a boolean (not null) for each name, and 0 or 1 in good and toxic.
    """
    sums = flagged.groupBy("part", *names).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    chosen = sum((F.when(F.col(f"_{x}") == 0, F.lit(1 << k)).otherwise(0) for k, x in enumerate(names)), F.lit(0))
    sets = sums.cube("part", *names).agg(*(F.sum(c).alias(c) for c in _SUMS), *(F.grouping(x).alias(f"_{x}") for x in ("part", *names)))
    for x in names:
        sets = sets.where((F.col(f"_{x}") == 1) | ~F.col(x))
    own = sets.where("_part = 0").select("part", chosen.alias("subset"), *_SUMS)
    every = sums.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(names) - 1))).alias("subset"))
    return every.join(own, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _SUMS))


def audit(flagged: DataFrame, names: tuple[str, ...] = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step.

    kept after the step and removed at it; redundant: failing its filter, but removed earlier; unique_fails: failing no other;
    good_lost and toxic_lost of the removed; shapley: the filter's removed, summed over all orders.
    """
    spark = flagged.sparkSession
    subsets = spool(survivors(flagged, names), "subsets")
    bit, steps, orders = {x: 1 << k for k, x in enumerate(names)}, [], Counter()
    for order in permutations(names):
        before = 0
        for k, x in enumerate(order):
            steps.append(("".join(order), k + 1, x, before))
            orders[x, before] += 1
            before |= bit[x]
    # two small tables that the number of filters bounds: each pair of subsets with the orders that take it, and each step
    pairs = spark.createDataFrame([(x, before, before | bit[x], n) for (x, before), n in orders.items()], "filter string, before int, after int, orders int")
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    old = subsets.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"old_{c}") for c in _SUMS))
    new = subsets.select("part", F.col("subset").alias("after"), *_SUMS)
    taken = old.join(F.broadcast(pairs), "before").join(new, ["part", "after"])
    taken = taken.select("part", "filter", "before", "after", "orders", F.col("n").alias("kept"), *((F.col(f"old_{c}") - F.col(c)).alias(c) for c in _SUMS))
    whole = 2 ** len(names) - 1
    filters = taken.groupBy("part", "filter").agg(F.sum(F.when(F.col("before") == 0, F.col("n"))).alias("fails"), F.sum(F.when(F.col("after") == whole, F.col("n"))).alias("unique_fails"), F.sum(F.col("n") * F.col("orders")).alias("shapley"))
    out = taken.join(F.broadcast(steps), ["filter", "before"]).join(filters, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


#: DuckDB SQL for the rows of op11: each pattern of failures is walked through each order.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
f AS (
  SELECT w.doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * (length(w.text) - length(translate(w.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(w.text) AS c,
    regexp_matches(w.text, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e
  FROM w JOIN firsts ON w.text = firsts.text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
grown AS (SELECT '' AS o UNION ALL SELECT o || x FROM grown, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, k::INT AS step, o[k:k] AS own, left(o, k::INT - 1) AS before FROM grown, range(1, 6) q(k) WHERE length(o) = 5),
m AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS fails, failed = own AS alone,
    translate(failed, before, '') <> failed AS gone
  FROM fails, steps),
r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN gone OR fails THEN 0 ELSE n END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM m GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
