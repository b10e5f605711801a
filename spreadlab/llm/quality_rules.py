"""Quality rules as a ledger: every rule is evaluated once, and policies of any version are applied to what is stored.

A text's measurements (words, symbols, repeated lines and so on) are taken in one pass over its bytes.  Each rule is a comparison of
measurements; its failure sets the rule's bit.  The ledger keeps measurements and bits, so that a policy is a mask of rules,
``bits & mask`` its verdict, and a new version needs no text.  For ablations the rows are summed by bits first: of at most
2 ** rules patterns each policy counts what it keeps, and would keep without each of its rules.

Words are what ASCII white space separates; lines are split at \\n.  Repeated windows and lines are found by 64-bit hashes.
Shares are compared as whole numbers.

Nulls, ties and odd rows: a null text has no words; a text without words fails few_words alone; repeated rows get equal
results.  An empty table gives an empty ledger, and ablations of none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm import _text as T
from spreadlab.llm._session import shipped, unused

#: Measurements of a text, in code points, characters, lines and words.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_long_words")
#: Words of a window that counts as repeated, and bytes from which on a word is long.
WINDOW, LONG = 3, 64
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Rules, in the order of their bits: a text fails where the comparison holds.  The first two are the base.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "n_words > 0 and 10 * word_chars < 20 * n_words",
    "overlong_words": "10 * word_chars > 150 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "few_letters": "100 * n_letter_words < 60 * n_words",
    "long_words": "100 * n_long_words > 10 * n_words",
}
BASE = ("few_words", "repeated_windows")
#: Versions of the policy: the rules that reject.
POLICIES = {1: BASE, 2: (*BASE, "symbols", "repeated_lines"), 3: tuple(RULES)}
VERSION = 3

_WITHIN_LINE = np.ones(256, bool)
_WITHIN_LINE[10] = False


def mask_of(rules: tuple[str, ...] | list[str]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in set(rules))


def _sums(mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])[at])


def _seen(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, key), in their order: whether it came before, and whether it comes at least twice."""
    order = np.lexsort((key, row))  # stable: the first of equals stays first
    same = np.zeros(len(order), bool)
    same[1:] = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    before, many = np.zeros(len(order), bool), np.zeros(len(order), bool)
    before[order], many[order] = same, twice
    return before, many


def measured(buf: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES of each text: bytes buf, cut at the offsets."""
    rows = len(at) - 1
    w = T.Words(buf, at, T.NOT_SPACE)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    letters = np.concatenate([[0], np.cumsum(T.LETTER[buf])])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def per_row(of_words: np.ndarray) -> np.ndarray:
        return _sums(of_words, w.bounds)

    window, row = T.ngrams(w, WINDOW)
    covered = np.zeros(len(w.start), bool)
    if len(window):
        place = np.flatnonzero(w.row[: len(w.row) - WINDOW + 1] == w.row[WINDOW - 1 :])
        many = place[_seen(row, window)[1]]
        for k in range(WINDOW):
            covered[many + k] = True
    lines = T.Words(buf, at, _WITHIN_LINE)
    worded = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)  # a word does not cross a line's end
    again = np.zeros(len(lines.start), bool)
    again[worded] = _seen(lines.row[worded], lines.hash[worded])[0]
    size = w.end - w.start
    out = (
        w.count,
        per_row(points[w.end] - points[w.start]),
        _sums(symbol[buf], at),
        _sums(again, lines.bounds),
        per_row(covered),
        _sums(worded, lines.bounds),
        per_row(letters[w.end] > letters[w.start]),
        per_row(size >= LONG),
    )
    return {name: x.astype(np.int64) if len(x) == rows else np.zeros(rows, np.int64) for name, x in zip(MEASURES, out, strict=True)}


def measure(batches, field: str):
    """The rows, without their texts, with MEASURES."""
    for batch in batches:
        i = batch.schema.get_field_index(field)
        parts = [measured(buf, at) for _, _, buf, at in T.chunks(batch.column(i))]
        got = {m: np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64) for m in MEASURES}
        rest = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if k != i}
        yield pa.record_batch(rest | {m: pa.array(got[m]) for m in MEASURES})


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, MEASURES, bits): each document's measurements, and a bit for each rule of RULES that it fails."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(shipped(measure, field="text"), f"doc_id {kind}, {', '.join(f'{m} long' for m in MEASURES)}")
    bits = sum((F.when(F.expr(x), F.lit(1 << k)).otherwise(0) for k, x in enumerate(RULES.values())), F.lit(0)).cast("long")
    return out.withColumn("bits", bits)


def verdicts(entries: DataFrame, version: int = VERSION) -> DataFrame:
    """The ledger with base_failed, and kept by the policy of that version (which rejects what the base rejects)."""
    base = F.col("bits").bitwiseAND(mask_of(BASE)) != 0
    return entries.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("bits").bitwiseAND(mask_of(POLICIES[version])) == 0))


def ablations(entries: DataFrame, policies: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """(version, rule, failed, failed_alone, kept, kept_without): of each policy's rules, documents that fail it, that fail it alone of the
    policy's, that the policy keeps, and that it would keep without the rule."""
    policies = POLICIES if policies is None else policies
    plans = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(mask_of(rules)).cast("long").alias("mask"), F.lit(mask_of([r])).cast("long").alias("bit")) for v, rules in policies.items() for r in rules]
    patterns = entries.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))  # 2 ** rules at most
    rows = patterns.select("bits", "n", F.explode(F.array(*plans)).alias("p")).select("bits", "n", "p.*")
    bits, mask, bit, n = F.col("bits"), F.col("mask"), F.col("bit"), F.col("n")

    def count(where: Column) -> Column:
        return F.sum(F.when(where, n).otherwise(0))

    return rows.groupBy("version", "rule").agg(
        count(bits.bitwiseAND(bit) != 0).alias("failed"),
        count(bits.bitwiseAND(mask) == bit).alias("failed_alone"),
        count(bits.bitwiseAND(mask) == 0).alias("kept"),
        count(bits.bitwiseAND(mask.bitwiseXOR(bit)) == 0).alias("kept_without"),
    )


def clean(docs: DataFrame, version: int = VERSION, text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns; measured where they are, without a join."""
    (field,) = unused(docs.withColumns({m: F.lit(0) for m in (*MEASURES, "bits") if m not in docs.columns}), "measured")
    whole = F.struct(*(docs[c] for c in docs.columns)).alias(field)
    rows = docs.select(whole, docs[text_col].cast("string").alias("text"))
    kinds = f"`{field}` {rows.schema[field].dataType.simpleString()}, {', '.join(f'{m} long' for m in MEASURES)}"
    out = rows.mapInArrow(shipped(measure, field="text"), kinds)
    wrong = sum((F.when(F.expr(x), F.lit(1 << k)).otherwise(0) for k, x in enumerate(RULES.values())), F.lit(0))
    return out.where(wrong.bitwiseAND(mask_of(BASE) | mask_of(POLICIES[version])) == 0).select(f"{field}.*")


#: DuckDB SQL for the rows of op12.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS l FROM d),
win AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS x FROM w WHERE len(w) >= 3),
hit AS (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM win),
rep AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM hit WHERE c > 1) GROUP BY k),
lines AS (SELECT k, line, count(*) AS c FROM (SELECT k, unnest(l) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
dup AS (SELECT k, sum(c - 1) AS n, sum(c) AS every FROM lines GROUP BY k),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(every, 0) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_letter_words,
    len(list_filter(w, lambda x: strlen(x) >= 64)) AS n_long_words
  FROM w LEFT JOIN dup USING (k) LEFT JOIN rep USING (k)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (n_words > 0 AND 10 * word_chars < 20 * n_words) OR 10 * word_chars > 150 * n_words OR 100 * n_symbols > 10 * n_words
    OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_letter_words < 60 * n_words OR 100 * n_long_words > 10 * n_words) AS kept
FROM v
"""
