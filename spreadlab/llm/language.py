"""Language identification: known words first, backing off to ever shorter character n-grams.

A word is a run of letters (ASCII letters and characters beyond ASCII), lower-cased.  A known word
scores by its log frequency in each language.  An unknown one scores at each of its characters by
the longest known n-gram that starts there, of five characters down to one, its ends marked.
The language with the largest sum wins; the score is its share of the likelihood.

Learning uses at most ``max_rows`` documents with a language, those first by a hash of their id, and of these as many as have ``max_bytes``
together (a text that is too long for what is left is passed over), which bounds the model.
All their words and n-grams are learned, unless ``max_words`` or ``max_grams`` (of each length) ask for the most frequent alone.

Nulls, ties and odd rows: a null text, or one without any letter, gives ``und`` and score 0; so does every
text if nothing could be learned.  Equal sums give the language first by name.  Rows with null lang
or id teach nothing; repeated rows teach once.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm import _text as T
from spreadlab.llm._session import shipped
from spreadlab.llm.toxicity import remainder

#: Bound of the learned sample, and characters of the longest n-grams.
MAX_ROWS, LONGEST = 4_000, 5
#: Bytes of the sample's texts, which bound the words that reach the driver and the model that is broadcast.
MAX_BYTES = 64 << 20


def _words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """The spans, each between the marks \\x02 and \\x03, in one string."""
    size = end - start + 2
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(start - 1, size)
    out = buf[np.clip(at, 0, max(len(buf) - 1, 0))] if len(buf) else np.zeros(0, np.uint8)
    out[first] = 2
    out[first + size - 1] = 3
    return out.tobytes().decode("utf-8", "replace")


def _grams(marked: str):
    """For n = LONGEST .. 1, in turn: (hash of the n-gram at each character, whether it stays in its word); and the word of each character."""
    c = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(c == 2) - 1

    def each():
        for n in range(LONGEST, 0, -1):
            h = np.full(len(c), n, np.uint64)
            for k in range(n):
                h[: len(c) - k] = T.mix(h[: len(c) - k] * T.M3 + c[k:])
            ok = np.zeros(len(c), bool)
            ok[: len(c) - n + 1] = word[: len(c) - n + 1] == word[n - 1 :]
            yield h, ok

    return each(), word


def count_words(batches):
    """(lang, word, n) for each chunk of texts."""
    for batch in batches:
        lang, text = (batch.column(batch.schema.get_field_index(c)) for c in ("lang", "text"))
        for lo, hi, buf, at in T.chunks(pc.utf8_lower(text)):
            w = T.Words(buf, at, T.LETTER)
            own = lang.slice(lo, hi - lo).dictionary_encode()
            key = T.mix(w.hash + own.indices.to_numpy()[w.row].astype(np.uint64) * T.M5)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            if len(first):
                spelt = _words(buf, w.start[first], w.end[first])[1:-1].split("\x03\x02")
                yield pa.record_batch({"lang": own.dictionary.take(pa.array(own.indices.to_numpy()[w.row[first]])).cast(pa.string()), "word": pa.array(spelt, pa.string()), "n": pa.array(n.astype(np.int64))})


def _logs(key: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int, most: int | None):
    """Sorted keys and their smoothed log frequencies in each language; of the ``most`` frequent keys, or of all."""
    keys, inverse = np.unique(key, return_inverse=True)
    table = np.bincount(inverse * langs + lang, weights=n, minlength=len(keys) * langs).reshape(len(keys), langs)
    logs = np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * max(len(keys), 1))).astype(np.float32)
    if most is None or len(keys) <= most:
        return keys, logs
    keep = np.sort(np.lexsort((keys, -table.sum(axis=1)))[:most])
    return keys[keep], logs[keep]


def build(lang: list[str], word: list[str], n: np.ndarray, max_words: int | None = None, max_grams: int | None = None):
    """The model of word counts: (languages, word table, n-gram tables).  A word's n-grams count 1 + log(how often it comes)."""
    langs = sorted(set(lang))
    code = {x: i for i, x in enumerate(langs)}
    of = np.array([code[x] for x in lang], np.int64)
    data = "".join(word).encode()
    size = np.array([len(x.encode()) for x in word], np.int64)
    end = np.cumsum(size)
    buf = np.frombuffer(data, np.uint8)
    words = _logs(T.spans_hash(buf, end - size, end), of, n, len(langs), max_words)
    grams, word_of = _grams(_words(buf, end - size, end))
    weight = 1 + np.log(n)
    return langs, words, [_logs(g[ok], of[word_of[ok]], weight[word_of[ok]], len(langs), max_grams) for g, ok in grams]


def _lookup(keys: np.ndarray, of: np.ndarray):
    at = np.minimum(np.searchsorted(keys, of), max(len(keys) - 1, 0))
    return at, (keys[at] == of if len(keys) else np.zeros(len(of), bool))


def apply(batches, model):
    """(doc_id, lang_pred, score) of each row."""
    langs, (known, logs), tables = model.value
    for batch in batches:
        ids, text = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
        lower = pc.utf8_lower(text)
        for lo, hi, buf, at in T.chunks(lower):
            w = T.Words(buf, at, T.LETTER)
            rows = hi - lo
            h, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            where, seen = _lookup(known, h)
            by_word = np.zeros((len(h), len(langs)), np.float32)
            by_word[seen] = logs[where[seen]]
            rest = np.flatnonzero(~seen)
            if len(rest):
                grams, word_of = _grams(_words(buf, w.start[first[rest]], w.end[first[rest]]))
                value, open_ = np.zeros((len(word_of), len(langs)), np.float32), np.ones(len(word_of), bool)
                for (g, ok), (keys, lg) in zip(grams, tables, strict=True):
                    todo = np.flatnonzero(open_ & ok)
                    p, hit = _lookup(keys, g[todo])
                    value[todo[hit]] = lg[p[hit]]
                    open_[todo[hit]] = False
                for k in range(len(langs)):
                    by_word[rest, k] = np.bincount(word_of, value[:, k], len(rest)) / 3
            total = np.stack([np.bincount(w.row, by_word[inverse, k], rows) for k in range(len(langs))], axis=1)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total[np.arange(rows), best][:, None]).sum(axis=1)
            ascii_letter = np.zeros(256, bool)
            ascii_letter[[*range(65, 91), *range(97, 123)]] = True
            letters = np.diff(np.concatenate([[0], np.cumsum(ascii_letter[buf])])[at]) > 0
            for r in np.flatnonzero(~letters & (w.count > 0)).tolist():
                letters[r] = any(map(str.isalpha, lower[lo + r].as_py()))
            yield pa.record_batch({"doc_id": ids.slice(lo, hi - lo), "lang_pred": pa.array([langs[b] if x else "und" for b, x in zip(best.tolist(), letters.tolist(), strict=True)], pa.string()), "score": pa.array(np.where(letters, share, 0.0))})


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, **limits):
    """Model from rows of docs for which ``usable`` holds, or None if there is nothing to learn from; limits: max_words, max_grams."""
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), usable.alias("usable")).where("usable and lang is not null and doc_id is not null")
    named = named.withColumn("mark", F.xxhash64("text"))
    first = named.select("doc_id", "lang", "mark", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct().withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id", "lang", "mark").limit(max_rows).collect()
    chosen, left = [], max_bytes
    for r in first:  # a text that is too long for what is left is passed over
        if r.size <= left:
            chosen.append((r.doc_id, r.lang, r.mark))
            left -= r.size
    turn = docs.sparkSession.createDataFrame(chosen, "doc_id long, lang string, mark long")
    taught = named.join(F.broadcast(turn), ["doc_id", "lang", "mark"]).groupBy("doc_id", "lang", "mark").agg(F.first("text").alias("text"))  # repeated rows teach once
    counts = taught.select("lang", "text").mapInArrow(shipped(count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = counts.orderBy("lang", "word").toArrow()
    return build(got["lang"].to_pylist(), got["word"].to_pylist(), got["n"].to_numpy(), **limits) if len(got) else None


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(shipped(apply, model=docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def language_held_out(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from rows whose id's crc32 has another remainder."""
    out = identify(docs, fit(docs, remainder(docs["doc_id"], modulus) != held))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
