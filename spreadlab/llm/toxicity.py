"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (modulo 2**bits) of its words, of neighbouring word pairs,
of pairs one word apart, and of word stems, also as seen twice and thrice; a word is a run of letters, digits and characters beyond ASCII, in lower
case.  Learning uses at most ``max_rows`` labelled documents, those first by a hash of their id, in that order, of which
the first with ``max_features`` features together; and features that ``least`` of those documents have; per-coordinate rates and the L1 term leave few weights, which are broadcast.

Nulls, ties and odd rows: a null or wordless text gets the score of the intercept alone; a null label or id
teaches nothing; an id with several labels teaches each of them, on each row of that id; repeated rows get equal
scores; with no usable label every score is 0.5.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm import _text as T
from spreadlab.llm._session import shipped, two_columns

#: Bounds of the labelled sample: documents, and their features (4 bytes each in the task that learns).
MAX_ROWS, MAX_FEATURES = 20_000, 48_000_000
BITS = 20
#: Bytes of a word that count as its stem.
STEM = 6
#: A gap of this many is a unit that stands for no feature.
WIDE = 65_535


def features(column: pa.Array, bits: int):
    """(feature, row) arrays, chunk by chunk: (first row, row after the last, features, rows)."""
    for lo, hi, buf, at in T.chunks(pc.utf8_lower(column.cast(pa.string()))):
        w = T.Words(buf, at, T.ALNUM)
        h, row = w.hash, w.row
        two, two_row = T.ngrams(w, 2)
        apart = row[:-2] == row[2:]
        skip = T.mix(h[:-2] * T.M5 + h[2:] * T.M4)[apart] if len(h) > 2 else h[:0]
        stem = T.mix(T.spans_hash(buf, w.start, np.minimum(w.end, w.start + STEM)) + T.M1)
        order = np.argsort((row.astype(np.uint64) << np.uint64(40)) | (stem >> np.uint64(24)), kind="stable")
        s, r = stem[order], row[order]
        again = [(T.mix(s[k:] + np.uint64(k)), r[k:]) for k in (1, 2) if len(s) > k]
        again = [(x[y], z[y]) for k, (x, z) in enumerate(again, 1) for y in [(s[k:] == s[:-k]) & (r[k:] == r[:-k])]]
        f = np.concatenate([h, two, skip, stem, *(x for x, _ in again)]) & np.uint64((1 << bits) - 1)
        yield lo, hi, f.astype(np.int64), np.concatenate([row, two_row, row[:-2][apart] if len(h) > 2 else row[:0], row, *(z for _, z in again)])


def pack(f: np.ndarray) -> bytes:
    """Ascending numbers as gaps of 16 bits; a gap's multiples of WIDE are units of their own."""
    many, rest = np.divmod(np.diff(f, prepend=0), WIDE)
    out = np.full(int(many.sum()) + len(f), WIDE, np.uint16)
    out[np.cumsum(many + 1) - 1] = rest
    return out.tobytes()


def unpack(data: np.ndarray) -> np.ndarray:
    return np.cumsum(data, dtype=np.int64)[data != WIDE]


def featurise(batches, bits: int):
    """(turn, label, f): the distinct features of each labelled text, packed."""
    for batch in batches:
        turn, label, text = (batch.column(batch.schema.get_field_index(c)) for c in ("turn", "label", "text"))
        for lo, hi, f, row in features(text, bits):
            key = np.unique((row << bits) | f)
            cut = np.searchsorted(key >> bits, np.arange(hi - lo + 1))
            f = key & ((1 << bits) - 1)
            yield pa.record_batch({"turn": turn.slice(lo, hi - lo), "label": label.slice(lo, hi - lo), "f": pa.array([pack(f[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def gather(batches, last: int, most: int):
    """(labels, bounds, flat): the features of all texts in one array of 32-bit integers, each text's closed by ``last``.

    It ends before the text that would make it longer than ``most``; memory is touched only as it fills.
    """
    labels, bounds, flat = [], [0], np.empty(most, np.int32)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("f"))
        for y, x in zip(batch.column(batch.schema.get_field_index("label")).to_pylist(), column, strict=True):
            f = unpack(np.frombuffer(x.as_buffer(), np.uint16))
            a, b = bounds[-1], bounds[-1] + len(f) + 1
            if b > most:
                return labels, bounds, flat
            flat[a : b - 1], flat[b - 1] = f, last
            labels.append(y)
            bounds.append(b)
    return labels, bounds, flat


def train(batches, bits: int, passes: int, alpha: float, beta: float, l1: float, l2: float, least: int, max_features: int):
    """One task over the bounded sample, in its order; gives the weights that are not zero."""
    size = (1 << bits) + 1  # the last is the intercept, free of L1
    labels, bounds, flat = gather(batches, size - 1, max_features)
    held = np.zeros(size, np.int64)
    for a in range(0, bounds[-1], 1 << 20):
        held += np.bincount(flat[a : min(a + (1 << 20), bounds[-1])], minlength=size)
    held[-1] = least
    end, cut = 0, [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # in place; the others would only let a document be learned by heart
        f = flat[a:b][held[flat[a:b]] >= least]
        flat[end : end + len(f)] = f
        end += len(f)
        cut.append(end)
    z, n = np.zeros(size), np.zeros(size)
    thin = np.full(size, l1)
    thin[-1] = 0.0

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= thin[i], 0.0, (np.sign(zi) * thin[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for y, a, b in zip(labels, cut[:-1], cut[1:], strict=True):
            i = flat[a:b]
            w = weight(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / alpha * w
            n[i] = more
    every = np.arange(size)
    w = weight(every)
    keep = np.flatnonzero(w)
    yield pa.record_batch({"f": pa.array(keep.astype(np.int64)), "w": pa.array(w[keep])})


def apply(batches, bits: int, model):
    """(doc_id, score) of each row."""
    index, weights = model.value
    intercept = weights[index == 1 << bits].sum()
    table = np.zeros(1 << bits)
    table[index[index < 1 << bits]] = weights[index < 1 << bits]
    for batch in batches:
        ids, text = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
        for lo, hi, f, row in features(text, bits):
            some = table[f] != 0
            key = np.unique((row[some] << bits) | f[some])
            total = np.bincount(key >> bits, weights=table[key & ((1 << bits) - 1)], minlength=hi - lo) + intercept
            yield pa.record_batch({"doc_id": ids.slice(lo, hi - lo), "score": pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))})


def accept(batches, bits: int, model, field: str, threshold: float):
    """The rows whose texts score below the threshold."""
    for batch in batches:
        i = batch.schema.get_field_index(field)
        plain = pa.record_batch({"doc_id": pa.nulls(batch.num_rows, pa.int64()), "text": batch.column(i)})
        scores = [r.column(1) for r in apply([plain], bits, model)]
        if scores:
            yield batch.filter(pc.less(pa.concat_arrays(scores), threshold))


def reject_toxic(docs: DataFrame, model, text_col: str = "text", bits: int = BITS, threshold: float = 0.7) -> DataFrame:
    """docs with its columns, without the rows whose texts score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(shipped(accept, bits=bits, model=shared, field=text_col, threshold=threshold), docs.schema)


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def sample(labels: DataFrame, id_col: str, label_col: str, usable: Column, max_rows: int) -> DataFrame:
    """(doc_id, label, turn): at most max_rows labelled ids, first by hash; any tie by id and label."""
    rows = labels.where(usable & labels[id_col].isNotNull() & labels[label_col].isin(0, 1)).select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).distinct()
    return rows.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id", "label").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS, passes: int = 6, alpha: float = 4.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, least: int = 5, max_features: int = MAX_FEATURES):
    """(features, weights), both arrays, learned from the labelled rows for which ``usable`` (a column of labels) holds."""
    some = F.broadcast(sample(labels, id_col, label_col, usable, max_rows))
    rows = two_columns(docs, id_col, text_col).join(some, "doc_id").select("turn", "label", "text")
    rows = rows.mapInArrow(shipped(featurise, bits=bits), "turn long, label int, f binary").repartition(1).sortWithinPartitions("turn", "label", "f")
    got = rows.mapInArrow(shipped(train, bits=bits, passes=passes, alpha=alpha, beta=beta, l1=l1, l2=l2, least=least, max_features=max_features), "f long, w double").toArrow()
    return got["f"].to_numpy().astype(np.int64), got["w"].to_numpy().astype(float)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, score) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return two_columns(docs, id_col, text_col).mapInArrow(shipped(apply, bits=bits, model=shared), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from rows whose id's crc32 has another remainder."""
    model = fit(docs, labels, remainder(labels["doc_id"], modulus) != held)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
