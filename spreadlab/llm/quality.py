"""Quality: ridge regression on random Fourier features of document statistics, then isotonic calibration.

A text becomes a few statistics (lengths, kinds of characters, repetition of words and lines).  Random
Fourier features approximate a Gaussian kernel over them; each partition sums its part of the normal
equations, which are as large as the number of features squared, whatever the input.  Raw ridge
scores are binned, and pooled neighbours make them monotone frequencies of label 1.

All labelled rows teach.  Texts are read once: their statistics are written to the shared folder,
and learning and scoring read those.

Nulls, ties and odd rows: a null text counts as empty, and empty texts are scored as any other; a null
label or id teaches nothing; an id with several labels teaches each; repeated rows get equal scores; with no
usable label every score is 0.5.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm import _text as T
from spreadlab.llm._session import shipped, spool, two_columns
from spreadlab.llm.toxicity import remainder

#: Random Fourier features, width of the kernel in standard deviations, ridge, bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-3, 1000
#: Partial sums of the normal equations that reach the driver, and that a task adds on the way there.
SUMS, FAN = 8, 32
_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 10, 11, 12, 13), "stop": b".,;:?'\"-()", "line": (10,), "high": range(128, 256), "bang": b"!", "bar": b"|"}
STATISTICS = 18


def statistics(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers for each text, about between 0 and 2."""
    size = np.diff(at)
    known = np.zeros(256, bool)
    share, base = [], np.maximum(size, 1)

    def per_row(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[at])

    for kind in _KINDS.values():
        table = np.zeros(256, bool)
        table[list(kind)] = True
        known |= table
        share.append(per_row(table[buf]))
    share.append(per_row(~known[buf]))
    share = np.stack(share, axis=1)
    w = T.Words(T.LOWER[buf], at, T.NOT_SPACE)
    words = np.maximum(w.count, 1)
    length = w.end - w.start
    rows = len(size)
    total, square = np.bincount(w.row, length, rows), np.bincount(w.row, length.astype(float) ** 2, rows)
    mean = total / words
    distinct, most, again = np.ones(rows), np.zeros(rows), np.zeros(rows)
    pairs, pair_row = T.ngrams(w, 2)
    cut = np.searchsorted(pair_row, np.arange(rows + 1))
    for r in np.flatnonzero(w.count).tolist():
        own = np.sort(w.hash[w.bounds[r] : w.bounds[r + 1]])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        distinct[r] = len(first) / len(own)
        most[r] = np.diff(np.append(first, len(own))).max() / len(own)
        two = np.sort(pairs[cut[r] : cut[r + 1]])
        again[r] = (two[1:] == two[:-1]).sum() / max(len(two), 1)
    lines = T.Words(buf, at, ~_LINE, hashed=True)
    whole = np.zeros(rows)
    for r in np.flatnonzero(lines.count > 1).tolist():
        own = lines.hash[lines.bounds[r] : lines.bounds[r + 1]]
        whole[r] = 1 - len(np.unique(own)) / len(own)
    out = np.column_stack([share / base[:, None], np.log1p(size) / 10, mean / 10, np.sqrt(np.maximum(square / words - mean**2, 0)) / 10, distinct, most, again, whole, np.log1p(w.count / np.maximum(lines.count, 1)) / 5])
    return out.astype(np.float32)


_LINE = np.zeros(256, bool)
_LINE[10] = True


def profile(batches):
    """(doc_id, x): the statistics as 32-bit floats."""
    for batch in batches:
        ids, text = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
        for lo, hi, buf, at in T.chunks(text):
            x = statistics(buf, at)
            yield pa.record_batch({"doc_id": ids.slice(lo, hi - lo), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def _matrix(batch) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(len(x), STATISTICS).astype(float)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> np.ndarray:
    """Features of which the products approximate the kernel, and a constant."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((x.shape[1], FEATURES)) / WIDTH
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b)
    return np.column_stack([z, np.ones(len(x))])


def moments(batches):
    """Rows (pos, part): count, sums and sums of squares of the statistics."""
    total = np.zeros(1 + 2 * STATISTICS)
    for batch in batches:
        x = _matrix(batch)
        total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
    yield pa.record_batch({"pos": pa.array(np.arange(len(total), dtype=np.int32)), "part": pa.array(total)})


def equations(batches, mean, scale):
    """One row: this partition's part of Z'Z and Z'y, as 64-bit floats."""
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for batch in batches:
        y = batch.column(batch.schema.get_field_index("label")).to_numpy().astype(float)
        z = fourier(_matrix(batch), mean, scale)
        total += z.T @ np.column_stack([z, y])
    yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})


def add(batches):
    """Sum of partial sums."""
    total = 0.0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total = total + np.frombuffer(x)
    if not isinstance(total, float):
        yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})


def raw(batches, mean, scale, beta, levels=None):
    """Rows with a score: the ridge's, or its calibrated form where levels are given."""
    for batch in batches:
        s = fourier(_matrix(batch), mean, scale) @ beta
        if levels is not None:
            s = np.clip(np.interp(s, levels[0], levels[1]), 0, 1)
        rest = [c for c in batch.schema.names if c != "x"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(s)], [*rest, "score"])


def isotonic(x: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over bins that ascend by x: (x, frequency), not descending."""
    pools: list[list[float]] = []
    for at, g, c in zip(x.tolist(), good.tolist(), count.tolist(), strict=True):
        pools.append([g, c, at * c, c])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[3] for p in pools]), np.array([p[0] / p[1] for p in pools])


def quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score) of each row; learned from labels of 0 or 1 for which ``usable`` holds."""
    spark = docs.sparkSession
    seen = spool(two_columns(docs, id_col, text_col).mapInArrow(shipped(profile), "doc_id long, x binary"), "statistics")
    ok = labels[label_col].isin(0, 1) & labels[id_col].isNotNull()
    taught = labels.where(ok if usable is None else ok & usable).select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).distinct()
    taught = spool(seen.join(taught, "doc_id").select("x", "label"), "taught")
    total = taught.select("x").mapInArrow(shipped(moments), "pos int, part double").groupBy("pos").agg(F.sum("part").alias("part")).orderBy("pos").toPandas()["part"].to_numpy()
    if not len(total) or not total[0]:
        return seen.select("doc_id", F.lit(0.5).alias("score"))
    n = total[0]
    mean = total[1 : 1 + STATISTICS] / n
    scale = np.sqrt(np.maximum(total[1 + STATISTICS :] / n - mean**2, 1e-8))
    parts, many = taught.mapInArrow(shipped(equations, mean=mean, scale=scale), "part binary"), taught.rdd.getNumPartitions()
    while True:  # a tree: no task adds more than some FAN parts
        many = max(SUMS, -(-many // FAN))
        parts = parts.repartition(many).mapInArrow(shipped(add), "part binary")
        if many == SUMS:
            break
    parts = parts.toArrow()
    system = np.sum([np.frombuffer(x) for x in parts["part"].to_pylist()], axis=0).reshape(FEATURES + 1, FEATURES + 2)
    ridge = np.eye(FEATURES + 1) * RIDGE * n
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(system[:, :-1] + ridge, system[:, -1])
    binned = taught.mapInArrow(shipped(raw, mean=mean, scale=scale, beta=beta), "label int, score double")
    binned = binned.select("label", F.floor(F.least(F.greatest(F.col("score"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2)).alias("bin")).groupBy("bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("bin").toPandas()
    levels = isotonic((binned["bin"].to_numpy() + 0.5) * 2 / BINS, binned["good"].to_numpy().astype(float), binned["n"].to_numpy().astype(float))
    return seen.mapInArrow(shipped(raw, mean=mean, scale=scale, beta=beta, levels=levels), "doc_id long, score double")


def quality_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from rows whose id's crc32 has another remainder."""
    out = quality(docs, labels, remainder(labels["doc_id"], modulus) != held)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
