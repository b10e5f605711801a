"""The learned operators against plain, slow versions of their methods."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spreadlab.llm import _text as T
from spreadlab.llm import language, quality, toxicity

SF = "/root/testdata/sf0.001"


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, rows, labels


def pooled(points):
    """Least-squares fit that never descends, by the rule of minima over maxima of means; points are (x, y) by x."""
    y = [b for _, b in points]
    sums = np.concatenate([[0], np.cumsum(y)])
    n = len(y)
    return [max(min((sums[b] - sums[a]) / (b - a) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]


def test_quality_is_ridge_on_all_rows_then_isotonic(spark, tables):
    docs, rows, labels = tables
    x = np.concatenate([quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for _, t, _ in rows]).astype(float)
    taught = [k for k, (i, _, _) in enumerate(rows) if i in labels and not held(i, 5, 0) and labels[i].quality is not None]
    y = np.array([labels[rows[k][0]].quality for k in taught], float)
    own = x[taught]
    mean, scale = own.mean(axis=0), np.sqrt(np.maximum((own**2).mean(axis=0) - own.mean(axis=0) ** 2, 1e-8))
    z = quality.fourier(own, mean, scale)
    ridge = np.eye(z.shape[1]) * quality.RIDGE * len(y)
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    every = quality.fourier(x, mean, scale) @ beta
    half = quality.BINS / 2
    bins = np.floor(np.clip(z @ beta, -0.5, 1.5) * half)
    order = np.lexsort((np.arange(len(y)), bins))
    # rows of one bin share their mean first
    means = {b: y[bins == b].mean() for b in set(bins.tolist())}
    fit = pooled([(b, means[b]) for b in bins[order]])
    at = defaultdict(list)
    for b, v in zip(bins[order], fit, strict=True):
        at[round(v, 12)].append((b + 0.5) / half)
    levels = sorted((float(np.mean(p)), v) for v, p in at.items())
    want = np.clip(np.interp(every, [a for a, _ in levels], [b for _, b in levels]), 0, 1)
    got = {r.doc_id: r.score for r in quality.quality_held_out(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert max(abs(got[i] - w) for (i, _, _), w in zip(rows, want, strict=True)) < 1e-6


def test_kernel_is_approximated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, quality.STATISTICS))
    z = quality.fourier(x, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - exact).max() < 0.2


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**20 - 1), max_size=60), st.sampled_from([1, 65534, 65535, 65536, 131071]))
def test_packed_features_come_back(f, gap):
    want = np.array(sorted(f | {gap}), np.int64)
    assert toxicity.unpack(np.frombuffer(toxicity.pack(want), np.uint16)).tolist() == want.tolist()


def ftrl(samples, passes, alpha, beta, l1, l2):
    """Weights by the published rule, feature by feature; None is the intercept, free of the L1 term."""
    z, n = Counter(), Counter()

    def weight(i):
        least = 0.0 if i is None else l1
        return 0.0 if abs(z[i]) <= least else (math.copysign(least, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for y, f in samples:
            w = {i: weight(i) for i in (*f, None)}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity_learns_step_by_step(spark, tables):
    docs, rows, labels = tables
    options = {"bits": 14, "passes": 2, "alpha": 1.0, "beta": 1.0, "l1": 0.5, "l2": 0.01, "least": 3}
    usable = [(i, t) for i, t, _ in rows if i in labels and labels[i].toxic is not None and i % 3]
    turn = {r.i: r.turn for r in spark.createDataFrame([(i,) for i, _ in usable], "i long").select("i", F.xxhash64("i").alias("turn")).collect()}
    sets = []
    for i, t in sorted(usable, key=lambda x: turn[x[0]]):
        f = set()
        for _, _, own, _ in toxicity.features(pa.array([t or ""]), options["bits"]):
            f |= set(own.tolist())
        sets.append((labels[i].toxic, sorted(f)))
    seen = Counter(x for _, f in sets for x in f)
    want = ftrl([(y, [x for x in f if seen[x] >= 3]) for y, f in sets], **{k: v for k, v in options.items() if k not in ("bits", "least")})
    table = spark.read.parquet(f"{SF}/labels.parquet")
    index, weights = toxicity.fit(docs, table, table["doc_id"] % 3 != 0, **options)
    got = {None if i == 1 << 14 else i: w for i, w in zip(index.tolist(), weights.tolist(), strict=True)}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6
    few, _ = toxicity.fit(docs, table, table["doc_id"] % 3 != 0, **options, max_features=2000)
    assert 0 < len(few) < len(index)


def test_features_are_words_pairs_skips_and_stems():
    (_, _, got, row), *_ = toxicity.features(pa.array(["Bad bad dogs run", None, "x"]), 20)

    def h(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return T.spans_hash(raw, np.array([0]), np.array([len(raw)]))

    words = [h(w) for w in ("bad", "bad", "dogs", "run")]
    stems = [T.mix(w + T.M1) for w in words]
    want = [*words, *(T.mix(a * T.M3 + b) for a, b in zip(words[:-1], words[1:], strict=True)), *(T.mix(a * T.M5 + b * T.M4) for a, b in zip(words[:-2], words[2:], strict=True)), *stems, T.mix(stems[0] + np.uint64(1))]
    assert sorted(got[row == 0].tolist()) == sorted(int(x[0] & np.uint64(2**20 - 1)) for x in want)
    assert (row == 1).sum() == 0 and (row == 2).sum() == 2


def words_of(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isascii() and not c.isalpha():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def test_language_backs_off_from_words_to_grams(spark, tables):
    docs, rows, _ = tables
    counts = Counter((lang, w) for i, t, lang in rows if lang and not held(i, 4, 2) for w in words_of(t))
    langs = sorted({lang for lang, _ in counts})

    def logs(weights):
        keys, total = {k for _, k in weights}, Counter()
        for (lang, _), x in weights.items():
            total[lang] += x
        return {k: [math.log((weights.get((lang, k), 0) + 0.1) / (total[lang] + 0.1 * len(keys))) for lang in langs] for k in keys}

    known, grams = logs(counts), []
    for n in range(1, language.LONGEST + 1):
        weights = Counter()
        for (lang, w), x in counts.items():
            marked = f"\x02{w}\x03"
            for k in range(len(marked) - n + 1):
                weights[lang, marked[k : k + n]] += 1 + math.log(x)
        grams.append(logs(weights))

    def score(w):
        if w in known:
            return known[w]
        marked, out = f"\x02{w}\x03", [0.0] * len(langs)
        for k in range(len(marked)):
            for n in range(language.LONGEST, 0, -1):
                own = grams[n - 1].get(marked[k : k + n]) if k + n <= len(marked) else None
                if own:
                    out = [a + b / 3 for a, b in zip(out, own, strict=True)]
                    break
        return out

    got = {r.doc_id: (r.lang_pred, r.score) for r in language.language_held_out(docs).collect()}
    unseen = 0
    for i, t, _ in rows:
        total = [0.0] * len(langs)
        for w in words_of(t):
            unseen += w not in known
            total = [a + b for a, b in zip(total, score(w), strict=True)]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        if any(c.isalpha() for c in t or ""):
            assert got[i][0] == langs[best]
            assert abs(got[i][1] - 1 / sum(math.exp(max(x - total[best], -700)) for x in total)) < 0.01
        else:
            assert got[i] == ("und", 0.0)
    assert unseen > 100
    small = language.identify(docs, language.fit(docs, ~F.isnull("lang"), max_words=50, max_grams=200))
    assert small.count() == len(rows)
