"""Filter audit, rule ledger and importance resampling against brute force, with odd rows, repeats, nulls and hot copies."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from spreadlab.llm import filter_audit, importance, quality_rules

KIND = "doc_id long, text string, lang string, part string, A int, b int, w string"


def texts(n=260, seed=1):
    rng = random.Random(seed)
    words = ["the", "Of", "AND", "naïve", "日本", "x" * 70, "a$b", "12", "–", "q|", "end.", "\U0001f600"]
    out = []
    for i in range(n):
        own = [rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.choice([0, 1, 3, 19, 20, 60, 120, 200]))]
        out.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t ", " \n\n"]) for w in own), rng.choice(["en", "de", "", None])))
    out += [(n + k, "same copy of a text " * 30, "en") for k in range(150)]  # a hot group
    out += [(n + 200, None, "en"), (n + 201, "", None), (None, "same copy of a text " * 30, "en"), (None, None, None), (5, out[5][1], "en"), (n + 202, "long words " * 60000, "fr"), (n + 203, "\n\n \n", "fr"), (7, "another text of an id", "de")]
    return out


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "w") for r in rows], KIND).repartition(5).cache()


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_audit_walks_every_order(spark, docs, rows):
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 400, 2)] + [(0, 1, 1), (2, None, None), (None, 1, 1)]
    got = filter_audit.audit(filter_audit.with_labels(filter_audit.document_flags(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    flagged = []
    for i, t, lang in rows:
        w, t = split(t), t or ""
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and least.get(t, i) < i,
        }
        flagged.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    want, shapley = {}, Counter()
    for part in {p for p, *_ in flagged}:
        own = [x[1:] for x in flagged if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                want[part, "".join(order), k + 1] = (len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone))
    assert len(got) == len(want) == 600 * len({p for p, *_ in flagged})
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_audit_of_other_filters(spark):
    flagged = spark.createDataFrame([("x", True, False, 1, 0), ("x", True, True, 0, 1), ("x", False, False, 1, 1)], "part string, p boolean, q boolean, good int, toxic int")
    got = {(r.filter_order, r.step): r for r in filter_audit.audit(flagged, ("p", "q")).collect()}
    assert {k: (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for k, r in got.items()} == {("pq", 1): (1, 2, 0, 1, 3), ("pq", 2): (1, 0, 1, 0, 1), ("qp", 1): (2, 1, 0, 0, 1), ("qp", 2): (1, 1, 1, 1, 3)}
    assert filter_audit.audit(flagged.limit(0), ("p", "q")).count() == 0


def measures(t):
    w, lines = split(t), [x for x in (t or "").split("\n") if split(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    letters = re.compile(r"[A-Za-z]|[^\x00-\x7F]")
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside), len(lines), sum(bool(letters.search(x)) for x in w), sum(len(x.encode()) >= 64 for x in w))


def failed(m):
    n, chars, symbols, dup, repeat, lines, letters, long = m
    return {
        "few_words": n < 50,
        "repeated_windows": 100 * repeat > 50 * n,
        "short_words": 0 < n and chars < 2 * n,
        "overlong_words": chars > 15 * n,
        "symbols": 10 * symbols > n,
        "repeated_lines": 10 * dup > 3 * lines,
        "few_letters": 10 * letters < 6 * n,
        "long_words": 10 * long > n,
    }


def test_ledger_measures_whole_texts(docs, rows):
    got = sorted(tuple(r) for r in quality_rules.ledger(docs).select(F.coalesce("doc_id", F.lit(-1)), *quality_rules.MEASURES, "bits").collect())
    want = []
    for i, t, _ in rows:
        m = measures(t)
        bits = sum(1 << k for k, name in enumerate(quality_rules.RULES) if failed(m)[name])
        want.append((-1 if i is None else i, *m, bits))
    assert got == sorted(want)


def test_policies_and_ablations(docs, rows):
    entries = quality_rules.ledger(docs)
    every = [{k for k, v in failed(measures(t)).items() if v} for _, t, _ in rows]
    for version, rules in quality_rules.POLICIES.items():
        own = quality_rules.verdicts(entries, version).collect()
        assert sum(r.kept for r in own) == sum(not x & {*rules, *quality_rules.BASE} for x in every)
        assert sum(r.base_failed for r in own) == sum(bool(x & set(quality_rules.BASE)) for x in every)
    got = {(r.version, r.rule): tuple(r)[2:] for r in quality_rules.ablations(entries).collect()}
    want = {}
    for version, rules in quality_rules.POLICIES.items():
        for rule in rules:
            others = set(rules) - {rule}
            want[version, rule] = (sum(rule in x for x in every), sum(x & set(rules) == {rule} for x in every), sum(not x & set(rules) for x in every), sum(not x & others for x in every))
    assert got == want


def test_clean_keeps_rows_and_columns(docs, rows):
    kept = quality_rules.clean(docs)
    assert kept.schema == docs.schema
    assert kept.count() == sum(not any(failed(measures(t)).values()) for _, t, _ in rows)
    assert quality_rules.clean(docs.limit(0)).count() == quality_rules.ledger(docs.limit(0)).count() == quality_rules.ablations(quality_rules.ledger(docs.limit(0))).count() == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(t, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    return len(w), [zlib.crc32(x.encode()) % n for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]


@pytest.mark.parametrize(("share", "least", "n"), [(25, 20, 10_000), (100, 1, 50), (7, 0, 300)])
def test_draws_by_weight_and_noise(spark, docs, rows, share, least, n):
    target = ["The naïve end. of 日本 AND the", None, "", "the the THE naïve"]
    s, t = Counter(), Counter()
    for x in rows:
        s.update(buckets(x[1], n)[1])
    for x in target:
        t.update(buckets(x, n)[1])
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (s.total() + n)) / ((s[b] + 1.0) * (t.total() + n)))) for b in range(n)]
    want = []
    for i, text, _ in rows:
        words, b = buckets(text, n)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, words, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in want if r[1] >= least)
    most = share * len(able) // 100
    out = importance.importance(docs, spark.createDataFrame([(x,) for x in target], "text string"), share=share, least_words=least, buckets=n).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in out) == Counter(map(tuple, want))
    drawn = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, most + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in drawn] == able[:most]


def test_resample_gives_the_rows_drawn(spark, docs):
    target = spark.createDataFrame([("the naïve end",)], "text string")
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = sorted(r.doc_id for r in importance.importance(once, target).where("rank is not null").collect())
    got = importance.resample(once, target)
    assert got.schema.names == docs.schema.names
    assert sorted(r.doc_id for r in got.collect()) == ids
    assert importance.resample(docs.limit(0), target).count() == importance.importance(docs.limit(0), target).count() == 0
    assert importance.importance(docs, target.limit(0)).count() == docs.count()
