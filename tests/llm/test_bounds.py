"""Texts and groups that once stopped a task: hostile runs, long hubs, rows without ids, repetitive partitions."""

import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spreadlab.llm import bpe, chat_format, jaccard, language, media, quality, secret_scan

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("text", [b"eyJ" * 1_000_000, b"eyJa." * 600_000, b"eyJa.eyJ" * 300_000 + b"!", b"eyJ" * 500_000 + b".eyJ" + b"eyJ" * 500_000, b"password " * 300_000, b"AKIA" * 600_000])
def test_secrets_take_linear_time(text):
    keywords = secret_scan.automaton()
    began = time.process_time()
    secret_scan.spans(text, keywords)
    assert time.process_time() - began < 10  # was hours for some


def test_tokens_inside_failed_runs_are_still_found():
    own = b"eyJhbGciOiJub25lIn0.eyJhIjoxfQ.c2ln"
    keywords = secret_scan.automaton()
    for before in (b"eyJx ", b"eyJeyJeyJ!", b"eyJa.eyJb ", b"eyJa.eyJb.", b"eyj"):
        found = [(a, b) for a, k, b in secret_scan.spans(before + own, keywords) if secret_scan.KINDS[k] == "jwt"]
        slow, at = [], 0
        while m := secret_scan.EXPRESSIONS["jwt"].search(before + own, at):
            at = m.end()
            if secret_scan.header_holds(m[0]):
                slow.append(m.span())
        assert found == slow


def test_long_hub_travels_by_bytes():
    text = " ".join(f"w{i}" for i in range(1_000_000))
    targets = [{"hub": k, "salt": 0} for k in range(400)]
    g, bounds = jaccard.T.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 5)
    fp = jaccard.class_of(g, bounds).view(np.int64)
    batch = pa.record_batch({"fp": pa.array(fp), "part": pa.array([0], pa.int32()), "targets": pa.array([targets], pa.list_(pa.struct({"hub": pa.int64(), "salt": pa.int64()}))), "text": pa.array([text])})
    seen, most = [], 0
    for out in jaccard.send_texts([batch], 5):
        seen += out.column(0).to_pylist()
        most = max(most, out.num_rows)
    assert seen == list(range(400))
    assert most == 1


def test_stars_of_long_and_short_texts_agree(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TARGETS", 2)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join([*words[: 2990 - i], *(f"x{i}y{k}" for k in range(i))])) for i in range(40)] + [(100 + i, f"alone {i} " * 3) for i in range(10)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(got[i] == 0 for i in range(40))
    assert len({got[100 + i] for i in range(10)}) == 10


def test_turns_without_conversation_stay_apart(spark):
    turns = [(None, k % 3, f"u{k % 2}", f"secret of {k}") for k in range(3000)] + [(None, 0, "system", "x"), (None, None, None, None), ("a", 0, "u0", "hi"), ("a", 1, "u1", "ho")]
    got = chat_format.perspectives(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")).collect()
    lone = [r for r in got if r.conv_id is None]
    assert len(got) == 3003
    assert len(lone) == 3001
    assert all(r.n_turns == r.n_own == 1 for r in lone)
    assert sorted(r.text for r in lone if r.perspective == "u0") == sorted(f"<|im_start|>assistant\nsecret of {k}<|im_end|>\n" for k in range(0, 3000, 2))


@pytest.mark.parametrize("most", [1, 50, 1 << 24])
def test_repetitive_partitions_close_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(bpe.dictionaries, "__defaults__", (most,))
    rows = [(i, "same words again " * (i % 40)) for i in range(300)]
    t = Tokenizer.from_file(WORD)
    got = {r.doc_id: r.n_tokens for r in bpe.bpe_digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORD).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows}


def test_partitions_without_words(spark):
    rows = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.n_tokens) for r in bpe.bpe_digest(rows, WORD).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]


def test_language_sample_has_a_bound_of_bytes(spark):
    rows = [(i, lang, f"{word} " * 20) for i, (lang, word) in enumerate([("en", "the and"), ("de", "der und")] * 10)]
    rows += [(50, "en", f"{'x' * 50} " * 50_000)] + [(0, "en", rows[0][2])] * 500
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    langs, (keys, _), _ = language.fit(docs, F.lit(True), max_bytes=10_000)
    assert langs == ["de", "en"]
    assert len(keys) == 4  # the long text is passed over
    assert language.fit(docs, F.lit(True), max_bytes=0) is None
    twice = language.fit(docs.where("doc_id < 20").distinct(), F.lit(True))
    once = language.fit(docs.where("doc_id < 20"), F.lit(True))
    assert all(np.array_equal(a, b) for a, b in zip(twice[1], once[1], strict=True))


def test_sums_by_a_tree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    monkeypatch.setattr(quality, "SUMS", 1)
    monkeypatch.setattr(quality, "FAN", 2)
    got = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    assert max(abs(got[i] - x) for i, x in want.items()) < 1e-9


def test_ranges_have_a_bound(spark, tmp_path, monkeypatch):
    docs = spark.range(200).selectExpr("id as doc_id", "repeat('abc', 500) as text").coalesce(2)
    media.write_media(docs, f"file://{tmp_path}/m")
    monkeypatch.setattr(media, "RANGES", 3)
    assert 1 < len(media.plan({"path": f"file://{tmp_path}/m", "rangebytes": "1000"})) <= 5
