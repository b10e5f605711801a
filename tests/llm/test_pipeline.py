"""Each stage of the pipeline on a small table, against brute force on its own input."""

import re

import corpus_pipeline as P
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute
from tokenizers import Tokenizer

from spreadlab.llm import secret_scan, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in P.STAGES:
        docs = P.spool(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == stages["input"].columns


def test_toxic_documents_go(spark, stages):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    gone = set(ids(stages["input"])) - set(ids(stages["toxicity"]))
    assert not gone & clean and (gone & toxic or not toxic)


def test_toxicity_is_decided_by_the_score(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(stages["input"], labels, F.lit(True))
    scores = {r.doc_id: r.score for r in toxicity.score(stages["input"], model).collect()}
    assert ids(stages["toxicity"]) == sorted(i for i, x in scores.items() if x < 0.7)
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    caught = [scores[i] >= 0.7 for i, y in truth.items() if y == 1 and i in scores]
    assert sum(caught) >= 0.8 * len(caught)


ODD = [(None, None), (None, "no id, some words of its own that nobody else has"), (None, "no id, some words of its own that nobody else has"), (7, None), (7, ""), (8, "twice the same words in one row and in another"), (8, "twice the same words in one row and in another"), (9, "é token=abcdefabcdef0 " + "long " * 50_000)]


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_every_stage_takes_odd_rows(spark, rows, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, fp long"
    spark.createDataFrame([(i, t, None, None, None, "k", 1, None) for i, t in rows], columns).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    keeps = {"near_duplicates": 1}  # one of the two equal rows of id 8 goes; rows without id stay
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == max(0, len(rows) - keeps.get(name, 0)), name
        if name != "bpe":
            assert out.columns == docs.columns
        else:
            assert out.columns == [c for c in docs.columns if c != "text"] + ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
            assert out.where("doc_id = 9 and n_tokens >= 50000").count() == min(1, len(rows))


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    assert ids(stages["near_duplicates"]) == sorted({c for _, c in brute(rows).values()})


def test_contaminated_documents_go(spark, stages):
    def words(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[a : a + 13]) for a in range(max(len(w) - 12, 1))}
    kept = []
    for r in stages["near_duplicates"].collect():
        w, hit = words(r.text), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    hit |= set(range(a, a + size))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(r.doc_id)
    assert ids(stages["decontaminate"]) == sorted(kept)


def test_secrets_are_masked_and_texts_encoded(stages):
    before = {r.doc_id: r.text for r in stages["decontaminate"].collect()}
    after = {r.doc_id: r.text for r in stages["secrets"].collect()}
    assert before.keys() == after.keys()
    assert not [x for x in after.values() if re.search(r"[0-9a-f]{16,}", x)]
    keywords = secret_scan.automaton()
    for i, x in before.items():
        raw, out, end = x.encode(), b"", 0
        for a, _, b in secret_scan.spans(raw, keywords):
            if a >= end:
                out += raw[end:a] + b"[SECRET]"
            end = max(end, b)
        assert after[i] == (out + raw[end:]).decode()
    assert sum(x != after[i] for i, x in before.items()) > 0
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = stages["bpe"].collect()
    assert {r.doc_id for r in rows} == after.keys()
    for r in rows:
        assert r.token_ids == t.encode(after[r.doc_id], add_special_tokens=False).ids


def test_the_session_is_left_as_it_was(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
    assert spark.conf.get(setting) == before
