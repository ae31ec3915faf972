"""The pipeline's stages, each on its own input."""

import re
from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline as pipeline
from vellum.llm import mixing, queries
from vellum.llm.common import table, written

from .test_line_templates import by_hand as lines_by_hand
from .test_ngram_join import by_hand as links_by_hand

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = table(spark, small, "documents")
    more = spark.createDataFrame([(-1, None, "en", "src1", 0), (-2, "123 456", "en", None, 7), (900005, "a copy of five words here", "en", "src2", 1), (900005, "a copy of five words here", "en", "src2", 1)], docs.schema)
    docs = docs.unionByName(more)
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, small), f"test-{name}")
        out[name] = docs
    return out


def test_columns(stages):
    for name, _ in pipeline.STAGES[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_language(stages):
    before, after = (Counter((r["doc_id"], r["text"]) for r in stages[s].collect()) for s in ("documents", "language_id"))
    assert not after - before
    assert all(not re.search(r"[^\W\d_]", t or "") for _, t in before - after)


def test_lines(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["language_id"].collect()]
    want = Counter((k, t) for k, t, _, dropped in lines_by_hand(rows) if not dropped or t)
    assert Counter((r["doc_id"], r["text"]) for r in stages["line_dedup"].collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"].collect())


def test_near_duplicates(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["line_dedup"].collect()]
    part = {k: c for k, _, c in links_by_hand(rows)}
    got = Counter(r["doc_id"] for r in stages["ngram_join"].collect())
    assert set(got) >= set(part.values())
    assert sum(got.values()) == len(set(part.values())) or len(rows) != len(part)
    assert not Counter((r["doc_id"], r["text"]) for r in stages["ngram_join"].collect()) - Counter(rows)


def test_null_ids_and_empty_tables(spark, small):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, "en", "a", 1), (5, text + " x", "en", "a", 1), (3, text + " y", "en", "b", 1), (None, "alone here", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, docs.withColumn("row", docs["lang"]), small).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == [(3, text + " y"), (None, "alone here")]
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0


def test_mix(spark, stages):
    docs = {r["doc_id"]: r for r in stages["ngram_join"].collect()}
    plan = {r["key"]: r for r in mixing.mix(stages["ngram_join"]).collect()}
    words = defaultdict(int)
    for r in stages["mixing"].collect():
        own = WORD.findall(r["text"])
        words[r["doc_id"]] += len(own)
        assert not Counter(own) - Counter(WORD.findall(docs[r["doc_id"]]["text"]))
        assert r["source"] == docs[r["doc_id"]]["source"] and r["n_chars"] == len(r["text"])
        if len(own) == plan[r["doc_id"]]["size"]:
            assert r["text"] == docs[r["doc_id"]]["text"].strip(" \t\n\x0b\x0c\r")
    assert dict(words) == {k: r["taken"] for k, r in plan.items() if r["taken"]}


def test_encoding(stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.public_tokenizer(queries.PIECES))
    want = Counter((r["doc_id"], tuple(lib.encode(r["text"]))) for r in stages["mixing"].collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages["sentencepiece"].collect()) == want
