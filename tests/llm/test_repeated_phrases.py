"""Removal of repeated passages against brute force."""

import hashlib
import random
import re

import pytest

from vellum.llm import repeated_phrases
from vellum.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, window=13):
    first = {}
    docs = [(k if k is not None else float("inf"), WORD.findall(t or ""), k) for k, t in rows]
    for k, words, _ in docs:
        for i in range(len(words) - window + 1):
            x = tuple(words[i : i + window])
            first[x] = min(first.get(x, k), k)
    out = []
    for k, words, key in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < k:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["key"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeated_phrases.digests(df).collect()), key=str)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_against_brute_force(spark, small, monkeypatch, block):
    monkeypatch.setattr(repeated_phrases, "BLOCK", block)
    monkeypatch.setattr(repeated_phrases, "SHARD_PHRASES", 50)
    rnd = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    passage = [f"p{i}" for i in range(40)]
    for i in range(60):
        lo = rnd.randrange(30)
        words = [f"x{rnd.randrange(9)}" for _ in range(rnd.randrange(20))] + passage[lo : lo + rnd.randrange(10, 16)] + ["q"] * rnd.randrange(30)
        rows.append((1000 + rnd.randrange(70), " ".join(words)))
    rows += [(None, " ".join(passage)), (None, " ".join(passage)), (3, rows[3][1]), (9000, None), (9001, ""), (9002, " a\x0bb c ")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(t, "z", k) for k, t in rows], "text string, doc string, doc_id long").repartition(4)
    assert found(df) == by_hand(rows)


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    assert [r["text"] for r in repeated_phrases.remove(spark.createDataFrame([(1, " a\nb ")], "doc_id long, text string")).collect()] == ["a b"]
