"""N-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import graph, ngram_join
from vellum.llm.common import discard, table, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def by_hand(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and (sets[i] or j == i)]
        out.append((k, len(sets[i]), min((x for x in same if x is not None), default=None)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["key"], r["n_shingles"], r["component"]) for r in ngram_join.join_components(df).collect()), key=str)


def test_against_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(4000)}" for _ in range(300)]
    chain = [" ".join(base[i : i + 100]) for i in range(0, 200, 6)]  # each links with its next, not with all
    near = []
    for _ in range(60):
        words = list(base)
        for _ in range(rnd.randrange(12)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(10**6)}"
        near.append(" ".join(words))
    odd = [None, "", " \n", "a b", "A  b", "b a", "a b c d", "a b c d e", "a b c d e f", "x", "É x", "é x", " ".join(base * 40)]
    rows += [(10_000 + i, t) for i, t in enumerate(chain + near + odd)] + [(None, "a b"), (7, rows[7][1]), (None, "null only of its own kind here")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(t, k, "x") for k, t in rows], "text string, doc_id long, token string").repartition(5)
    assert found(df) == by_hand(rows)


@pytest.mark.parametrize("heavy", [1, 1 << 20])
def test_order_does_not_change_links(spark, monkeypatch, heavy):
    monkeypatch.setattr(ngram_join, "LEAST_HEAVY", 2)
    monkeypatch.setattr(ngram_join, "MOST_HEAVY", heavy)
    monkeypatch.setattr(ngram_join.global_order, "__defaults__", (heavy,))
    rnd = random.Random(9)
    lines = [" ".join(f"c{rnd.randrange(50)}" for _ in range(12)) for _ in range(6)]
    rows = [(i, " ".join(rnd.sample(lines, 3) + [f"u{rnd.randrange(30)}" for _ in range(rnd.randrange(12))])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df) == by_hand(rows)


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    assert found(spark.createDataFrame([(3, None), (4, "")], "doc_id long, text string")) == [(3, 0, 3), (4, 0, 4)]


def test_components_of_long_paths(spark):
    rnd = random.Random(2)
    nodes = rnd.sample(range(-(10**12), 10**12), 120)
    edges = list(zip(nodes[:70], nodes[1:70], strict=False)) + [(nodes[80], x) for x in nodes[81:]] + [(nodes[0], nodes[0])]
    got = {(r["node"], r["component"]) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, min(nodes[:70])) for x in nodes[:70]} | {(x, min(nodes[80:])) for x in nodes[80:]}


def test_order_puts_heavy_shingles_last_and_cuts_by_frequency():
    hashes, counts = np.array([40, -5, 7, 8], np.int64), np.array([100, 9, 4, 33], np.int64)
    order = ngram_join.Order(hashes, counts, fragments=2)
    values = np.array([1, 9, 7, -5, 8, 40])
    assert order.places(values).tolist() == [0, 0, 1, 2, 3, 4]
    assert order.fragment(values).tolist() == [0, 0, 0, 0, 0, 1]  # 40 alone has half of the frequency
    order = ngram_join.Order(hashes, counts, total=4 * int(counts.sum()), fragments=4)
    assert order.fragment(np.r_[values, -(2**62), 2**62 + 1]).tolist() == [1, 1, 3, 3, 3, 3, 0, 2]


def test_prefixes_follow_the_order(spark):
    order = spark.sparkContext.broadcast(ngram_join.Order(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    text = " ".join(f"w{i}" for i in range(24))
    df = spark.createDataFrame([(text,), (text,), (None,)], "text string").coalesce(1)
    values = ngram_join.sets_of(pa.array([text]))[0]
    light = [r["token"] for r in ngram_join.postings(df, "text", order).collect()]
    assert light == values.tolist()[: ngram_join.prefix_length(20)]
    order = spark.sparkContext.broadcast(ngram_join.Order(values[:18].copy(), np.arange(2, 20)))
    rows = ngram_join.postings(df, "text", order).collect()
    assert [r["token"] for r in rows][:2] == values.tolist()[18:] and [r["pos"] for r in rows] == list(range(6))
    assert [r["token"] for r in rows][2:] == values.tolist()[:4]


def test_group_of_near_copies_makes_few_pairs(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rnd.sample(range(200), rnd.randrange(1, 4)):
            words[at] = f"v{i}-{at}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scanned = ngram_join.first_scan(df, "text", "doc_id")
    order = spark.sparkContext.broadcast(ngram_join.global_order(scanned))
    assert ngram_join.hub_pairs(ngram_join.shared_postings(ngram_join.postings(df, "text", order))).count() < 10 * len(rows)
    assert {x for _, _, x in found(df)} == {0}


def test_written_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    held = spark.range(10_000).repartition(3, "id")
    before = shuffled()
    out = written(held, "shuffled")
    after = shuffled()
    assert not {x for x in after - before if x.endswith(".data")}
    assert out.count() == held.count() == 10_000
    discard(out)
