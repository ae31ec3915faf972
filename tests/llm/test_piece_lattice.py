"""SentencePiece over a lattice: against the library, and Viterbi against all paths."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from vellum.llm import piece_lattice, queries
from vellum.llm.common import table

ODD = [
    None, "", " ", "  lead", "a  b   c", " a\nb\tc  \n\n", "é É ﬁ ½ Ǻ 　x", "▁x y▁", "a\xa0b", "<s> hi </s> <0x0A> <unk>", "\x00a", "日本語 🙂🙂",
    "x" * 3000, " " * 500 + "y", ";\r\n ;\r", "word " * 2000, "İ́ß",
]


@pytest.fixture(scope="module")
def path():
    return queries.public_tokenizer(queries.PIECES)


def test_ids_are_the_library_s(spark, small, path):
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    model = piece_lattice.load(path)
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = piece_lattice.encode(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == lib.encode(texts[r["doc_id"]] or ""), r["doc_id"]
    back = {r["doc_id"]: r["text"] for r in piece_lattice.decode(piece_lattice.encode(docs, model), model).collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in texts.items())
    for r in piece_lattice.digests(docs, model, most=50).collect():
        ids = lib.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_frequent_words_are_folded_in_spark(spark, small, path):
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), piece_lattice.load(path)
    known = piece_lattice.dictionary(table(spark, small, "documents"), model)
    assert len(known) > 1000
    for w, ids in list(known.items())[::7]:
        whole = lib.encode("x" + w.replace("▁", " ") if w[0] == "▁" else "x\n" + w)
        got = np.frombuffer(ids, model.dtype).tolist()
        assert whole[-len(got) :] == got
    few = piece_lattice.dictionary(table(spark, small, "documents"), model, most=100)
    assert 0 < len(few) <= 100 and all(known[w] == x for w, x in few.items())


def unigram(byte_ids=None):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "ba": -3.0, "▁a": -2.2, "abab": -5.0, "▁ab": -4.0, "c": -1.0}
    ids = {p: i + 1 for i, p in enumerate(scores)}
    return piece_lattice.Model(scores, ids, [b"?"] + [p.encode() for p in scores], byte_ids, 0, False)


def all_paths(model, word):
    best = {0: (0.0, ())}
    ways = [[] for _ in range(len(word) + 1)]
    ways[0] = [(0.0, ())]
    for e in range(1, len(word) + 1):
        for s in range(e):
            p = word[s:e]
            x = model.scores.get(p, model.floor if e - s == 1 else None)
            if x is not None:
                ways[e] += [(t + x, path + (p,)) for t, path in ways[s]]
    return max(t for t, _ in ways[-1])


def test_viterbi_finds_the_best_path(spark):
    model = unigram()
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("▁abcz") for _ in range(rnd.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["ids"] for r in piece_lattice.folded(piece_lattice.lattice(df, model), model).collect()}
    names = {i: p for p, i in model.ids.items()}
    for w in words:
        assert got[w] == model.cut(w), w
        total = sum(model.scores[names[i]] if i else model.floor for i in got[w])
        assert total == pytest.approx(all_paths(model, w))


def test_cached_words_are_bounded_within_a_text(monkeypatch, path):
    monkeypatch.setattr(piece_lattice, "MOST_CACHED", 1000)
    model, most = piece_lattice.load(path), [0]

    class Watched(piece_lattice.Model):
        def cut(self, word):
            most[0] = max(most[0], len(encoder.own) + len(getattr(encoder, "older", ())))
            return super().cut(word)

    model.__class__ = Watched
    encoder = piece_lattice.Encoder(model, {})
    texts = [" ".join(f"w{i} a{i % 700}" for i in range(5000)), None, "w4999 a1"]
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [np.frombuffer(x, model.dtype).tolist() for x in encoder.encode(texts)] == [lib.encode(t or "") for t in texts]
    assert 0 < most[0] <= 1000


def test_words_outside_the_dictionary_merge_together(monkeypatch, path):
    model, calls = piece_lattice.load(path), [0]

    class Watched(piece_lattice.Model):
        def cut(self, word):
            calls[0] += 1
            return super().cut(word)

    model.__class__ = Watched
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("aeionrst\u00e9\u00f1") for _ in range(rnd.randint(1, 30))) for _ in range(1000)) for _ in range(5)]
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [np.frombuffer(x, model.dtype).tolist() for x in piece_lattice.Encoder(model, {}).encode(texts)] == [lib.encode(t) for t in texts]
    assert calls[0] < 500


def test_merging_together_gives_what_merging_alone_gives(path):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("▁▁aeiourstné.#日ﬁ🙂İ́\x00") for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    words += [c * k for c in "a▁日🙂" for k in range(1, 50)]
    tied = unigram()
    tied = piece_lattice.Model({p: 0.0 if len(p) == 2 else x for p, x in tied.scores.items()}, tied.ids, tied.surface, None, 0, True)
    short = ["".join(rnd.choice("▁abcz") for _ in range(rnd.randint(1, 12))) for _ in range(1000)]
    for model, given in ((piece_lattice.load(path), words), (tied, short)):
        assert model.cut_all(given) == [np.array(model.cut(w), model.dtype).tobytes() for w in given]
        assert sum(x is not None for x in model.merger.cut(given)) > 100


def test_ids_of_a_batch_are_not_an_object_each(spark, monkeypatch, path):
    monkeypatch.setattr(piece_lattice, "arrow_rows", lambda df, rows, schema: rows)
    text = "a b c d e f g h i j " * 1000
    rows = piece_lattice.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), piece_lattice.load(path))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": [text] * 100})
    tracemalloc.start()
    ids = sum(len(out.column(1).flatten()) for out in rows(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids >= 10**6 and peak < 20 * ids


def test_empty(spark, path):
    model = piece_lattice.load(path)
    assert piece_lattice.encode(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
