"""Mixing, chat formatting, exact dedup, token output, quality rules, language ID."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import chat_format, exact_dedup, language_id, mixing, quality_rules, queries, token_output
from vellum.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, kept string"


def odd_docs(spark, rows=None):
    rows = rows if rows is not None else [
        (1, None, "en", "a", "x"), (2, "", "en", None, "x"), (3, "one two three", None, "a", None), (3, "one two three", None, "a", None),
        (None, "null id", "en", "b", None), (4, "w " * 30000, "en", None, "x"), (5, " \t\n\x0b\x0c\r", None, "b", None), (6, "onetwo  three", "de", "a", None),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# mixing


def test_targets_stop_at_twice_the_size():
    out = mixing.targets([100, 100, 1000], [5, 2, 1], 1.5, 2)
    assert out == [200.0, 200.0, 1400.0]
    assert sum(mixing.targets([10, 90, 400, 7], [5, 2, 1, 5], 1.5, 2)) == pytest.approx(1.5 * 507)


def test_sainte_lague_is_by_highest_quotients():
    rnd = random.Random(1)
    for _ in range(50):
        votes = [rnd.choice([rnd.randint(1, 1000), rnd.random()]) for _ in range(rnd.randint(1, 120))]
        seats = rnd.randint(0, 300)
        plain = [0] * len(votes)
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))
            plain[i] += 1
        assert mixing.sainte_lague(votes, seats) == plain


def test_many_small_parties():
    assert mixing.sainte_lague([1000] + [0.6] * 100, 1060) == [960] + [1] * 100
    assert mixing.sainte_lague([1, 1], 10, [2, 3]) == [2, 3] and mixing.sainte_lague([0, 0], 3) == [0, 0] and mixing.sainte_lague([], 3) == []


def test_classes_of_equal_parties(spark):
    rnd = random.Random(8)
    for _ in range(40):
        blocks = sorted(rnd.choice([3, 4, 9, 10, 27]) for _ in range(rnd.randint(1, 60)))
        seats = rnd.randint(0, 2 * sum(blocks))
        kinds = sorted(set(blocks))
        base, extra = mixing.class_seats(kinds, [blocks.count(k) for k in kinds], seats)
        got = [base[kinds.index(b)] + (blocks[:i].count(b) < extra[kinds.index(b)]) for i, b in enumerate(blocks)]
        assert got == mixing.sainte_lague(blocks, seats)
    rows = [(s, i, 10 * b, b, n) for s, n, own in (("a", 7, [1, 1, 1, 2]), (None, 5, [4, 3]), ("b", 0, [1])) for i, b in enumerate(own)]
    df = spark.createDataFrame(rows, "source string, shard long, words long, blocks long, seats long")
    got = {(r["source"], r["shard"]): r["quota"] for r in mixing.shard_quotas(df).collect()}
    want = {("a", 0): 2, ("a", 1): 1, ("a", 2): 1, ("a", 3): 3, (None, 0): 3, (None, 1): 2, ("b", 0): 0}
    assert got == want


@pytest.mark.parametrize("shard_words", [1 << 20, 3000])
def test_mix_comes_near_its_targets(spark, small, shard_words):
    docs = table(spark, small, "documents")
    rows = mixing.mix(docs, shard_words=shard_words, block_words=32).collect()
    again = mixing.mix(docs, shard_words=shard_words, block_words=32).collect()
    assert sorted((r["key"], r["taken"]) for r in rows) == sorted((r["key"], r["taken"]) for r in again)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    taken = Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["key"]]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum((p["hi"] - p["lo"]) * p["times"] for p in r["pieces"])
        taken[r["source"]] += r["taken"]
    for source, target in {(r["source"], r["target"]) for r in rows}:
        assert abs(taken[source] - target) <= 64
    assert len(rows) == len(texts)


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(odd_docs(spark)).collect()
    assert len(rows) == 8
    assert {r["source"] for r in rows if r["size"] == 30000} == {None}
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty(spark)).count() == 0


# chat


def test_chat_of_odd_rows(spark):
    P = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
    rows = [
        (1, 0, "user", [("text", "see <|image|> & &lt;| ", None, None), ("image", None, "a.png", 256), ("audio", "x", "b.wav", None)]),
        (1, 1, "assistant", [("text", "<|im_end|>\n", None, None), (None, "tail", None, None)]),
        (1, 1, "assistant", None),
        (2, None, "ro\nle", [("text", None, None, None)]),
        (None, 0, None, [("document", None, None, 7)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {P}")
    out = {r["conv"]: r for r in chat_format.format_chat(df).collect()}
    one = out[1]
    assert one["n_turns"] == 3 and one["expanded_tokens"] == 257
    assert [(a["kind"], a["ref"], a["tokens"], a["place"]) for a in one["attachments"]] == [("image", "a.png", 256, 0), ("audio", "b.wav", 1, 1)]
    assert "see &lt;|image|> &amp; &amp;lt;| <|image|><|audio|><|im_end|>" in one["formatted"]
    masked = [one["formatted"][s["start"] : s["end"]] for s in one["loss_spans"]]
    assert sorted(masked) == ["", "&lt;|im_end|>\ntail"]
    back = chat_format.format_chat(df).select("conv", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.lost(F.col("formatted"), F.col("loss_spans")).alias("lost"))
    back = {r["conv"]: r for r in back.collect()}
    assert back[1]["lost"] == "<|im_end|>\ntail"
    assert [t["role"] for t in back[2]["t"]] == ["ro\nle"]
    assert out[None]["formatted"] == "<|im_start|>\n<|document|><|im_end|>\n"
    assert chat_format.format_chat(df.limit(0)).count() == 0


# exact dedup


def test_fingerprints_compose():
    rnd = random.Random(3)
    data = bytes(rnd.randrange(256) for _ in range(3 * exact_dedup.CHUNK + 17))
    plain = tuple(sum(b * pow(p, len(data[:2000]) - 1 - i, exact_dedup.PRIME) for i, b in enumerate(data[:2000])) % exact_dedup.PRIME for p in exact_dedup.POINTS)
    assert exact_dedup.fingerprint(data[:2000]) == plain
    for cut in (0, 1, 1000, exact_dedup.CHUNK, len(data)):
        assert exact_dedup.combine(exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:]), len(data) - cut) == exact_dedup.fingerprint(data)


def by_hand(rows):
    groups = defaultdict(list)
    for k, t in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), k is None, k or 0))
    rows = [(None if n else k, None if min(g)[1] else min(g)[2], len(g), hashlib.sha256(x.encode()).hexdigest()) for x, g in groups.items() for _, n, k in g]
    return sorted(rows, key=str)


def test_dedup_of_odd_rows(spark):
    df = odd_docs(spark)
    got = sorted([(r["key"], r["keep_key"], r["group_size"], r["sha"]) for r in exact_dedup.dedup(df).collect()], key=str)
    assert got == by_hand([(r["doc_id"], r["text"]) for r in df.collect()])
    assert exact_dedup.dedup(empty(spark)).count() == 0


def test_equal_fingerprints_of_other_texts_are_split(spark):
    """At point 0 a text's last byte is its fingerprint, so that most texts of one length collide."""
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 6))) + "a") for i in range(300)] + [(None, "ab a"), (None, "a")]
    rows += [(1000 + i, "x" * (exact_dedup.CHUNK + 50) + "yz"[i % 2] + "x") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = exact_dedup.fingerprints(df, points=(0, 0)).groupBy("fp1", "fp2", "bytes").count()
    assert exact_dedup.conflicts(df, groups, points=(0, 0)).count() > 3
    got = sorted([(r["key"], r["keep_key"], r["group_size"], r["sha"]) for r in exact_dedup.dedup(df, points=(0, 0)).collect()], key=str)
    assert got == by_hand(rows)


def test_huge_texts_are_hashed_by_segments(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("aé \n中") for _ in range(n)) for n in (1, 40, 41, 99, 100, 101, 350)] + [" " * 60, None, ""]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(3, texts[3]), (None, texts[4]), (50, (texts[6]).replace(" ", "\t"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain, cut = ([tuple(r) for r in exact_dedup.fingerprints(df, huge=h, segment=9).collect()] for h in (1 << 20, 40))
    assert sorted(plain, key=str) == sorted(cut, key=str)
    got = sorted([(r["key"], r["keep_key"], r["group_size"], r["sha"]) for r in exact_dedup.dedup(df, huge=40, segment=9).collect()], key=str)
    assert got == by_hand(rows)


# token output


def test_records_round_trip(spark, small):
    from tokenizers import Tokenizer

    path = queries.public_tokenizer(queries.TOKENIZER)
    assert token_output.splits_at_space(path)
    assert not token_output.splits_at_space(queries.public_tokenizer("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(path)
    more = spark.createDataFrame([(-5, None), (-4, ""), (None, "İstanbul ΑΣ ΣΑΣ <|endoftext|> it 's x<|endoftext|>y é ́a b c\x1cd"), (10**6, "A" * 5000), (10**6, "b")], "doc_id long, text string")
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(more)
    where, manifest = token_output.write_records(docs, path, 2)
    got = token_output.read_records(where, manifest).collect()
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, lib.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()))
    got.sort(key=lambda r: r["start"])
    assert [(r["key"] is None, r["key"] or 0) for r in got] == [x[:2] for x in want]
    assert sorted((r["key"] is None, r["key"] or 0, r["ids"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"])
    digests = {(r["key"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_output.read_digests(where, manifest).collect()}
    assert all(digests[r["key"], r["start"]] == (len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got)
    fs, root = token_output.filesystem(where)
    one = manifest.first()
    index = token_output.read_index(fs.open_input_stream(f"{root}/{one['file']}.idx").read())
    with fs.open_input_file(f"{root}/{one['file']}.rec") as f:
        for at, n in index[::-1].tolist():
            assert len(token_output.read_record(f, at)[1]) == n
        data = bytearray(fs.open_input_stream(f"{root}/{one['file']}.rec").read())
    data[30] ^= 1
    import io

    with pytest.raises(ValueError):
        list(token_output.records(io.BytesIO(bytes(data))))


def test_latin_words_are_encoded_by_parts(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.public_tokenizer(queries.TOKENIZER)
    lib, enc = Tokenizer.from_file(path), token_output.Encoder(path, True)
    rnd, apart = random.Random(4), []
    words = ["".join(rnd.choice("aeEInsÑñéÉÄßÿÐ'.#7²½ªºİıſƒǅɏ¿»µ×") for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    words += [chr(c) for c in range(0xA1, 0x250)] + ["é" + chr(c) + "'s" for c in range(0xA1, 0x250)]
    odd = ["e\u0301", "ΑΣ", "日本", "é<|endoftext|>ñ", "<|EndOfText|>", "a\xa0b", "x\x1cy", "é\u200d"]
    monkeypatch.setattr(enc, "_encode_words", lambda given, f=enc._encode_words: (apart.extend(given), f(given))[1])
    texts = [" ".join(words), " ".join(odd), "é"]
    got = enc.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(odd) <= set(apart) and len(set(apart)) < len(set(words)) / 2 and "éŒ's" not in apart and "é" not in apart


def test_no_documents_no_files(spark):
    where, manifest = token_output.write_records(empty(spark), queries.public_tokenizer(queries.TOKENIZER), 2)
    assert token_output.read_digests(where, manifest).count() == 0


# quality rules


def repeats_by_hand(words, window=8):
    seen = defaultdict(list)
    for i in range(len(words) - window + 1):
        seen[tuple(words[i : i + window])].append(i)
    cover, longest = set(), 0
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                cover.update(range(i, i + window))
            for a, b in zip(at, at[1:]) if len(at) > 60 else [(a, b) for a in at for b in at if a < b]:
                n = window
                while b + n < len(words) and words[a + n] == words[b + n]:
                    n += 1
                longest = max(longest, n)
    return len(cover), longest


def test_repeats_against_brute_force():
    rnd = random.Random(5)
    texts = []
    for n in (0, 1, 7, 8, 9, 16, 40, 200, 900):
        for kinds in (1, 2, 3, 50):
            words = [rnd.choice("abcdefghij") * rnd.randint(1, 1 + kinds // 10) if kinds > 3 else "xyz"[rnd.randrange(kinds)] for _ in range(n)]
            if n >= 40 and kinds > 3:
                words = words + words[5:30] + ["q"] + words[5:30]
            texts.append(" ".join(words))
    found = quality_rules.measure([t.encode() for t in texts] + [None])
    for t, m in zip(texts, found):
        cover, longest = repeats_by_hand(t.split())
        assert (m[4], m[6]) == (cover, longest), t[:80]
    assert found[-1] == (0,) * 7


def test_quality_against_plain_rules(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text").where("doc_id is not null and doc_id != 3"))
    rows = quality_rules.rate(docs).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    left = Counter()
    for (k, t), n in texts.items():
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = repeats_by_hand(words)[0] if len(words) < 25000 else len(words)
        left[k, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(words) < 20 or 100 * rep > 30 * len(words)] += n
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == left
    assert quality_rules.rate(empty(spark)).count() == 0


def test_each_limit_rejects_what_the_base_rules_pass():
    fresh = iter(range(100_000))
    new = lambda n: [f"w{next(fresh):06}" for _ in range(n)]
    a, passage = new(12), new(60)
    wide = new(40) + [w for _ in range(8) for w in [*a, *new(40)]] + new(10)
    long = passage + new(800) + passage + new(80)
    pasted = new(500) + (x := new(1400)) + new(3000) + x + new(3700)
    clean = new(300) + a + new(300) + a
    found = dict(zip(("wide", "long", "pasted", "clean"), quality_rules.measure([" ".join(t).encode() for t in (wide, long, pasted, clean)])))
    assert len(pasted) == 10_000 and found["pasted"][6] == 1400
    cover = {k: 100 * m[5] / m[1] for k, m in found.items()}
    far = {k: m[6] >= quality_rules.LONG_WORDS and 100 * m[6] > quality_rules.MAX_LONGEST * m[0] for k, m in found.items()}
    assert cover["wide"] > quality_rules.MAX_COVERED and not far["wide"]
    assert cover["long"] <= quality_rules.MAX_COVERED and far["long"]
    assert {k: quality_rules.judge(m) for k, m in found.items()} == {"wide": (False, False), "long": (False, False), "pasted": (False, False), "clean": (False, True)}


# language ID


def test_language_held_out_accuracy(spark):
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    held = rows.where("held_out").join(docs, "doc_id")
    n, right = held.count(), held.where("lang = lang_pred").count()
    assert n > 200 and right / n > 0.97
    assert {r["held_out"] for r in rows.where("doc_id in (1, 2)").select("held_out").collect()} == {zlib.crc32(b"1") % 3 == 1, zlib.crc32(b"2") % 3 == 1}


def test_language_of_odd_rows(spark):
    df = odd_docs(spark)
    model = language_id.fit(df, per_lang=10)
    got = [(r["key"], r["lang_pred"], r["score"]) for r in language_id.identify(df.withColumnRenamed("doc_id", "key"), model, keep=("key",)).collect()]
    assert sum(x[1] == "und" for x in got) == 3 and all(0 <= x[2] <= 1 for x in got)
    none = language_id.fit(empty(spark))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


def test_long_texts_are_scored_whole(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abc abd " * 50, "x"), (2, "xyz xyw " * 50, "y")], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    text = ("abc " * 300) + ("xyz " * 250)
    whole = model.scores(["abd", text, "", "x"])
    monkeypatch.setattr(language_id, "STEP", 101)
    assert np.allclose(model.scores(["abd", text, "", "x"]), whole)


def test_scores_are_those_of_plain_naive_bayes(spark):
    rows = [(1, "Ab c", "x"), (2, "abd abd", "x"), (3, "xyz é", "y"), (4, None, "y"), (5, "no label", None), (6, "b", "z")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), smoothing=0.5)
    assert model.langs == ("x", "y", "z")

    def buckets(text):
        return Counter(b for n in (1, 2, 3) for i in range(len(text) - n + 1) for b in language_id.grams(language_id.points_of(text[i : i + n]))[-1:].tolist())

    texts = ["abc xyz", "É", "b"]
    for k, x in enumerate(model.langs):
        own = sum((buckets(t) for _, t, y in rows if y == x and t), Counter())
        n = sum(own.values()) + 0.5 * language_id.BUCKETS
        prior = sum(y == x and t is not None for _, t, y in rows) / 4
        for t, s in zip(texts, model.scores(texts)):
            assert s[k] == pytest.approx(np.log(prior) + sum(c * np.log((own[b] + 0.5) / n) for b, c in buckets(t).items()), rel=1e-5)


def test_texts_without_letters_and_ties(spark):
    rows = [(1, "abc", "q"), (2, "abc", "p")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = model.predict(["² ½ Ⅷ ① 12 _", "ª", "abc", "", None, "中"])
    assert [x for x, _ in found] == ["und", "p", "p", "und", "und", "p"]  # equal scores: the first in order
    assert found[0][1] == 0.0 and found[2][1] == pytest.approx(0.5)


def test_kept_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "abc " * 30, "x", "k", "s")], "doc_id long, text string, lang_pred string, kept string, Score string")
    model = language_id.fit(df, lang="kept")
    out = language_id.identify(df, model, keep=("doc_id", "lang_pred", "Score"))
    assert out.columns == ["doc_id", "lang_pred_", "Score_", "lang_pred", "score"] and out.first()["lang_pred_"] == "x"
    assert quality_rules.rate(df, keep=("kept",)).first()["kept_"] == "k"
    assert mixing.materialise(df, mixing.mix(df, source="kept"), keep=("text",)).columns == ["key", "text_", "text"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = [tuple(r[c] for c in want.columns) for r in queries.QUERIES[name](spark, small).collect()]
    assert sorted(got) == sorted(want.fetchall())
