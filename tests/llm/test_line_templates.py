"""Line deduplication by templates, against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import line_templates as lt
from vellum.llm.common import table


def by_hand(rows, least_docs=lt.LEAST_DOCS):
    key = lambda k: float("inf") if k is None else k
    lines = []
    for r, (k, t) in enumerate(rows):
        for i, line in enumerate((t or "").split("\n")):
            words = [w for w in re.split("[ \t-\r]+", line) if w]
            if len(words) >= lt.LEAST_WORDS:
                masked = tuple("<*>" if re.search("[0-9]", w) else w for w in words)
                lines.append(((len(words), masked[: lt.DEPTH]), masked, key(k), r, i))
    docs = defaultdict(set)
    for node, _, k, _, _ in lines:
        docs[node].add(k)
    lines = [x for x in lines if len(docs[x[0]]) >= least_docs]
    left = Counter((node, masked) for node, masked, *_ in lines)
    template = {}
    for _ in range(lt.LEADERS):
        leader = {}
        for (node, masked), n in left.items():
            leader[node] = min(leader.get(node, (1, "")), (-n, " ".join(masked)))
        for node, masked in list(left):
            lead = tuple(leader[node][1].split(" "))
            if 100 * sum(a == b for a, b in zip(masked, lead, strict=True)) >= lt.ALIKE * len(masked):
                template[node, masked] = (node, lead)
                del left[node, masked]
    template |= {x: x for x in left}
    have = defaultdict(set)
    for node, masked, k, _, _ in lines:
        have[template[node, masked]].add(k)
    gone = defaultdict(set)
    for node, masked, k, r, i in lines:
        t = have[template[node, masked]]
        if len(t) >= least_docs and k != min(t):
            gone[r].add(i)
    out = []
    for r, (k, t) in enumerate(rows):
        if r in gone:
            kept = [x for i, x in enumerate(t.split("\n")) if i not in gone[r]]
            t2 = "\n".join(kept) if any(re.search(r"[^\x20\x09-\x0D]", x) for x in kept) else ""
        else:
            t2 = t
        out.append((k, t2, len(t.split("\n")) if t else 0, len(gone[r])))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["key"], r["text"], r["n_lines"], r["n_dropped"]) for r in lt.drop_lines(df).collect()), key=str)


def test_against_plain_version(spark, small):
    rnd = random.Random(1)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    names = [f"name{x}" for x in "abcdefghij"]
    for i in range(80):
        lines = [f"Page {rnd.randrange(99)} of {rnd.randrange(99)} printed by {rnd.choice(names)} on day {i}", " ".join(rnd.choice("uvwxyz") * 3 for _ in range(rnd.randrange(9)))]
        lines += [f"All the rights are {rnd.choice(['kept', 'held'])} by {rnd.choice(names)} and by all others"] * rnd.randrange(3) + ["", "ab", "one two three four"]
        rnd.shuffle(lines)
        rows.append((5000 + rnd.randrange(60), "\n".join(lines[: rnd.randrange(len(lines) + 1)])))
    rows += [(None, "one two three four"), (None, None), (6000, ""), (6001, "\n"), (1, rows[1][1]), (6002, "long " * 50_000), (6003, "one two three four\r\n \n")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(t, "x", k) for k, t in rows], "text string, line string, doc_id long").repartition(4)
    got, want = found(df), by_hand(rows)
    assert got == want
    assert sum(x[3] for x in got) > 100
    assert any(x[0] is not None and "one two three four" in (x[1] or "") for x in got)


def test_templates_have_variables(spark):
    rows = [(i, f"user {i} has logged in from host{i % 3} today\nother words {i} are here and alone {'z' * i}") for i in range(12)]
    texts = lt._texts(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    import numpy as np

    lines = lt.lines_in(texts, np.full(1 << 24, 255, np.uint8))
    got = {r["text"]: r["lines"] for r in lt.template_texts(lt.templates(lines)).collect()}
    assert "user <*> has logged in from <*> today" in got
    assert any(t.startswith("other words <*> are here and alone <*>") for t in got)


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", "y")], "doc_id long, text string, `a.b` string, key string")
    assert [tuple(r) for r in lt.drop_lines(df, keep=("a.b",)).collect()] == [(1, "x", "a b c d", 1, 0)]
    out = lt.drop_lines(df, keep=("key", "a.b", "text"))
    assert out.columns == ["key", "key_", "a.b", "text_", "text", "n_lines", "n_dropped"] and out.first()["key_"] == "y"


def test_short_lines(spark):
    rows = [(i, f"Of.\nAll rights reserved.\npage {i}\n{'xyz'[i % 3]} {i // 3}\n{'z' * i} alone here") for i in range(1, 10)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == by_hand(rows)
    assert [x[1].split("\n") for x in got[1:]] == [rows[i][1].split("\n")[3:] for i in range(1, 9)]
    assert got[0][1] == rows[0][1]


def test_every_template_of_a_node_is_found(spark):
    """Against leaders chosen without end, by documents."""
    rnd = random.Random(7)
    rows = []
    for i in range(120):
        lines = [" ".join(["we", "all", "know", *(rnd.choice("ab") * 2 for _ in range(n))]) for n in (1, 2, 4, 7, 7, 9) for _ in range(2)]
        rows.append((i, "\n".join([lines[0]] * rnd.randrange(40) + lines)))
    texts = lt._texts(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    got = {r["masked"]: r["leader"] for r in lt.templates(lt.lines_in(texts, np.full(1 << 24, 255, np.uint8))).collect()}
    docs = Counter(line for _, t in rows for line in set(t.split("\n")))
    want, heads = {}, defaultdict(list)
    for line in sorted(docs, key=lambda x: (-docs[x], x)):
        words = line.split()
        alike = lambda head: 100 * sum(a == b for a, b in zip(words, head.split(), strict=True)) >= lt.ALIKE * len(words)  # noqa: B023, E731
        head = next(filter(alike, heads[len(words)]), None)
        if head is None:
            heads[len(words)].append(head := line)
        want[line] = head
    assert max(map(len, heads.values())) > lt.LEADERS + 3
    assert got == want


def test_fourth_template_is_dropped(spark):
    ends = ["red house", "blue car", "old tree", "tall man", "wet road"]
    rows = [(i, "\n".join(f"we all know of {e} and {e[::-1]} by {'z' * (i + 1)}" for e in ends)) for i in range(6)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [x[3] for x in got] == [0, 5, 5, 5, 5, 5]


def test_leaders_have_most_documents(spark):
    """The line that one document repeats stands between two templates."""
    far, mid, near = "a b c d e f g h i j", "a b c d e f g u v k", "a b c d w x g u v k"
    rows = [(0, "\n".join([far] * 50)), (1, mid), *[(k, near) for k in (2, 3, 4, 5)]]
    got = {x[0]: x[3] for x in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1}
