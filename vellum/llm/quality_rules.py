"""Quality rules, with repetition found by suffix arrays over words.

The suffixes of a batch of texts are put in order by prefix doubling that keeps refining
only groups of suffixes which are still alike. Longest common prefixes of neighbours come
from the ranks of the doublings; an interval of the array whose common prefix has at
least ``WINDOW`` words is a repeated substring. The union of their spans gives
``n_repeat_words`` and ``repeat_chars``, the largest common prefix ``longest_repeat``.
Words are numbered for each text, never hashed, and each text ends with a number of its
own: results are exact, and texts in a batch don't meet.

A row is kept if the base rules pass, repeats cover at most ``MAX_COVERED`` percent of
the characters in words, and the longest repeat is shorter than ``LONG_WORDS`` words or
at most ``MAX_LONGEST`` percent of the words. Both limits reject texts that the base rules pass:
the base rules allow repeats ``MAX_REPEAT`` percent of the words, of which a passage that comes twice
is at most half.

Cases: a null or empty text has no words and fails; repeated rows are judged one by
one; a text of any length is judged whole; kept columns that clash with a result's are renamed by ``out_names``; other columns of the input are not read.
"""

from __future__ import annotations

import re
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE_BYTES, arrow_rows, col, out_names, pieces, raw_texts

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
MAX_COVERED, LONG_WORDS, MAX_LONGEST = 20, 50, 5
SYMBOLS = re.compile(rb"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat")


def repeated(ids: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes whose first ``window`` (a power of 2) numbers occur again,
    and the length of the longest prefix of each that does. The last number of ``ids``
    occurs once."""
    n = len(ids)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.bincount(ids)
    rank = (np.cumsum(size) - size)[ids]  # the place in the array of the group's first suffix
    alike = np.flatnonzero(size[ids] > 1)
    levels, step, first = [rank], 1, None
    while len(alike):
        if step == window:
            first = alike
        key = rank[alike] * n + rank[alike + step]
        order = np.argsort(key, kind="stable")
        alike, key = alike[order], key[order]
        at = np.arange(len(alike))
        new_group = np.r_[True, key[1:] != key[:-1]]
        new_whole = np.r_[True, rank[alike[1:]] != rank[alike[:-1]]]
        lead = np.maximum.accumulate(np.where(new_group, at, 0))
        whole = np.maximum.accumulate(np.where(new_whole, at, 0))
        refined = rank.copy()
        refined[alike] = rank[alike] + lead - whole
        group = np.cumsum(new_group) - 1
        alike = alike[np.bincount(group)[group] > 1]
        rank = refined
        levels.append(rank)
        step *= 2
    if first is None:
        return none
    suffixes = first[np.argsort(rank[first])]
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + common, n - 1)] == levels[k][np.minimum(b + common, n - 1)]
        common += same.astype(np.int64) << k
    return suffixes, np.maximum(np.r_[0, common], np.r_[common, 0])


def measure(texts: list[bytes | None], window: int = WINDOW) -> list[tuple[int, ...]]:
    """COUNTS of each text."""
    ids: list[np.ndarray] = []
    words_of, base = [], 0
    for raw in texts:
        words = (raw or b"").split()
        number: dict[bytes, int] = {}
        fresh = count(base)
        own = np.fromiter((number[w] if w in number else number.setdefault(w, next(fresh)) for w in words), np.int64, len(words))
        base += len(number) + 1
        ids += [own, np.array([base - 1])]
        words_of.append(words)
    flat = np.concatenate(ids)
    starts, lengths = repeated(flat, window)
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    covered = np.cumsum(edge[:-1]) > 0
    longest = np.zeros(len(flat), np.int64)
    longest[starts] = lengths
    out, at = [], 0
    for raw, words in zip(texts, words_of, strict=True):
        raw, n = raw or b"", len(words)
        own = np.flatnonzero(covered[at : at + n])
        lines, seen = 0, set()
        for line in raw.split(b"\n"):
            if line.strip(SPACE_BYTES):
                lines += line in seen
                seen.add(line)
        out.append((
            n, len(raw.translate(None, SPACE_BYTES).decode("utf-8", "replace")), len(SYMBOLS.findall(raw)), lines, len(own),
            sum(len(words[i].decode("utf-8", "replace")) for i in own.tolist()), int(longest[at : at + n].max(initial=0)),
        ))
        at += n + 1
    return out


def judge(m: tuple[int, ...]) -> tuple[bool, bool]:
    """(base_failed, kept) for the COUNTS of a text."""
    n_words, word_chars, _, _, n_repeat, chars, longest = m
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT * n_words
    much = 100 * chars > MAX_COVERED * word_chars or (longest >= LONG_WORDS and 100 * longest > MAX_LONGEST * n_words)
    return failed, not failed and not much


def rate(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with COUNTS, base_failed and kept."""
    n, named = len(keep), out_names(keep, (*COUNTS, "base_failed", "kept"))
    given = df.select(*[col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], col(text).alias("_text"))

    def rows(batch: pa.RecordBatch):
        for part in pieces(batch, n, 2 << 20):
            found = measure(list(raw_texts(part.column(n))))
            ruled = [judge(m) for m in found]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:n], *[pa.array(x, pa.int64()) for x in zip(*found, strict=True)], *[pa.array(x) for x in zip(*ruled, strict=True)]],
                names=[*named, *COUNTS, "base_failed", "kept"],
            )

    schema = ", ".join(f"`{k}` {f.dataType.simpleString()}" for k, f in zip(named, given.schema.fields, strict=False))
    return arrow_rows(given, rows, f"{schema}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean")
