"""SentencePiece encoding and decoding over a relational lattice.

Text is prepared as the model says (identity normaliser: a dummy prefix, spaces as U+2581) and
cut where no piece can reach across: before a run of U+2581, and around newlines. The frequent
words, at most ``MOST_WORDS``, get their ids in Spark: substrings of at most the longest piece's length
are exploded and equi-joined to the piece table, edges are grouped by word, and
``aggregate`` folds them. For unigram models the fold is Viterbi. For BPE models the best path
of a lattice isn't what the library gives, so the fold merges over the same edges: the
neighbours whose union has the best score, leftmost first, until none is an edge; those are
the library's ids. The dictionary of frequent words is broadcast; a word outside it is cut
by the same merge (or Viterbi) in the worker that meets it, thousands of words at a time in arrays (``Merger``). Characters without a piece become byte pieces,
or the unknown piece.

Decoding joins the pieces, bytes included, and drops the dummy prefix.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows are
encoded each; an empty table gives no rows; texts and words of any length are taken
whole; kept columns that clash with a result's are renamed by ``out_names``; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, col, mapped, out_names, pieces, written

SPACE = "▁"
MOST_WORDS, LONGEST_WORD, BLOCK, MOST_CACHED = 1 << 17, 40, 1 << 20, 1 << 17
#: Words outside the dictionary that a worker gathers before it cuts them, words whose ids it holds meanwhile (a text
#: of more is alone), and the least number of words that arrays are worth.
STEP, MOST_HELD, LEAST = 1 << 14, 1 << 18, 256
UNKNOWN_PENALTY = 10.0


@dataclass
class Model:
    """Pieces that can match, with their scores and ids; byte pieces; how to fold."""

    scores: dict[str, float]
    ids: dict[str, int]
    surface: list[bytes]
    byte_ids: list[int] | None
    unknown: int
    bpe: bool
    ranks: dict[str, int] = field(default_factory=dict)
    merger: "Merger | None" = field(default=None, repr=False, compare=False)

    def __post_init__(self) -> None:
        order = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in self.scores.items()}
        self.longest = max(map(len, self.scores), default=1)
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        crosses = any(a != SPACE and b == SPACE for p in self.scores for a, b in zip(p, p[1:], strict=False))
        lines = any("\n" in p for p in self.scores)
        self.words = re.compile("(?s).+" if crosses or lines else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.dtype = "<u2" if len(self.surface) <= 1 << 16 else "<u4"

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def fallback(self, piece: str) -> list[int]:
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]

    def cut(self, word: str) -> list[int]:
        """Ids of one word."""
        symbols = self._merged(word) if self.bpe else self._best(word)
        out: list[int] = []
        for s in symbols:
            out += [self.ids[s]] if s in self.ids else self.fallback(s)
        return out

    def cut_all(self, words: list[str]) -> list[bytes]:
        """Ids of each word as bytes."""
        if len(words) < LEAST or not self.bpe:
            return [np.array(self.cut(w), self.dtype).tobytes() for w in words]
        if self.merger is None:
            self.merger = Merger(self)
        out = self.merger.cut(words)
        return [np.array(self.cut(w), self.dtype).tobytes() if x is None else x for w, x in zip(words, out, strict=True)]

    def _merged(self, word: str) -> list[str]:
        n, ranks = len(word), self.ranks
        nxt, prev, part = list(range(1, n + 1)), list(range(-1, n - 1)), list(word)
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i] if part[i] else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = ""
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := prev[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [p for p in part if p]

    def _best(self, word: str) -> list[str]:
        """Viterbi; of equal scores the shortest last piece."""
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - self.longest), e):
                if (x := self.scores.get(word[s:e], self.floor if e - s == 1 else None)) is not None:
                    best[e] = max(best[e], (best[s][0] + x, s))
        out, e = [], len(word)
        while e:
            out.append(word[best[e][1] : e])
            e = best[e][1]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class Merger:
    """The merge of a BPE model for many words at once. Symbols are numbers, and a hash table has the union of
    each pair that has one. Words stand in columns, with links over merged places; a step merges in every word the
    pair whose union has the least rank, leftmost first, until none is left."""

    SIZES, BITS, NONE = (8, 12, 16, 24, LONGEST_WORD), 6, np.int32(2**31 - 1)

    def __init__(self, model: Model) -> None:
        number = {p: i for i, p in enumerate(model.ranks)}
        self.pad = len(number)
        self.usable = self.pad < 1 << 31 - self.BITS - 1
        self.ids = np.array([model.ids[p] for p in number], model.dtype)
        self.ranks = np.array([*model.ranks.values(), 0], np.int32)
        chars = {ord(p): i for p, i in number.items() if len(p) == 1}
        self.chars = np.full(max(chars, default=0) + 2, self.pad, np.int32)
        self.chars[list(chars)] = list(chars.values())
        pairs = {}
        for p, i in number.items():
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * (self.pad + 1) + b] = i
        self.shift = 64 - max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << 64 - self.shift, -1, np.int64)
        self.unions = np.full(len(self.keys), self.pad, np.int32)
        keys, unions = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            left = self.keys[at] != keys
            self.unions[at[~left]] = unions[~left]
            keys, unions, at = keys[left], unions[left], (at[left] + 1) % len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _union(self, a: np.ndarray, b: np.ndarray, at: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """For each pair its union, or ``pad``; and the union's rank with the pair's place in the last bits, or ``NONE``."""
        keys = a.astype(np.int64) * (self.pad + 1) + b
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.unions[slots], np.int32(self.pad))
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) % len(self.keys)
            found = self.keys[slots[rest]]
            hit = rest[found == keys[rest]]
            out[hit] = self.unions[slots[hit]]
            rest = rest[(found != keys[rest]) & (found >= 0)]
        return out, np.where(out == self.pad, self.NONE, self.ranks[out] << self.BITS | at)

    def cut(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word as bytes; None for words over ``LONGEST_WORD`` and those with a character that is no piece."""
        out: list[bytes | None] = [None] * len(words)
        if not self.usable:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols = self.chars[np.minimum(codes, len(self.chars) - 1)]
        odd = np.zeros(len(words), bool)
        odd[np.searchsorted(starts, np.flatnonzero(symbols == self.pad), "right") - 1] = True
        least = 0
        for most in self.SIZES:
            who = np.flatnonzero((sizes > least) & (sizes <= most) & ~odd)
            least = most
            if len(who):
                ids, ends = self._merge(symbols, starts[who], sizes[who], most)
                lo = 0
                for w, hi in zip(who.tolist(), ends.tolist(), strict=True):
                    out[w] = ids[lo:hi]
                    lo = hi
        return out

    def _merge(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[bytes, np.ndarray]:
        """Ids of words of at most ``most`` symbols, end to end, and where each word's end, in bytes."""
        n = len(starts)
        held = np.full((most + 2, n), self.pad, np.int32)  # a place more on either side
        for k in range(most):
            inside = slice(None) if k == 0 else np.flatnonzero(sizes > k)
            held[k + 1, inside] = symbols[starts[inside] + k]
        best, made = np.full((most + 2, n), self.NONE, np.int32), np.full((most + 2, n), self.pad, np.int32)
        for k in range(1, most):
            made[k], best[k] = self._union(held[k], held[k + 1], k)
        after = np.repeat(np.arange(1, most + 3, dtype=np.int32)[:, None], n, 1)
        before = after - 2
        flat, ways, unions, nxt, prev = held.ravel(), best.ravel(), made.ravel(), after.ravel(), before.ravel()
        while True:
            least = best.min(axis=0)
            cols = np.flatnonzero(least != self.NONE)
            if not len(cols):
                break
            place = least[cols] & (1 << self.BITS) - 1
            i = place * np.int64(n) + cols
            union = unions[i]
            j = nxt[i] * np.int64(n) + cols
            right, left = nxt[j], prev[i]
            r, h = right * np.int64(n) + cols, left * np.int64(n) + cols
            flat[i] = union
            flat[j] = -1
            ways[j] = self.NONE
            nxt[i] = right
            prev[r] = place
            unions[i], ways[i] = self._union(union, flat[r], place)
            unions[h], ways[h] = self._union(flat[h], union, left)
        held = np.ascontiguousarray(held[1:-1].T)
        stays = (held >= 0) & (held != self.pad)
        return self.ids[held[stays]].tobytes(), np.cumsum(stays.sum(axis=1)) * self.ids.itemsize


def load(model_path: str) -> Model:
    """A model file. Only the identity normaliser with a dummy prefix is taken; others are refused."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(model_path, "rb") as f:
        spec = proto.ModelProto.FromString(f.read())
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("this normaliser is not supported")
    if spec.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    scores, ids, surface, by_byte, unknown = {}, {}, [], {}, 0
    for i in range(len(lib)):
        p = lib.id_to_piece(i)
        if lib.is_byte(i):
            by_byte[int(p[3:5], 16)] = i
            surface.append(bytes([int(p[3:5], 16)]))
        elif lib.is_unknown(i) or lib.is_control(i):
            unknown = i if lib.is_unknown(i) else unknown
            surface.append(" ⁇ ".encode() if lib.is_unknown(i) else b"")
        else:
            scores[p], ids[p] = lib.get_score(i), i
            surface.append(p.encode())
    byte_ids = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None
    return Model(scores, ids, surface, byte_ids, unknown, spec.trainer_spec.model_type == 2)


def frequent_words(df: DataFrame, model: Model, text: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """At most ``most`` words of at most ``LONGEST_WORD`` characters, the most frequent of the
    corpus; counts are collected in blocks first, and cover every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, Counter()

        def block():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in pieces(batch, 0):
                for t in part.column(0).to_pylist():
                    words = model.split(t or "")
                    seen.update(words if max(map(len, words), default=0) <= LONGEST_WORD else [w for w in words if len(w) <= LONGEST_WORD])
                if len(seen) > BLOCK // 4:
                    yield block()
                    seen = Counter()
        if seen:
            yield block()

    counted = mapped(df.select(col(text).alias("t")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted.where("n > 1").withColumn("level", F.floor(4 * F.log2("n"))), "word-counts")
    total, least = 0, None
    for r in sorted(counted.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # quarters of powers of 2: at most 256 rows
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counted.where(F.col("level") >= least if least is not None else F.lit(False)).select("word")


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """(word, edges: start, end, score, rank, id) with every piece in every word; start from 0."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, model.scores[p], model.ranks[p], i) for p, i in model.ids.items()], "piece string, score double, rank int, id int")
    size = F.char_length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + model.longest, size))).alias("end"))
    spans = spans.withColumn("piece", F.expr("substring(word, start + 1, end - start)"))
    edges = spans.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("end") == F.col("start") + 1))
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("start", "end", "score", "rank", "id"))).alias("edges"))


def folded(lattices: DataFrame, model: Model) -> DataFrame:
    """(word, ids): the fold of each word's edges."""
    n = F.char_length("word")
    at = F.lit(1000)
    ranks = F.map_from_entries(F.transform(F.filter("edges", lambda e: e["id"].isNotNull()), lambda e: F.struct(e["start"] * at + e["end"], F.struct(e["rank"], e["id"]))))
    if model.bpe:
        bounds = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), _merge_step)
    else:
        bounds = _viterbi(n, model.floor)
    of = F.transform(
        F.sequence(F.lit(1), F.size("bounds") - 1),
        lambda k: F.struct(F.element_at("bounds", k).alias("s"), F.element_at("bounds", k + 1).alias("e")),
    )

    def ids(x: Column) -> Column:
        hit = F.element_at("ranks", x["s"] * at + x["e"])["id"]
        hexed = F.hex(F.encode(F.substring(F.col("word"), x["s"] + 1, x["e"] - x["s"]), "UTF-8"))
        if model.byte_ids:
            table = F.array(*[F.lit(i) for i in model.byte_ids])
            rest = F.transform(F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")), lambda j: F.element_at(table, F.conv(F.substring(hexed, 2 * j - 1, F.lit(2)), 16, 10).cast("int") + 1))
        else:
            rest = F.array(F.lit(model.unknown))
        return F.when(hit.isNotNull(), F.array(hit)).otherwise(rest)

    return lattices.withColumn("ranks", ranks).withColumn("bounds", bounds).select("word", F.flatten(F.transform(of, ids)).alias("ids"))


def _merge_step(bounds: Column, _: Column) -> Column:
    """Drops the boundary between the neighbours whose union has the least rank, if there are any."""
    tries = F.transform(
        F.when(F.size(bounds) > 2, F.sequence(F.lit(1), F.size(bounds) - 2)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.element_at("ranks", F.element_at(bounds, k) * 1000 + F.element_at(bounds, k + 2))["rank"].alias("rank"), k.alias("k")),
    )
    best = F.array_min(F.filter(tries, lambda t: t["rank"].isNotNull()))["k"]
    return F.when(best.isNull(), bounds).otherwise(F.filter(bounds, lambda x, i: i != F.coalesce(best, F.lit(-1))))


def _viterbi(n: Column, floor: float) -> Column:
    """Boundaries of the path with the largest sum of scores."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from")))

    def step(acc: Column, e: Column) -> Column:
        into = F.filter("edges", lambda x: x["end"] == e)
        ways = F.transform(into, lambda x: F.struct((F.element_at(acc, x["start"] + 1)["score"] + F.coalesce(x["score"], F.lit(floor))).alias("score"), x["start"].alias("from")))
        return F.concat(acc, F.array(F.array_max(ways)))

    best = F.aggregate(F.sequence(F.lit(1), n), first, step)
    back = lambda acc, _: F.when(acc[0] == 0, acc).otherwise(F.concat(F.array(F.element_at(best, acc[0] + 1)["from"]), acc))
    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)


def dictionary(df: DataFrame, model: Model, text: str = "text", most: int = MOST_WORDS) -> dict[str, bytes]:
    """Ids of the frequent words, at most ``most``, from the lattice."""
    out = {}
    for batch in folded(lattice(frequent_words(df, model, text, most), model), model).toArrow().to_batches():
        for w, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out[w] = np.array(ids, model.dtype).tobytes()
    return out


class Encoder:
    """Ids of texts as bytes, from a dictionary and a cache of at most ``MOST_CACHED`` other words: once
    half of them are new, the older half goes, within a text too."""

    def __init__(self, model: Model, known: dict[str, bytes]) -> None:
        self.model, self.known, self.own, self.older = model, known, {}, {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        out, ends, lost, places = [], [], [], []
        for t in texts:
            words, start = self.model.split(t or ""), len(out)
            out += map(self.known.get, words)
            gaps = [i for i in range(start, len(out)) if out[i] is None]
            places += gaps
            lost += [words[i - start] for i in gaps]
            ends.append(len(out))
            if len(lost) >= STEP or len(out) >= MOST_HELD:
                yield from self._filled(out, ends, lost, places)
                out, ends, lost, places = [], [], [], []
        yield from self._filled(out, ends, lost, places)

    def _filled(self, out: list[bytes | None], ends: list[int], lost: list[str], places: list[int]) -> Iterator[bytes]:
        """Ids of each text, from those of its words end to end, once the words outside the dictionary have theirs."""
        for at in range(0, len(lost), STEP):
            for place, ids in zip(places[at : at + STEP], self._ids(lost[at : at + STEP]), strict=True):
                out[place] = ids
        for lo, hi in zip([0, *ends], ends, strict=False):
            yield b"".join(out[lo:hi])

    def _ids(self, words: list[str]) -> list[bytes]:
        here: dict[str, bytes | None] = dict.fromkeys(words)
        new = []
        for w in here:
            ids = self.own.get(w)
            if ids is None:
                ids = self.older.get(w)
                if ids is None:
                    new.append(w)
                    continue
                self._keep(w, ids)
            here[w] = ids
        for at in range(0, len(new), MOST_CACHED // 4):
            part = new[at : at + MOST_CACHED // 4]
            for w, ids in zip(part, self.model.cut_all(part), strict=True):
                here[w] = ids
                if len(w) <= 3 * LONGEST_WORD:
                    self._keep(w, ids)
        return list(map(here.__getitem__, words))

    def _keep(self, word: str, ids: bytes) -> None:
        if len(self.own) >= MOST_CACHED // 2:
            self.own, self.older = {}, self.own
        self.own[word] = ids


def id_lists(encoded: list[bytes], dtype: str) -> pa.ListArray:
    """A list of ids for each text, without a Python object for each id."""
    ends = np.cumsum([0, *map(len, encoded)]) // np.dtype(dtype).itemsize
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), dtype).astype(np.int32)))


def _mapped(df: DataFrame, model: Model, text: str, keep: tuple[str, ...], columns, names: tuple[str, ...], schema: str, most: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((model, dictionary(df, model, text, most)))
    n, named = len(keep), out_names(keep, names)
    given = df.select(*[col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], col(text).alias("_text"))
    cache: list[Encoder] = []

    def rows(batch: pa.RecordBatch):
        if not cache:
            cache.append(Encoder(*shared.value))
        for part in pieces(batch, n):
            texts = part.column(n).to_pylist()
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *columns(cache[0].model, texts, cache[0].encode(texts))], names=[*named, *names])

    given_schema = ", ".join(f"`{k}` {f.dataType.simpleString()}" for k, f in zip(named, given.schema.fields, strict=False))
    return arrow_rows(given, rows, f"{given_schema}, {schema}")


def encode(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = MOST_WORDS) -> DataFrame:
    """The ``keep`` columns of every row, with ids."""
    return _mapped(df, model, text, keep, lambda m, _, encoded: [id_lists(list(encoded), m.dtype)], ("ids",), "ids array<int>", most)


def digests(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = MOST_WORDS) -> DataFrame:
    """As ``encode``, with the number of ids, the crc32 of all as little-endian u32, and whether
    decoding gives the text back."""
    def row(m: Model, t: str | None, ids: np.ndarray):
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), m.decode(ids.tolist()) == (t or "").replace(SPACE, " ")

    def columns(m: Model, texts: list[str | None], encoded: Iterator[bytes]) -> list[pa.Array]:
        out = [row(m, t, np.frombuffer(ids, m.dtype)) for t, ids in zip(texts, encoded, strict=True)]
        return [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)]

    return _mapped(df, model, text, keep, columns, ("n_tokens", "ids_crc32", "round_trip"), "n_tokens long, ids_crc32 long, round_trip boolean", most)


def decode(df: DataFrame, model: Model, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row, with the text of its ids; null ids give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    n, named = len(keep), out_names(keep, ("text",))
    given = df.select(*[col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], col(ids).cast("array<int>").alias("_ids"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([shared.value.decode(x or []) for x in batch.column(n).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:n], texts], names=[*named, "text"])

    schema = ", ".join(f"`{k}` {f.dataType.simpleString()}" for k, f in zip(named, given.schema.fields, strict=False))
    return arrow_rows(given, rows, f"{schema}, text string")
