"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1-, 2- and 3-grams of lower-cased code points for each language
on a bounded sample (``per_lang`` documents of each language, whichever have the
smallest seeded hash of their id); the prior is each language's share of all labelled rows. The
matrix of log probabilities, ``BUCKETS`` x languages, is broadcast. A batch of texts is one sparse
matrix of n-gram counts, kept as the buckets of its n-grams, text by text; its product
with the matrix gathers rows and sums them by text in numpy.

Cases: a null text, an empty one or one without a letter gets ``und`` and score 0; ties
go to the language first in code point order; without labelled rows every text is
``und``; repeated rows are scored one by one; a text of any length is scored whole, in windows; kept
columns that clash with a result's are renamed by ``out_names``; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, col, mapped, out_names, pieces, written

BITS = 16
BUCKETS = 1 << BITS
LETTER = regex.compile(r"\p{L}")
#: Odd multipliers, one for each place in an n-gram.
PLACES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
STEP = 1 << 18


def grams(points: np.ndarray) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-grams that start in ``points``."""
    out, mix = [], np.zeros(len(points), np.uint32)
    for n, place in enumerate(PLACES):
        if len(points) <= n:
            break
        mix = mix[: len(points) - n] + points[n:] * place
        mix ^= mix >> np.uint32(15)
        out.append(((mix * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x61C88647)) >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass(frozen=True)
class Model:
    """langs in code point order; weights: BUCKETS x langs, log probabilities."""

    langs: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log of prior and likelihood of whole texts, texts x langs."""
        each = [points_of(t) for t in texts]
        points = np.concatenate(each) if each else np.zeros(0, np.uint32)
        ends = np.cumsum([len(x) for x in each])
        total = np.repeat(self.prior[None, :], len(each), axis=0)
        for at in range(0, len(points), STEP):  # n-grams that start in this window
            part = points[at : at + STEP + len(PLACES) - 1]
            start = np.arange(at, min(at + STEP, len(points)))
            text = np.searchsorted(ends, start, side="right")
            found, lo = grams(part), 0
            for n in range(1, len(PLACES) + 1):
                size = max(0, len(part) - n + 1)
                own = np.flatnonzero(start[: min(size, len(start))] + n <= ends[text[: min(size, len(start))]])
                if len(own):
                    run = np.flatnonzero(np.r_[True, text[own[1:]] != text[own[:-1]]])
                    total[text[own[run]]] += np.add.reduceat(self.weights[found[lo : lo + size][own]], run, axis=0, dtype=np.float64)
                lo += size
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if self.langs else []
        if some:
            s = self.scores([texts[i] for i in some])
            p = np.exp(s - s.max(axis=1, keepdims=True))
            best = s.argmax(axis=1)
            for i, k, x in zip(some, best.tolist(), p[np.arange(len(some)), best] / p.sum(axis=1), strict=True):
                out[i] = (self.langs[k], float(x))
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 1500, smoothing: float = 0.1, seed: int = 17) -> Model:
    """Learns every language of ``labelled``, from at most about ``per_lang`` documents of each; rows with a null text or language
    teach nothing. The counts that come to the driver are at most ``BUCKETS`` for each language."""
    rows = labelled.select(col(key).cast("string").alias("k"), col(text).alias("t"), col(lang).alias("l")).where("t is not null and l is not null")
    counts = written(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    many = {r["l"]: r["n"] for r in counts.collect()}
    if not many:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("k", F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.withColumn("u", unit).join(F.broadcast(counts), "l").where(F.col("u") * F.col("n") < per_lang)

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                into = seen.setdefault(x, np.zeros(BUCKETS, np.int64))
                points = points_of(t)
                for at in range(0, len(points), STEP):
                    found = grams(points[at : at + STEP + len(PLACES) - 1])
                    into += np.bincount(found, minlength=BUCKETS)
                    if len(points) > at + STEP:  # those that start beyond come again with the next window
                        into -= np.bincount(grams(points[at + STEP : at + STEP + len(PLACES) - 1]), minlength=BUCKETS)
        for x, into in seen.items():
            (idx,) = into.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(idx)), pa.array(idx.astype(np.int32)), pa.array(into[idx])], names=["l", "idx", "n"])

    langs = sorted(many)
    table = np.zeros((len(langs), BUCKETS), np.float64)
    got = mapped(chosen.select("t", "l"), count, "l string, idx int, n long").groupBy("l", "idx").agg(F.sum("n").alias("n")).toArrow()
    if got.num_rows:
        at = {x: i for i, x in enumerate(langs)}
        table[[at[x] for x in got["l"].to_pylist()], got["idx"].to_numpy()] = got["n"].to_numpy()
    table += smoothing
    logs = np.log(table / table.sum(axis=1, keepdims=True))
    prior = np.log(np.array([many[x] for x in langs]) / sum(many.values()))
    return Model(tuple(langs), np.ascontiguousarray(logs.T.astype(np.float32)), prior)


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row, with lang_pred and score (the posterior of lang_pred)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    n, named = len(keep), out_names(keep, ("lang_pred", "score"))
    given = df.select(*[col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], col(text).alias("_text"))

    def rows(batch: pa.RecordBatch):
        for part in pieces(batch, n, 1 << 20):
            found = shared.value.predict(part.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*named, "lang_pred", "score"])

    schema = ", ".join(f"`{k}` {f.dataType.simpleString()}" for k, f in zip(named, given.schema.fields, strict=False))
    return arrow_rows(given, rows, f"{schema}, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
