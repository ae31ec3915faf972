"""Token ids as length-delimited binary records, with an offset index.

Record: u64 length of the payload, u32 masked crc32 of those 8 bytes, payload, u32 masked
crc32 of the payload, all little-endian. Payload: u8 flags (bit 0: the key is null; bit 1:
ids take 4 bytes, else 2), i64 key, ids. Mask: ``rotate_right(crc, 15) + 0xA282EAD8``. Beside
each data file ``x.rec`` lies ``x.idx``: 8 bytes of magic, then for each record u64 offset and
u64 number of ids, then u32 masked crc32 of all before it; a reader that shuffles picks
records by it.

Rows are range-partitioned and sorted by key, so that files follow each other in ascending
order, nulls last. Each task writes its file under a name of its own attempt, and only
names in the committed manifest count: a lost executor leaves at most an unused file.

Words repeat, so each worker encodes a word once and joins the ids; that gives the
library's ids for the whole text if the tokenizer splits at white space, which
``splits_at_space`` says for the file used. Other tokenizers encode whole texts. Words of printable
characters below U+0250 are cut by the file's own pattern, and their parts given to the library's model, if the
file's other steps leave such text alone but for its case (``plain_steps``, ``plain_chars``).

Cases: null or empty texts have only the end id; equal keys are records side by side; an
empty table gives no files; other columns of the input are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh_path, pieces, raw_texts, written

MAGIC = b"VELIDX01"
#: Words in each of the two generations of a worker's cache, and the bytes of the longest that is kept.
MOST_CACHED, LONGEST_CACHED = 400_000, 96


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def packed(key: int | None, ids: bytes, wide: bool) -> bytes:
    return struct.pack("<Bq", (key is None) | wide << 1, key or 0) + ids


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, key = struct.unpack_from("<Bq", payload)
    return (None if flags & 1 else key), np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


def records(stream) -> Iterator[bytes]:
    """Payloads of a data file, each checked."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("broken length")
        payload = stream.read(struct.unpack("<Q", head[:8])[0])
        tail = stream.read(4)
        if len(tail) < 4 or struct.unpack("<I", tail)[0] != masked(payload):
            raise ValueError("broken payload")
        yield payload


def read_index(data: bytes) -> np.ndarray:
    """(offset, ids) of each record."""
    if data[:8] != MAGIC or struct.unpack("<I", data[-4:])[0] != masked(data[:-4]):
        raise ValueError("broken index")
    return np.frombuffer(data[8:-4], "<u8").reshape(-1, 2)


def read_record(stream, offset: int) -> tuple[int | None, np.ndarray]:
    """One record of a seekable data file, by its offset."""
    stream.seek(int(offset))
    return unpacked(next(records(stream)))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def plain_steps(spec: dict) -> tuple[bool, str] | None:
    """(whether case goes, pattern of the parts) if that is all the file does to ``plain_chars`` before its BPE
    model sees their bytes, else None."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    parts = pre.get("pretokenizers", [])
    plain = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
    if any(x["type"] not in plain and not (x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+") for x in steps):
        return None
    if [x["type"] for x in parts] != ["Split", "ByteLevel"] or parts[1]["add_prefix_space"] or parts[1]["use_regex"]:
        return None
    if parts[0]["behavior"] != "Removed" or not parts[0]["invert"] or spec["model"].get("type", "BPE") != "BPE" or spec["model"].get("dropout"):
        return None
    return any(x["type"] == "Lowercase" for x in steps), parts[0]["pattern"]["Regex"]


def plain_chars(normalizer, lower: bool) -> str:
    """Printable characters below U+0250 that the file's normalizer leaves alone but for their case. None of them
    combines with another there, so words of them are left alone as well."""
    given = map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x250)))
    return "".join(c for c in given if (normalizer.normalize_str(c) if normalizer else c) == (c.lower() if lower else c))


#: Byte-level BPE's character for each byte, by the byte's own Latin-1 character.
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Encoder:
    """Ids of texts as bytes. ``by_word``: words are encoded once and kept, up to a bound."""

    def __init__(self, tokenizer_path: str, by_word: bool) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_path)
        self.model = self.lib.model
        self.wide = self.lib.get_vocab_size() > 1 << 16
        self.dtype = "<u4" if self.wide else "<u2"
        self.by_word, self.known, self.older, self.parts = by_word, {}, {}, {}
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = None
        if steps := plain_steps(spec):
            self.lower, self.cut = steps[0], regex.compile(steps[1] + "|\n")
            added = "|".join(regex.escape(t["content"]) for t in spec.get("added_tokens", []))
            self.added = regex.compile(f"(?i:{added})") if added else None
            self.plain = re.compile(f"(?m)^[{re.escape(plain_chars(self.lib.normalizer, self.lower))}]+$")

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 4096):
            for e in self.lib.encode_batch(texts[at : at + 4096], add_special_tokens=False):
                yield np.array(e.ids, self.dtype).tobytes()

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word, from calls on many words with a space between; offsets tell whose ids they are."""
        size = np.dtype(self.dtype).itemsize
        for at in range(0, len(words), 400):
            part = words[at : at + 400]
            found = self.lib.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, self.dtype).tobytes()
            starts = np.fromiter(map(itemgetter(0), found.offsets), np.int64, len(ids) // size)
            ends = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)).tolist()
            for lo, hi in zip([0, *ends], ends, strict=False):
                yield ids[size * lo : size * hi]

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """The words that ``_encode_plain`` takes."""
        joined = b"\n".join(words).decode()
        found = self.plain.findall(joined)
        if self.added and self.added.search(joined):
            found = [w for w in found if not self.added.search(w)]
        return "\n".join(found).encode().split(b"\n") if found else []

    def _encode_plain(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of words of plain characters, by their parts."""
        joined = b"\n".join(words + [b""]).decode()
        if len(self.parts) > MOST_CACHED:
            self.parts = {}
        parts, tokenize, word = self.parts, self.model.tokenize, []
        for p in self.cut.findall(joined.lower() if self.lower else joined):
            if p == "\n":
                yield b"".join(word)
                word = []
                continue
            ids = parts.get(p)
            if ids is None:
                given = p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARS)
                ids = np.array([t.id for t in tokenize(given)], self.dtype).tobytes()
                if len(p) <= LONGEST_CACHED:
                    parts[p] = ids
            word.append(ids)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.by_word:
            return list(self._encode([(t or b"").decode() for t in texts]))
        split = [(t or b"").split() for t in texts]
        missing = set().union(*split).difference(self.known)
        again = missing.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        new = list(missing - again)
        plain = self._plain(new) if self.plain else []
        rest = list(set(new).difference(plain)) if plain else new
        self.known.update(zip(plain, self._encode_plain(plain), strict=True))
        self.known.update(zip(rest, self._encode_words([w.decode() for w in rest]), strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in new:
            if len(w) > LONGEST_CACHED:
                del self.known[w]
        if len(self.known) > MOST_CACHED:
            self.known, self.older = {}, self.known
        return out


_ENCODERS: dict = {}


def encoder(path: str, by_word: bool) -> Encoder:
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = Encoder(path, by_word)
    return _ENCODERS[path, by_word]


def splits_at_space(tokenizer_path: str) -> bool:
    """Whether the file's pre-tokenizer drops white space, no other part looks across it,
    and no added token holds a space or takes space beside it."""
    import json

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    drops = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and r"[^\s\p{L}\p{N}]" in p["pattern"].get("Regex", "") for p in parts)
    prefix = any(p.get("add_prefix_space") for p in parts)
    plain = all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return drops and not prefix and plain


def write_records(df: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", key: str = "doc_id", path: str | None = None) -> tuple[str, DataFrame]:
    """Writes data and index files; gives their folder and the manifest: place (in
    ascending order of keys), file, n_docs, n_tokens, bytes."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "tokens")
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    by_word = splits_at_space(tokenizer_path)
    given = df.select(col(key).cast("long").alias("key"), col(text).alias("t"))
    ordered = given.repartitionByRange(F.col("key").isNull(), F.col("key")).sortWithinPartitions(F.col("key").isNull(), F.col("key"))

    def run(batches):
        enc = encoder(tokenizer_path, by_word)
        end = np.array([end_id], enc.dtype).tobytes()
        place = TaskContext.get().partitionId()
        name = f"part-{place:06d}-{uuid.uuid4().hex}"
        fs, root = filesystem(path)
        docs = tokens = at = 0
        out, index = None, [MAGIC]
        for batch in batches:
            for part in pieces(batch, 1):
                out = out or fs.open_output_stream(f"{root}/{name}.rec")
                for k, ids in zip(part.column(0).to_pylist(), enc.encode(list(raw_texts(part.column(1)))), strict=True):
                    record = framed(packed(k, ids + end, enc.wide))
                    n = len(ids) // len(end) + 1
                    out.write(record)
                    index.append(struct.pack("<QQ", at, n))
                    at, docs, tokens = at + len(record), docs + 1, tokens + n
        if out:
            out.close()
            data = b"".join(index)
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(data + struct.pack("<I", masked(data)))
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "file": [name], "n_docs": [docs], "n_tokens": [tokens], "bytes": [at]})

    return path, written(ordered.mapInArrow(run, "place int, file string, n_docs long, n_tokens long, bytes long"), "token-manifest")


def read_records(path: str, manifest: DataFrame) -> DataFrame:
    """From the files: key, start (ids of all records before it), ids, one row for each record. Only a
    row for each file comes to the driver."""
    return _read(path, manifest, lambda key, start, ids: (key, start, ids.tolist()), [("key", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))], "key long, start long, ids array<long>")


def read_digests(path: str, manifest: DataFrame) -> DataFrame:
    """As ``read_records``, with the number of ids and the crc32 of all as u32 in their place."""
    return _read(
        path, manifest, lambda key, start, ids: (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
        [("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())], "key long, start long, n_tokens long, ids_crc32 long",
    )


def _read(path, manifest, row, fields, schema):
    spark = manifest.sparkSession
    files = sorted((r["place"], r["file"], r["n_tokens"]) for r in manifest.select("place", "file", "n_tokens").collect())
    todo, start = [], 0
    for _, name, n in files:
        todo.append((name, start))
        start += n
    if not todo:
        return spark.createDataFrame([], schema)
    given = spark.createDataFrame(todo, "file string, start long").repartition(max(1, len(todo)))

    def run(batches):
        fs, root = filesystem(path)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}.idx") as f:
                    index = read_index(f.read())
                rows = []
                with fs.open_input_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as f:
                    for (_, n), payload in zip(index.tolist(), records(f), strict=True):
                        key, ids = unpacked(payload)
                        if len(ids) != n:
                            raise ValueError("the index does not fit the data")
                        rows.append(row(key, at, ids))
                        at += n
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[k for k, _ in fields])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[k for k, _ in fields])

    return given.mapInArrow(run, schema)
