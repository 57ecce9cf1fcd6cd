"""Raw id payloads in shards, with a minimal perfect hash from document keys to their place.

A shard is two files. NAME.ids holds nothing but the ids, little-endian, two bytes each if the vocabulary fits and four
otherwise, document after document in ascending key order. NAME.idx (numpy .npz, uncompressed) holds the hash's levels
and, in the hash's order, a 64-bit fingerprint of each key and the number of its first document; `starts` holds where
each document begins. A lookup is a few hashes, one fingerprint comparison and one slice of the payload, whatever the
shard's size. manifest.json lists the shards with their key ranges and the ids before them.

Defined results: null text is empty (it holds the end id alone); documents that share a key lie next to each other, in
order of their text, and a lookup returns all of them; null keys come first; an empty table gives no shard. Keys are whole
numbers (others are refused). Very long texts are encoded whole, a batch being bounded by bytes as well as by rows. Other
columns, whatever their names, play no part. Without `out`, shards go to the application's scratch folder, which is deleted
when the driver ends.
"""

from __future__ import annotations

import io
import json
import os
import re
import sys
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, give_back, scratch

GAMMA = 2.0


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit values for each seed."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n-1, each once, in about 3.5 bits a key.

    On each level the keys that are left hash into twice as many bits; a bit hit by one key alone is that key's, the
    others go on to the next level. A key's number is the count of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [len(x) * 64 for x in levels]
        self.ranks, before = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            ends = np.cumsum(counts)
            self.ranks.append(before + ends - counts)
            before += int(ends[-1]) if len(ends) else 0
        self.n = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            words = -(-int(len(left) * GAMMA) // 64) or 1
            at = (_mix(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone[at]]
            if len(levels) > 500:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some keys that are not in the set, an arbitrary number for others."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, words in enumerate(self.levels):
            if not len(left):
                break
            at = _mix(keys[left], k) % np.uint64(self.sizes[k])
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ranks[k][word] + below)[hit]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return _mix(keys.astype(np.uint64), 1 << 20)


def _at(uri: str):
    """A filesystem and the path in it: local for file: and plain paths, else what pyarrow knows by the scheme."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, parts) -> None:
    """Writes under another name first, so that a repeated or lost task leaves whole files or none."""
    files, path = _at(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        for x in parts:
            out.write(x)
    files.move(part, path)


def get(uri: str):
    files, path = _at(uri)
    return files.open_input_file(path)


class ShardWriter:
    """Takes documents in key order, then closes into the two files of a shard.

    The payload streams to its file; memory holds 16 bytes a document and one buffer.
    """

    def __init__(self, uri: str, width: int):
        self.uri, self.type = uri, np.dtype("<u2" if width == 2 else "<u4")
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        files, path = _at(uri + ".ids")
        files.create_dir(os.path.dirname(path), recursive=True)
        self._files, self._path, self._part = files, path, f"{path}.{uuid.uuid4().hex}.part"
        self._out = files.open_output_stream(self._part, buffer_size=1 << 20)

    def add(self, key: int | None, ids: bytes) -> None:
        """ids: already as they are stored, little-endian and of the shard's width."""
        self.keys.append(key)
        self.lengths.append(len(ids) // self.type.itemsize)
        self._out.write(ids)

    def close(self) -> dict:
        self._out.close()
        self._files.move(self._part, self._path)
        nulls = sum(k is None for k in self.keys)
        keys = np.array([k for k in self.keys if k is not None], np.int64)
        distinct, first, runs = np.unique(keys, return_index=True, return_counts=True)
        mph = PerfectHash.build(distinct.view(np.uint64))
        place = mph(distinct.view(np.uint64))
        prints, entries, counts = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int32)
        prints[place], entries[place], counts[place] = fingerprints(distinct.view(np.uint64)), first + nulls, runs
        starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        held = io.BytesIO()
        np.savez(held, prints=prints, entries=entries, runs=counts, starts=starts, nulls=np.int64(nulls), width=np.int64(self.type.itemsize), n_levels=np.int64(len(mph.levels)), **{f"level{i}": x for i, x in enumerate(mph.levels)})
        put(self.uri + ".idx", [held.getvalue()])
        return {"docs": len(self.keys), "nulls": nulls, "ids": int(starts[-1]), "least": int(distinct[0]) if len(distinct) else None, "most": int(distinct[-1]) if len(distinct) else None}


class Shard:
    """A shard opened for reading. The index is in memory; the payload is read by slices."""

    def __init__(self, uri: str):
        with get(uri + ".idx") as f:
            z = np.load(io.BytesIO(f.read()))
        self.prints, self.entries, self.runs, self.starts, self.nulls = z["prints"], z["entries"], z["runs"], z["starts"], int(z["nulls"])
        self.mph = PerfectHash([z[f"level{i}"] for i in range(int(z["n_levels"]))])
        self.type = np.dtype("<u2" if int(z["width"]) == 2 else "<u4")
        self.payload = get(uri + ".ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the number of its first document and how many it has: (-1, 0) if it has none here."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        place = self.mph(keys) if self.mph.n else np.full(len(keys), -1, np.int64)
        ok = place >= 0
        ok[ok] = self.prints[place[ok]] == fingerprints(keys[ok])
        first, runs = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[ok], runs[ok] = self.entries[place[ok]], self.runs[place[ok]]
        return first, runs

    def ids(self, entry: int) -> np.ndarray:
        a, b, w = int(self.starts[entry]), int(self.starts[entry + 1]), self.type.itemsize
        return np.frombuffer(self.payload.read_at((b - a) * w, a * w), self.type)


@lru_cache(maxsize=8)
def _open(uri: str) -> Shard:
    return Shard(uri)


#: The normaliser and pre-tokeniser of which it is shown below that a text's ids are those of its words.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def wordwise(config: dict) -> bool:
    """Whether the ids of a text, by a tokenizer with this configuration, are those of its words one after another, words
    being cut at every space and line break.

    So it is for WORDWISE: no composition of NFC begins with or crosses an ASCII space; lower case goes character by
    character; every alternative of the pattern leaves white space out and none looks around, so matches lie within words
    and depend on nothing outside; byte-level pieces are encoded one by one. Strings of added tokens are looked for in the
    raw text, so they must hold no white space and not depend on what is around them. No truncation, padding or
    post-processor may look at the whole.
    """
    same = all(config.get(k) == v for k, v in WORDWISE.items())
    plain = all(not config.get(k) for k in ("truncation", "padding", "post_processor"))
    added = all(len(t["content"].split()) == 1 and t["content"].strip() == t["content"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in config.get("added_tokens", ()))
    return same and plain and added and config["model"]["type"] == "BPE" and not config["model"].get("dropout")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, whether it works word by word, and two generations of remembered words, kept for as long as the worker
    lives."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    return Tokenizer.from_file(path), wordwise(config), [{}, {}]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable characters of Latin-1 stand for themselves, the other bytes for 256 and on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: A word of letters that stay letters when composed and made small, and ASCII marks other than the apostrophe after them: a
#: piece of letters and perhaps one of marks, by WORDWISE's pattern.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_BYTE_LETTERS = _byte_letters()


def text_encoder(path: str, memory: int = 700_000):
    """texts -> list of two- or four-byte id strings, as the tokenizers library encodes each whole text with
    add_special_tokens=False: strings of special tokens in a text give their ids.

    Where the tokenizer is shown to work word by word (see wordwise), each distinct word goes through the library once: the
    pieces of simple words straight to its model, other words whole. At most `memory` words are remembered, some 250 bytes
    each, and those not asked for again are forgotten first. With any other tokenizer whole texts go through it.
    """
    tokenizer, by_word, generations = _tokenizer(path)
    letter = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
    kind = np.dtype("<u2" if letter == "H" else "<u4")
    pieces, marks = tokenizer.model.tokenize, {"": b""}

    def packed(ids: list[int]) -> bytes:
        return array(letter, ids).tobytes() if sys.byteorder == "little" else np.array(ids, kind).tobytes()

    def encoded(texts: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def word(w: str) -> bytes:
        m = _SIMPLE.fullmatch(w)
        if m is None:
            return encoded([w])[0]
        small, after = m[1].lower(), m[2]
        if not small.isascii():
            small = small.encode().decode("latin-1").translate(_BYTE_LETTERS)
        if (end := marks.get(after)) is None:
            if len(marks) > 100_000:
                marks.clear()
                marks[""] = b""
            end = marks[after] = packed([t.id for t in pieces(after)])
        return packed([t.id for t in pieces(small)]) + end

    def run(texts: list[str | None]) -> list[bytes]:
        if not by_word:
            return encoded([t or "" for t in texts])
        out = []
        for t in texts:
            if len(generations[0]) > memory // 2:
                generations[:] = [{}, generations[0]]
            known, older = generations
            words = (t or "").replace("\n", " ").split(" ")
            row = list(map(known.get, words))
            if None in row:
                for i, x in enumerate(row):
                    if x is None:
                        w = words[i]
                        if (x := known.get(w)) is None:
                            if (x := older.get(w)) is None:
                                x = word(w)
                            known[w] = x
                        row[i] = x
            out.append(b"".join(row))
        return out

    return run, kind


def _whole_keys(df: DataFrame, key: str) -> None:
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is {df.schema[key].dataType.simpleString()}: shards are kept by whole numbers")


def write_shards(docs: DataFrame, tokenizer: str, out: str | None = None, shards: int | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text") -> str:
    """Encodes whole texts, appends end_id to each and writes them in ascending key order. Returns the folder.

    One shuffle: rows go by key range to as many tasks as shards (default: spark.sql.shuffle.partitions), ranges being
    cut within equal keys by a hash of the text, so no single key fills a task. A task sorts, encodes and streams its
    payload. The driver gets one row a shard.
    """
    spark = docs.sparkSession
    _whole_keys(docs, key)
    bounded_batches(spark)
    out = out or scratch(spark, "shards")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, run = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                run, kind = text_encoder(tokenizer)
                writer = ShardWriter(f"{out}/shard-{shard:06d}", kind.itemsize)
                end = np.array([end_id], kind).tobytes()
            for at in range(0, batch.num_rows, 512):
                keys, texts = (batch.slice(at, 512).column(i).to_pylist() for i in (0, 1))
                for k, ids in zip(keys, run(texts), strict=True):
                    writer.add(k, ids + end)
        give_back()
        if writer is not None:
            x = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), **{c: pa.array([x[c]], pa.int64()) for c in ("docs", "nulls", "ids", "least", "most")}})

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spread = rows.repartitionByRange(n, F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")
    made = sorted((r.asDict() for r in spread.mapInArrow(write, "shard int, docs bigint, nulls bigint, ids bigint, least bigint, most bigint").collect()), key=lambda r: r["shard"])
    before = 0
    for r in made:
        r["before"], before = before, before + r["ids"]
    put(f"{out}/manifest.json", [json.dumps({"end_id": end_id, "ids": before, "shards": made}).encode()])
    return out


def manifest(out: str) -> dict:
    with get(f"{out}/manifest.json") as f:
        return json.loads(f.read())


def read_shards(keys: DataFrame, out: str, key: str = "doc_id") -> DataFrame:
    """Per document of the given keys: key, start, n_tokens, ids_crc32 (of ids as four bytes each), found by the hash.

    Each distinct key is looked up once and gives a row for each of its documents; keys that no shard holds give none.
    Keys are dealt by range first, so that a task opens only neighbouring shards.
    """
    spark = keys.sparkSession
    _whole_keys(keys, key)
    listed = manifest(out)["shards"]
    least = [r["least"] for r in listed if r["least"] is not None]
    most = [r["most"] for r in listed if r["most"] is not None]
    ranged = [r for r in listed if r["least"] is not None]
    null_shards = [r for r in listed if r["nulls"]]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []

            def emit(k, r, shard, entry, rows=rows):
                ids = shard.ids(entry)
                rows.append((k, r["before"] + int(shard.starts[entry]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))

            asked = batch.column(0).to_pylist()
            if None in asked:
                for r in null_shards:
                    shard = _open(f"{out}/shard-{r['shard']:06d}")
                    for entry in range(shard.nulls):
                        emit(None, r, shard, entry)
            wanted: dict[int, list[int]] = {}
            for k in asked:
                if k is not None:
                    for i in range(bisect_left(most, k), bisect_right(least, k)):
                        wanted.setdefault(i, []).append(k)
            for i, ks in sorted(wanted.items()):
                r = ranged[i]
                shard = _open(f"{out}/shard-{r['shard']:06d}")
                for k, first, run in zip(ks, *shard.find(np.array(ks, np.int64)), strict=True):
                    for entry in range(first, first + run):
                        emit(k, r, shard, entry)
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip((key, "start", "n_tokens", "ids_crc32"), cols, strict=True)})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = keys.select(F.col(key).cast("bigint").alias("key")).dropDuplicates().repartitionByRange(n, "key").sortWithinPartitions("key")
    return asked.mapInArrow(look, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
