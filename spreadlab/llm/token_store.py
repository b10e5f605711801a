"""Binary shards of token ids with a minimal perfect hash over the documents' keys.

A shard is one file, in ascending key order:

    magic "TOKSHRD1" | payload: ids, 16 or 32 bits each | records: key, null flag, first id, count |
    levels of the hash: words of bits, and set bits before each word | slots: fingerprint, record, repeats | footer

The hash sets, level by level, the bit of each key that no other key shares, and carries the rest on to
the next level; a key's slot is the number of bits set before its own.  A lookup reads one bit
a level, one slot and one record, whatever the shard's size; the fingerprint turns away keys that
are not there.  A key that comes several times has one slot, which names its first record and their number.

Documents are dealt to shards by ranges of (key, hash of text, row), so a key with very many rows spreads over
shards.  Where a shard starts in the whole sequence is the sum of those before it.  ``lookup`` sends keys to the
shards whose range of keys has them, and finds them there through the hash.

Nulls, ties and odd rows: a null text counts as empty, with the end id alone; null keys come first and are not
in the index (``without_key`` reads them); rows of one key are ordered by their text.  Repeated rows are stored as often
as they come.  An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import gc
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm import _text as T
from spreadlab.llm._session import partitions_of, shared_dir, shipped
from spreadlab.llm.bpe import PROBES, tokenizer

# Fixed values of the file format.
MAGIC = b"TOKSHRD1"
FOOTER = struct.Struct("<QQQQQQ8s")  # ids, bytes of an id, records, slots, levels, first byte of the records, magic
RECORD = np.dtype([("key", "<i8"), ("null", "<u8"), ("start", "<u8"), ("count", "<u8")])
SLOT = np.dtype([("fingerprint", "<u4"), ("record", "<u4"), ("repeats", "<u8")])
#: Bits of a level for each key on it; parts of texts of which ids are held before older ones may go; bytes of ids in a batch that is read.
GAMMA, LOCAL, BATCH = 2, 700_000, 4 << 20


# ---- minimal perfect hash -------------------------------------------------------------------


def _hash(key: np.ndarray, level: int) -> np.ndarray:
    return T.mix(key.astype(np.int64).view(np.uint64) * T.M3 + np.uint64(level * int(T.M4) % 2**64))


def fingerprint(key: np.ndarray) -> np.ndarray:
    return (_hash(key, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build_index(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (words of bits, bits set before each word, over all levels) for distinct keys."""
    levels, left, before = [], keys, 0
    while len(left):
        words = max(1, -(-GAMMA * len(left) // 64))
        at = _hash(left, len(levels)) % np.uint64(64 * words)
        _, inverse, n = np.unique(at, return_inverse=True, return_counts=True)
        alone = n[inverse] == 1
        bits = np.zeros(words, np.uint64)
        np.bitwise_or.at(bits, (at[alone] // np.uint64(64)).astype(np.int64), np.uint64(1) << (at[alone] % np.uint64(64)))
        count = np.bitwise_count(bits).astype(np.uint64)
        levels.append((bits, before + np.cumsum(count) - count))
        before += int(count.sum())
        left = left[~alone]
    return levels


def slot_of(keys: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slot of each key, -1 where no level has it."""
    out = np.full(len(keys), -1, np.int64)
    todo = np.arange(len(keys))
    for level, (bits, before) in enumerate(levels):
        at = _hash(keys[todo], level) % np.uint64(64 * len(bits))
        word, bit = (at // np.uint64(64)).astype(np.int64), at % np.uint64(64)
        hit = (bits[word] >> bit) & np.uint64(1) == 1
        lower = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
        out[todo[hit]] = (before[word] + np.bitwise_count(lower))[hit].astype(np.int64)
        todo = todo[~hit]
    return out


# ---- files ----------------------------------------------------------------------------------


def filesystem(uri: str):
    """(file system, path) of a URI that driver and executors share."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class ShardWriter:
    """Ids are written as they come; 25 bytes for each record stay in memory."""

    def __init__(self, out, width: int):
        self.out, self.kind, self.ids = out, np.dtype(f"<u{width}"), 0
        self.key, self.null, self.start, self.count = array("q"), array("B"), array("Q"), array("Q")
        out.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        for column, x in ((self.key, key or 0), (self.null, key is None), (self.start, self.ids), (self.count, n)):
            column.append(x)
        self.ids += n
        self.out.write(ids)

    def close(self) -> None:
        records = np.zeros(len(self.key), RECORD)
        for name in RECORD.names:
            records[name] = np.frombuffer(getattr(self, name), getattr(self, name).typecode) if len(records) else 0
        keyed = np.flatnonzero(records["null"] == 0)
        self.keys, first, repeats = np.unique(records["key"][keyed], return_index=True, return_counts=True)
        levels = build_index(self.keys)
        slots = np.zeros(len(self.keys), SLOT)
        at = slot_of(self.keys, levels)
        slots["fingerprint"][at], slots["record"][at], slots["repeats"][at] = fingerprint(self.keys), keyed[first], repeats
        self.out.write(records.tobytes())
        for bits, before in levels:
            self.out.write(struct.pack("<Q", len(bits)) + bits.tobytes() + before.astype("<u8").tobytes())
        self.out.write(slots.tobytes())
        self.out.write(FOOTER.pack(self.ids, self.kind.itemsize, len(records), len(slots), len(levels), len(MAGIC) + self.ids * self.kind.itemsize, MAGIC))


class Shard:
    """A shard's index in memory; payloads are read by offset."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - FOOTER.size)
        self.ids, self.width, records, slots, levels, at, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        file.seek(at)
        rest = memoryview(file.read(end - FOOTER.size - at))
        self.records = np.frombuffer(rest, RECORD, records)
        at, self.levels = records * RECORD.itemsize, []
        for _ in range(levels):
            (words,) = struct.unpack_from("<Q", rest, at)
            both = np.frombuffer(rest, "<u8", 2 * words, at + 8)
            self.levels.append((both[:words], both[words:]))
            at += 8 + 16 * words
        self.slots = np.frombuffer(rest, SLOT, slots, at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first record of each key, and how many there are; -1 and 0 where the shard does not have it."""
        at = slot_of(keys, self.levels)
        if not len(self.slots):
            return at, np.zeros(len(keys), np.int64)
        slot = self.slots[np.maximum(at, 0)]
        found = slot["record"].astype(np.int64)
        ok = (at >= 0) & (slot["fingerprint"] == fingerprint(keys)) & (self.records["key"][found] == keys) & (self.records["null"][found] == 0)
        return np.where(ok, found, -1), np.where(ok, slot["repeats"].astype(np.int64), 0)

    def payload(self, record: int) -> np.ndarray:
        r = self.records[record]
        self.file.seek(len(MAGIC) + int(r["start"]) * self.width)
        return np.frombuffer(self.file.read(int(r["count"]) * self.width), f"<u{self.width}")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document under a key."""
        first, n = (int(x[0]) for x in self.find(np.array([key], np.int64)))
        return [self.payload(i) for i in range(first, first + n)]


# ---- encoding -------------------------------------------------------------------------------

#: A blank between two characters that are no white space: a token always starts there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: What makes a text go the careful way: white space other than single blanks and line ends, found by plain search.
_ODD_ASCII = ("  ", " \n", "\n ", "\n\n", *map(chr, (9, 11, 12, 13, 28, 29, 30, 31)))
_ODD = (*_ODD_ASCII, *(chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: A part that the pattern cuts into one word of plain letters and one sign: the library's model takes the word as it is.
_PLAIN = re.compile("([A-Za-z]+)([.,;:!?]?)").fullmatch


class Parts(dict):
    """The ids of each part, encoded when it first comes.  Parts that were not met for LOCAL others are forgotten."""

    def __init__(self, path: str, kind: str):
        t = tokenizer(path)
        self.older, self.kind, self.encode, self.word = {}, kind, t.encode, None
        if t.normalizer is None and re.match(r"ByteLevel\(add_prefix_space=False.*use_regex=True", str(t.pre_tokenizer)):
            self.word = t.model.tokenize
            self.sign = {c: array(kind, t.encode(c, add_special_tokens=False).ids).tobytes() for c in ("", *".,;:!?")}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            plain = self.word and _PLAIN(part)
            if plain:
                ids = array(self.kind, [x.id for x in self.word("\u0120" + plain[1])]).tobytes() + self.sign[plain[2]]
            else:
                whole = part if part[0] == "\n" else part[1:] if part[0] == " " else " " + part
                ids = array(self.kind, self.encode(whole, add_special_tokens=False).ids).tobytes()
        self[part] = ids
        return ids

    def age(self) -> None:
        if len(self) > LOCAL:
            self.older = dict(self)
            self.clear()


class ByteCoder:
    """Ids by part for a byte-level BPE, in which a token takes at most the one blank before it.

    Texts are cut only where the vocabulary's pattern cannot join both sides, and each part is encoded by the tokenizers library.
    """

    def __init__(self, path: str, width: int):
        self.parts = Parts(path, "H" if width == 2 else "I")

    @staticmethod
    def cut(text: str) -> list[str]:
        """Names of the parts that make up the text: the first one after a blank, those after a line end with it, all others without the blank before them."""
        if text and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in (_ODD_ASCII if text.isascii() else _ODD)):
            return _named(text.replace("\n", " \n").split(" "))
        return _named(_CUT.split(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.parts.__getitem__
        out = [b"".join(map(get, self.cut(t))) for t in texts]
        self.parts.age()
        return out


def _named(parts: list[str]) -> list[str]:
    parts[0] = " " + parts[0]
    return parts


def vouch(path: str, width: int, end_id: int) -> None:
    """Raises where a vocabulary's texts are not their parts' ids, or ids do not fit."""
    t, texts = tokenizer(path), [*PROBES, *(x.replace(" ", "  ") for x in PROBES), " a\n\n b \n", "x\ny z"]
    if max(end_id, *t.get_vocab(with_added_tokens=True).values()) >= 1 << 8 * width:
        raise ValueError(f"ids of {path} do not fit {width} bytes")
    if [np.frombuffer(x, f"<u{width}").tolist() for x in ByteCoder(path, width).encode(texts)] != [t.encode(x, add_special_tokens=False).ids for x in texts]:
        raise ValueError(f"{path}: its tokens cross the blanks between words, so texts cannot be encoded by part")


_CODERS: dict[tuple[str, int], ByteCoder] = {}


def _slices(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) in runs of about so many characters."""
    keys, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
    lo, some, held = 0, [], 0
    for x in texts:
        some.append(x.as_py() or "")
        held += len(some[-1])
        if held >= size:
            yield keys.slice(lo, len(some)).to_pylist(), some
            lo, some, held = lo + len(some), [], 0
    if some:
        yield keys.slice(lo, len(some)).to_pylist(), some


def write_shards(batches, path: str, folder: str, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """One row for this partition: (part, name, ids, documents, first, last); the file appears under its name when it is whole."""
    files, root = filesystem(folder)
    writer, coder = None, _CODERS.setdefault((path, width), ByteCoder(path, width))  # kept by the worker process
    end = np.array([end_id], f"<u{width}").tobytes()
    gc.disable()  # parts make no cycles; at its end the task collects
    for batch in batches:
        for keys, texts in _slices(batch):
            if writer is None:
                part = _partition_id()
                name = f"shard-{part:06d}-{uuid.uuid4().hex[:12]}.tok"  # another attempt writes another file, which nobody names
                files.create_dir(root, recursive=True)
                stream = files.open_output_stream(f"{root}/.{name}")
                writer = ShardWriter(stream, width)
            for key, ids in zip(keys, coder.encode(texts), strict=True):
                writer.add(key, ids + end)
    gc.enable()
    if writer is not None:
        writer.close()
        stream.close()
        files.move(f"{root}/.{name}", f"{root}/{name}")
        own = writer.keys
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "name": pa.array([name]), "ids": pa.array([writer.ids], pa.int64()), "documents": pa.array([len(writer.key)], pa.int64()), "first": pa.array([int(own[0]) if len(own) else None], pa.int64()), "last": pa.array([int(own[-1]) if len(own) else None], pa.int64())})


def _partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def write_tokens(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, width: int = 2) -> DataFrame:
    """Writes docs as shards in ``folder`` and returns (name, start, ids, documents, first, last) for each, the last two its least and largest key.

    Ids must fit ``width`` bytes.  Range partitions follow the input's own splits.
    """
    vouch(path, width, end_id)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    rows = rows.repartitionByRange(partitions_of(docs), *order, "row").sortWithinPartitions(*order, "text", "row").select("doc_id", "text")
    found = rows.mapInArrow(shipped(write_shards, path=path, folder=folder, width=width, end_id=end_id), "part int, name string, ids long, documents long, first long, last long").collect()  # a row for each shard
    start, out = 0, []
    for r in sorted(found, key=lambda r: r.part):
        out.append((r.name, start, r.ids, r.documents, r.first, r.last))
        start += r.ids
    return docs.sparkSession.createDataFrame(out, "name string, start long, ids long, documents long, first long, last long")


def route(batches, firsts: list[int], lasts: list[int], shards: list[int]):
    """(shard, key) for each shard that may have a key: ranges ascend, and neighbours may share a key."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        lo, hi = np.searchsorted(lasts, keys, side="left"), np.searchsorted(firsts, keys, side="right")
        n = np.maximum(hi - lo, 0)
        at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield pa.record_batch({"shard": pa.array(np.asarray(shards, np.int32)[at]), "key": pa.array(np.repeat(keys, n))})


def _documents(shard: Shard, base: int, records: np.ndarray):
    """Batches (doc_id, start, n_tokens, ids) of a shard's records, of bounded size."""
    held, size = [], 0
    for k, i in enumerate(records.tolist()):
        held.append(shard.payload(i).astype("<u4").tobytes())
        size += len(held[-1])
        if size >= BATCH or k + 1 == len(records):
            own = shard.records[records[k + 1 - len(held) : k + 1]]
            yield pa.record_batch({"doc_id": pa.array(own["key"].astype(np.int64), mask=own["null"] == 1), "start": pa.array(base + own["start"].astype(np.int64)), "n_tokens": pa.array(own["count"].astype(np.int64)), "ids": pa.array(held, pa.binary())})
            held, size = [], 0


def find_keys(batches, folder: str, shards: list[tuple[str, int]]):
    """The documents under keys that come sorted by shard, each found through its shard's hash."""
    files, root = filesystem(folder)

    def of(number: int, keys: np.ndarray):
        name, base = shards[number]
        with files.open_input_file(f"{root}/{name}") as file:
            shard = Shard(file)
            first, n = shard.find(np.unique(keys))
            yield from _documents(shard, base, np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))

    current, held = None, []
    for batch in batches:
        number, keys = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("shard", "key"))
        for a, b in zip(*_runs(number), strict=True):
            if number[a] != current and held:
                yield from of(current, np.concatenate(held))
                held = []
            current = int(number[a])
            held.append(keys[a:b])
    if held:
        yield from of(current, np.concatenate(held))


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return first.tolist(), [*first[1:].tolist(), len(x)][: len(first)]


def read_nulls(batches, folder: str):
    """The documents without a key, which come first in their shards."""
    files, root = filesystem(folder)
    for batch in batches:
        for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with files.open_input_file(f"{root}/{name}") as file:
                shard = Shard(file)
                yield from _documents(shard, base, np.flatnonzero(shard.records["null"] == 1))


DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def lookup(keys: DataFrame, shards: DataFrame, folder: str, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents under the distinct ``keys``; ids as little-endian 32-bit integers.

    Keys that no shard has, and null, have no row.
    """
    known = shards.orderBy("start", "name").collect()  # a row for each shard
    keyed = [i for i, r in enumerate(known) if r["first"] is not None]
    wanted = keys.select(keys[key_col].cast("long").alias("key")).where("key is not null").distinct()
    if not keyed:
        return keys.sparkSession.createDataFrame([], DOCUMENT)
    sent = wanted.mapInArrow(shipped(route, firsts=[known[i]["first"] for i in keyed], lasts=[known[i]["last"] for i in keyed], shards=keyed), "shard int, key long")
    sent = sent.repartition(min(len(keyed), partitions_of(wanted)), "shard").sortWithinPartitions("shard")
    return sent.mapInArrow(shipped(find_keys, folder=folder, shards=[(r["name"], r["start"]) for r in known]), DOCUMENT)


def without_key(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents whose key is null."""
    some = shards.where(F.col("documents") > 0).select("name", "start")
    return some.repartition(max(1, min(some.count(), partitions_of(some)))).mapInArrow(shipped(read_nulls, folder=folder), DOCUMENT)


def stored_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs to shards in the shared folder, and reads back each document by its key."""
    folder = shared_dir(docs.sparkSession)
    shards = write_tokens(docs, path, folder, id_col, text_col)
    found = lookup(docs, shards, folder, id_col)
    if docs.where(docs[id_col].isNull()).limit(1).count():
        found = found.unionByName(without_key(shards, folder))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
