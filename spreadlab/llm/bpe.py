"""BPE encoding and decoding through a table of distinct words.

Texts are cut at blanks, tabs and line ends into words, which no token crosses (the vocabulary's tokenizer drops white
space), so a text's ids are its words' ids in order.

1. Each input partition numbers its distinct words by first appearance, in blocks of about ``LOCAL`` words, and sends
   each block's words on, packed by hash into buckets.
2. A bucket has all rows of its words: each distinct word of the corpus is encoded once there, and the ids of a block's words
   go back in the order in which these came.  A word has one place in each block, however often it comes.
3. A block's answers are its dictionary, in a file of the shared folder.  The texts are read again, their words numbered in the
   same way, and ids join back by position.  A block whose words are not those that were numbered before (an input
   that changes between two reads) is an error.

Decoding joins each id with the vocabulary's table of pieces.

Nulls, ties and odd rows: null counts as empty and has no tokens; words of any length, and special
tokens spelt out in a text, go through the tokenizer itself; repeated rows get equal results.  An empty table gives an
empty result.  Input columns named as a new one are kept, and the new ones get underscores before their names.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm import _text as T
from spreadlab.llm._session import partitions_of, shared_dir, shipped, unused

#: Distinct words from which a block is closed after a text; bits of a block's number within its partition; words of which ids are gathered at once.
LOCAL, SUB, RUN = 150_000, 24, 1 << 17
#: Words of any kind from which a block is closed, so that repetitive texts are not held without end (4 bytes a word).
MOST = 1 << 24
_SPACES = str.maketrans("\n\t\r", "   ")
_TOKENIZERS: dict[str, object] = {}
# Fixed values of the dictionary files, and of a packed answer's head: bucket, words, check of the words, bytes packed and unpacked.
MAGIC, ENTRY, HEAD = b"WORDDIC1", np.dtype([("block", "<i8"), ("at", "<i8"), ("size", "<i8")]), struct.Struct("<IIIII")


def tokenizer(path: str):
    """The tokenizers library's encoder of a vocabulary file, held by the worker process."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def cut(text: str) -> list[str]:
    """The words of a text, in order; neighbouring blanks have an empty word between them."""
    return (text.translate(_SPACES) if "\t" in text or "\r" in text else text.replace("\n", " ")).split(" ")


def pieces(path: str) -> pa.Array:
    """The piece of each id."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece
    return pa.array(out, pa.string())


def decoded(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """Each list's ids joined with their pieces, which blanks part: what a tokenizer file without a decoder gives."""
    ids = ids.fill_null([]) if ids.null_count else ids
    flat = pa.ListArray.from_arrays(ids.offsets, table.take(ids.values))
    return pc.binary_join(flat, " ")


# Texts that a vocabulary is tried on.
PROBES = ("It's 5 o'clock, don't  panic!!\n(see: a.b/c) Émile_x 東京タワー, naïve ﬁ 1,234.50", "x\ty\r\nZ <|endoftext|> ... --- 　 q.", "")


def vouch(path: str) -> None:
    """Raises where a vocabulary's texts are not their words' ids, or decode to other than pieces and blanks."""
    t, table = tokenizer(path), pieces(path)
    for text in PROBES:
        ids = t.encode(text, add_special_tokens=False).ids
        if ids != [i for w in cut(text) for i in t.encode(w, add_special_tokens=False).ids]:
            raise ValueError(f"{path}: its tokens cross blanks, so texts cannot be encoded by word")
        if t.decode(ids, skip_special_tokens=False) != decoded(pa.array([ids], pa.list_(pa.int32())), table)[0].as_py():
            raise ValueError(f"{path}: it decodes to other than its pieces, parted by blanks")


# ---- words, in blocks ------------------------------------------------------------------------


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Numbers(dict):
    """The number of each word: how many others came before it."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def buckets(words: list[str], n: int):
    """(bucket, places of its words) in ascending order; within a bucket words keep their order."""
    buf, at = T.flat(pa.array(words, pa.large_string()))
    bucket = (T.spans_hash(buf, at[:-1], at[1:]) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cut) if len(order) else []:
        yield int(bucket[places[0]]), places


def requests(batches, local: int, most: int, n: int):
    """(bucket, block, words) of each block: its distinct words of each bucket, packed."""
    codec, numbers = pa.Codec("zstd", 1), Numbers()
    part = sub = read = 0

    def block():
        words, held = list(numbers), []
        spelt = np.array(words, object)
        for bucket, places in buckets(words, n):
            raw = "\n".join(spelt[places]).encode()
            held.append((bucket, part << SUB | sub, struct.pack("<I", len(raw)) + codec.compress(raw, asbytes=True)))
            if len(held) >= 256:
                yield _asked(held)
                held.clear()
        if held:
            yield _asked(held)

    for batch in batches:
        for x in _column(batch, "text"):
            part = _column(batch, "part")[0].as_py()
            words = cut(x.as_py() or "")
            deque(map(numbers.__getitem__, words), maxlen=0)
            read += len(words)
            if len(numbers) >= local or read >= most:
                yield from block()
                numbers.clear()
                sub, read = sub + 1, 0
    if numbers:
        yield from block()


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    bucket, block, words = zip(*rows, strict=True)
    return pa.record_batch({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.int64()), "words": pa.array(words, pa.binary())})


def encode_words(batches, path: str, width: int):
    """(block, bucket, answer) of requests sorted by bucket: each distinct word of a bucket is encoded once."""
    t, codec, kind = tokenizer(path), pa.Codec("zstd", 1), "H" if width == 2 else "I"
    current, table = None, {}
    for batch in batches:
        out = []
        for bucket, packed in zip(_column(batch, "bucket").to_pylist(), _column(batch, "words").to_pylist(), strict=True):
            if bucket != current:
                current, table = bucket, {}
            raw = codec.decompress(packed[4:], struct.unpack_from("<I", packed)[0], asbytes=True)
            words = raw.decode().split("\n")
            new = [w for w in words if w not in table]
            table.update(zip(new, [array(kind, e.ids).tobytes() for e in t.encode_batch_fast(new, add_special_tokens=False)], strict=True))
            ids = [table[w] for w in words]
            answer = np.array([len(x) // width for x in ids], "<u4").tobytes() + b"".join(ids)
            small = codec.compress(answer, asbytes=True)
            out.append(HEAD.pack(bucket, len(words), zlib.crc32(raw), len(small), len(answer)) + small)
        yield pa.record_batch({"block": _column(batch, "block"), "bucket": _column(batch, "bucket"), "answer": pa.array(out, pa.binary())})


def place(files, draft: str, name: str) -> None:
    """Gives a whole file its name; another attempt's file of that name has the same content."""
    from pyarrow import fs

    if files.get_file_info(name).type == fs.FileType.NotFound:
        files.move(draft, name)
    else:
        files.delete_file(draft)


def write_dictionaries(batches, folder: str):
    """Answers, sorted by (slot, block, bucket), to a file for each slot; (files) of each."""
    from spreadlab.llm.token_store import filesystem

    files, root = filesystem(folder)
    slot = out = draft = None
    entries: list[list[int]] = []

    def end_slot():
        out.write(np.array(list(map(tuple, entries)), ENTRY).tobytes() + struct.pack("<Q", len(entries)) + MAGIC)
        out.close()
        place(files, draft, f"{root}/{_name(slot)}")
        entries.clear()

    for batch in batches:
        for s, block, answer in zip(*(_column(batch, c).to_pylist() for c in ("slot", "block", "answer")), strict=True):
            if s != slot:
                if out is not None:
                    end_slot()
                slot = s
                files.create_dir(root, recursive=True)
                draft = f"{root}/.{_name(slot)}.{uuid.uuid4().hex}"
                out = files.open_output_stream(draft)
            if not entries or entries[-1][0] != block:
                entries.append([block, out.tell(), 0])
            out.write(answer)
            entries[-1][2] += len(answer)
    if out is not None:
        end_slot()
        yield pa.record_batch({"files": pa.array([1], pa.int64())})


def _name(slot: int) -> str:
    return f"words-{slot:06d}.dic"


def _slot(part: int, sub: int, slots: int) -> int:
    return (part + 7919 * sub) % slots


CHANGED = "the input is not the one whose words were numbered: it must read the same twice"


def dictionary(folder: str, block: int, slots: int, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, ids): where the ids of each word of a block begin, how many there are, and all of them."""
    from pyarrow import fs

    from spreadlab.llm.token_store import filesystem

    files, root = filesystem(folder)
    name = f"{root}/{_name(_slot(block >> SUB, block & ((1 << SUB) - 1), slots))}"
    if files.get_file_info(name).type == fs.FileType.NotFound:
        raise ValueError(CHANGED)
    with files.open_input_file(name) as f:
        f.seek(f.size() - 16)
        count, magic = struct.unpack("<Q8s", f.read(16))
        if magic != MAGIC:
            raise ValueError("not a file of words")
        f.seek(f.size() - 16 - count * ENTRY.itemsize)
        entry = np.frombuffer(f.read(count * ENTRY.itemsize), ENTRY)
        entry = entry[entry["block"] == block]
        if not len(entry):
            raise ValueError(CHANGED)
        f.seek(int(entry["at"][0]))
        data = f.read(int(entry["size"][0]))
    codec, spelt = pa.Codec("zstd", 1), np.array(words, object)
    first, size, ids, base, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0, 0
    for bucket, places in buckets(words, slots):
        if at >= len(data):
            raise ValueError(CHANGED)
        b, n, check, packed, whole = HEAD.unpack_from(data, at)
        if (b, n, check) != (bucket, len(places), zlib.crc32("\n".join(spelt[places]).encode())):
            raise ValueError(CHANGED)
        raw = codec.decompress(data[at + HEAD.size : at + HEAD.size + packed], whole, asbytes=True)
        at += HEAD.size + packed
        counts = np.frombuffer(raw, "<u4", n).astype(np.int64)
        ids.append(np.frombuffer(raw, f"<u{width}", offset=4 * n))
        size[places], first[places] = counts, base + np.cumsum(counts) - counts
        base += len(ids[-1])
    if at != len(data):
        raise ValueError(CHANGED)
    return first, size, np.concatenate(ids) if ids else np.zeros(0, f"<u{width}")


def encoded(batches, folder: str, local: int, most: int, slots: int, width: int, field: str, part_field: str):
    """(rows, ids of their texts as a list array) in runs of about RUN words.

    The texts of a block are held as the numbers of their words until its last one is read; the rows go without them.
    """
    numbers, held, sub, part, read = Numbers(), [], 0, 0, 0

    def keep(lo: int, texts: list):
        rest = batch.drop_columns([field, part_field])
        held.append((rest.take(pa.array(np.arange(lo, lo + len(texts)))), texts))  # a copy: a slice would hold the whole batch

    def block():
        none = np.zeros(0, np.int64)
        first, size, ids = dictionary(folder, part << SUB | sub, slots, list(numbers), width) if numbers else (none, none, none)
        for rows, texts in held:
            lo = 0
            while lo < len(texts):
                hi, words = lo, 0
                while hi < len(texts) and (hi == lo or words + len(texts[hi]) <= RUN):
                    words, hi = words + len(texts[hi]), hi + 1
                which = np.concatenate(texts[lo:hi])
                n = size[which]
                end = np.cumsum(n)
                flat = ids[np.repeat(first[which] - (end - n), n) + np.arange(int(n.sum()))].astype("<i4")
                at = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum([len(x) for x in texts[lo:hi]])])]
                yield rows.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                lo = hi

    for batch in batches:
        done, texts = 0, []
        for x in _column(batch, field):
            part = _column(batch, part_field)[0].as_py()
            words = cut(x.as_py() or "")
            texts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            read += len(words)
            if len(numbers) >= local or read >= most:
                keep(done, texts)
                yield from block()
                done, texts, held, sub, read = done + len(texts), [], [], sub + 1, 0
                numbers.clear()
        if texts:
            keep(done, texts)
    if held:
        yield from block()


def _digests(ids: pa.ListArray, table: pa.Array) -> list[pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256 of each list."""
    at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
    texts = decoded(ids, table)
    ends, raw = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].tolist(), memoryview(texts.buffers()[2] or b"")
    own = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    back = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [pa.array(np.diff(at).astype(np.int64)), pa.array(own, pa.string()), pa.array(back, pa.string())]


def encode_texts(batches, path: str, field: str, part_field: str, names: list[str], **kw):
    """The rows, with n_tokens, ids_sha256, decoded_sha256 and token_ids in place of the text."""
    table = pieces(path)
    for rows, ids in encoded(batches, field=field, part_field=part_field, **kw):
        yield pa.RecordBatch.from_arrays([*rows.columns, *_digests(ids, table), ids], [*rows.schema.names, *names])


def digest(batches, path: str, **kw):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), from the ids and what they decode to."""
    table = pieces(path)
    for rows, ids in encoded(batches, field="text", part_field="part", **kw):
        yield pa.RecordBatch.from_arrays([_column(rows, "doc_id"), *_digests(ids, table)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def read_back(batches, table: list[str], ids_field: str, out_field: str):
    """The rows, with what their ids decode to."""
    table = pa.array(table, pa.string())
    for batch in batches:
        ids = _column(batch, ids_field).cast(pa.list_(pa.int32()))
        for lo in range(0, batch.num_rows, 256):
            own = batch.slice(lo, 256)
            some = ids.slice(lo, 256)
            some = pa.array(some.to_pylist(), some.type) if some.offset else some
            yield pa.RecordBatch.from_arrays([*own.columns, decoded(some, table)], [*own.schema.names, out_field])


# ---- Spark -----------------------------------------------------------------------------------


def dictionaries(rows: DataFrame, path: str, local: int, most: int = MOST) -> dict:
    """Encodes the distinct words of rows (part, text) and writes each block's; what ``encoded`` needs to read them."""
    vouch(path)
    width, n, folder = (2 if len(pieces(path)) <= 1 << 16 else 4), partitions_of(rows), shared_dir(rows.sparkSession)
    asked = rows.select("part", "text").mapInArrow(shipped(requests, local=local, most=most, n=n), "bucket int, block long, words binary")
    got = asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(shipped(encode_words, path=path, width=width), "block long, bucket int, answer binary")
    slot = F.pmod(F.shiftright("block", SUB) + 7919 * F.col("block").bitwiseAND((1 << SUB) - 1), F.lit(n)).cast("int")
    got = got.withColumn("slot", slot).repartition(n, "slot").sortWithinPartitions("slot", "block", "bucket")
    got.mapInArrow(shipped(write_dictionaries, folder=folder), "files long").groupBy().sum("files").first()
    return {"folder": folder, "local": local, "most": most, "slots": n, "width": width}


NEW = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "token_ids": "array<int>"}


def encode(docs: DataFrame, path: str, text_col: str = "text", local: int = LOCAL) -> DataFrame:
    """All rows and columns of docs, a table that reads the same twice; the text gives way to n_tokens, ids_sha256, decoded_sha256 and token_ids."""
    (part,), names = unused(docs, "part"), unused(docs, *NEW)
    rows = docs.withColumn(text_col, docs[text_col].cast("string")).withColumn(part, F.spark_partition_id())
    book = dictionaries(rows.select(F.col(part).alias("part"), F.col(text_col).alias("text")), path, local)
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != text_col), *(f"{c} {t}" for c, t in zip(names, NEW.values(), strict=True))])
    return rows.mapInArrow(shipped(encode_texts, path=path, field=text_col, part_field=part, names=names, **book), kinds)


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """All rows and columns of tokens, and out_col: their ids joined with the vocabulary's pieces, which blanks part; null for null."""
    vouch(path)
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in tokens.dtypes), f"{out_col} string"])
    out = tokens.mapInArrow(shipped(read_back, table=pieces(path).to_pylist(), ids_field=ids_col, out_field=out_col), kinds)
    return out.withColumn(out_col, F.when(F.col(ids_col).isNotNull(), F.col(out_col)))


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", local: int = LOCAL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs, a table that reads the same twice."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.spark_partition_id().alias("part"))
    book = dictionaries(rows, path, local)
    return rows.mapInArrow(shipped(digest, path=path, **book), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
