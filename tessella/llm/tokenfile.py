"""Token-id files: texts encoded, Huffman-coded in independent blocks, and read back.

A folder holds ``codes`` (code length of each id, from counts over all documents) and ``blocks``. A block holds whole
documents in ascending id order: their ids and token counts, the bits, and the bit offset of every STRIDE-th id, from
which decoding can start. Blocks are rows of Parquet written through Spark's committers, so a lost executor's work is
redone and nothing is written twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman as H
from . import words as W
from .store import SLICE_BYTES, arrow_type, bounded_batches, dropped, map_texts, shared_folder, text_bytes, written

END = 2
#: Ids of a block, unless one document has more.
BLOCK = 1 << 16
#: Words that a worker remembers the ids of.
MEMO = 1_000_000
#: Words encoded in one call, and the character that parts them there; words that hold it are encoded one by one.
GROUP = 64
SEPARATOR = "\x01"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True

_encoders: dict[str, Encoder] = {}


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the same ids and fewer distinct words: ASCII in lower case, and a space before a single stop mark.

    The tokenizer lowers case and drops white space itself, and ends a token between a letter or digit and a mark. Only a
    mark that ends a word is parted. Batches that hold the start of a special token stay as they are.
    """
    if not len(data) or b"<|" in data.tobytes():
        return data, at
    low = _LOWER[data]
    after = np.ones(len(low), bool)
    after[:-1] = W.IS_GAP[low[1:]]
    after[at[1:][at[1:] > 0] - 1] = True
    before = np.zeros(len(low), bool)
    before[1:] = _ALNUM[low[:-1]]
    before[at[:-1][at[:-1] < len(low)]] = False
    cut = np.flatnonzero(_STOP[low] & after & before)
    return np.insert(low, cut, 32), at + np.searchsorted(cut, at)


#: What a tokenizer's file must declare for words to be encoded alone and in lower case. A fixed value, as such files state it.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed", "invert": True,
}


def words_stand_alone(spec: dict) -> bool:
    """Whether a tokenizer lowers case, drops white space and never joins what it parts; from its file."""
    stages = lambda part, key: ((spec.get(part) or {}).get(key) or [])
    special = [a["content"] for a in spec.get("added_tokens", [])]
    return stages("normalizer", "normalizers") == NORMALIZER and stages("pre_tokenizer", "pretokenizers")[:1] == [SPLIT] and all(t.startswith("<|") for t in special)


class Encoder:
    """Ids of texts. Where words stand alone, each run without ASCII white space is encoded by itself.

    Such runs repeat, and a worker remembers their ids; what is remembered never changes an id. Other tokenizers get
    whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.alone = words_stand_alone(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.separator = self._separator()
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _separator(self) -> int | None:
        """The id of the separator, where it stands for itself between words."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        alone, word = ids(SEPARATOR), ids("a")
        return alone[0] if len(alone) == 1 and ids(f"a {SEPARATOR} a") == [*word, *alone, *word] else None

    def clear(self, words: int = 0) -> None:
        """An empty memo: an open-addressed table of words, told apart by all their bytes and their length.

        It has room for MEMO words, or for those of a batch that has more.
        """
        self.room = max(MEMO, words)
        cells = 1 << (2 * self.room).bit_length()
        self.mask = np.uint64(cells - 1)
        self.slot = np.full(cells, -1, np.int32)
        self.known = np.zeros((4, 1 << 12), np.uint64)
        self.words = 0
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def _seek(self, hashed: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The memo's number of each word, -1 for an unknown one, and the cell where it is or would go."""
        cell = (hashed & self.mask).astype(np.int64)
        open_ = np.arange(len(hashed))
        while len(open_):
            number = self.slot[cell[open_]]
            other = (number >= 0) & (self.known[:, number] != word[:, open_]).any(0)
            open_ = open_[other]
            cell[open_] = (cell[open_] + 1) & int(self.mask)
        return self.slot[cell], cell

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has. The library is called for GROUP words at once."""
        texts = [w.decode() for w in words]
        if self.separator is not None and not any(SEPARATOR in t for t in texts):
            joint = [f" {SEPARATOR} ".join([*texts[i : i + GROUP], ""]) for i in range(0, len(texts), GROUP)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joint, add_special_tokens=False)])
            ends = np.flatnonzero(flat == self.separator)
            if len(ends) == len(words):
                return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _learn(self, hashed: np.ndarray, word: np.ndarray, words: list[bytes]) -> None:
        """Encode words whose hashes differ, each once, and remember them."""
        flat, size = self._ids(words)
        first, after = self.words, self.words + len(words)
        if after > len(self.size):
            room = max(after, min(2 * after, self.room))
            self.start, self.size = (np.concatenate([x[:first], np.zeros(room - first, x.dtype)]) for x in (self.start, self.size))
            self.known = np.concatenate([self.known[:, :first], np.zeros((4, room - first), np.uint64)], 1)
        self.known[:, first:after] = word
        self.start[first:after], self.size[first:after] = self.used + np.cumsum(size) - size, size
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.words = after
        left = np.arange(len(words))
        while len(left):
            _, cell = self._seek(hashed[left], word[:, left])
            _, one = np.unique(cell, return_index=True)
            self.slot[cell[one]] = (first + left[one]).astype(np.int32)
            left = np.delete(left, one)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id last, and the n + 1 offsets of the texts in them.

        Where words stand alone, a long text is worked on in pieces that end between words.
        """
        if not self.alone:
            raw = data.tobytes()
            whole = [raw[s:e].decode() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            found = [[*e.ids, END] for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.cumsum([0, *map(len, found)])
        if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
            ids, ends = self.encode(*folded(data, offsets))
            return np.insert(ids, ends[1:], np.uint32(END)), ends + np.arange(len(ends))
        at = W.cuts(data, SLICE_BYTES)
        parts = [self.encode(*folded(data[a:b], np.array([0, b - a])))[0].astype(self.kind) for a, b in zip(at, at[1:])]
        ids = np.concatenate([*parts, np.array([END], self.kind)])
        return ids, np.array([0, len(ids)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts word by word, without end ids, and the n + 1 offsets of the texts in them.

        Words of up to HEAD bytes are looked up by these bytes; longer ones are encoded once a batch.
        """
        start, end, first = W.find(data, offsets)
        n = end - start
        raw = data.tobytes()
        cut = lambda at: [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())]
        long = np.flatnonzero(n > W.HEAD)
        short = np.flatnonzero(n <= W.HEAD)
        parts = W.heads(data, start[short], end[short])
        hashed, word = W.head_hash(parts, n[short]), np.stack([*parts, n[short].astype(np.uint64)])
        number, _ = self._seek(hashed, word)
        while len(unknown := np.flatnonzero(number < 0)):
            _, one = np.unique(hashed[unknown], return_index=True)
            if self.words + len(one) > self.room:
                self.clear(len(short))
                number = np.full(len(short), -1)
                continue
            new = unknown[one]
            self._learn(hashed[new], word[:, new], cut(short[new]))
            number, _ = self._seek(hashed, word)
        size = np.zeros(len(start), np.int64)
        size[short] = self.size[number]
        if len(long):
            whole = cut(long)
            rare = {w: i for i, w in enumerate(dict.fromkeys(whole))}
            flat, each = self._ids(list(rare))
            of = np.array([rare[w] for w in whole])
            begin = np.cumsum(each) - each
            size[long] = each[of]
        ends = np.cumsum(size)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)

        def place(at: np.ndarray, source: np.ndarray, begin: np.ndarray) -> None:
            k = size[at]
            inside = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            ids[np.repeat((ends - size)[at], k) + inside] = source[np.repeat(begin, k) + inside]

        place(short, self.pool, self.start[number])
        if len(long):
            place(long, flat, begin[of])
        return ids, np.r_[0, ends][first]


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``: ids as little-endian numbers of two bytes, or four for a large vocabulary."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    width = _width(tokenizer)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = Encoder.of(tokenizer).texts(*text_bytes(b.column(1)))
        flat = ids.astype(width)
        places = (at * flat.itemsize).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(places), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([b.column(0), column], ["doc_id", "ids"])

    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary", 1)


def _width(tokenizer: str) -> str:
    return Encoder.of(tokenizer).kind


def _counts(ids: DataFrame, width: str, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents: summed in tasks first, at most one row an id comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            _, at, blob = b.column(0).buffers()
            at = np.frombuffer(at, np.int32)[b.column(0).offset :][: b.num_rows + 1]
            total += np.bincount(np.frombuffer(blob or b"", np.uint8)[at[0] : at[-1]].view(width), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    got = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the files of all documents. Null texts are empty; null ids come first; rows with equal ids are ordered by their tokens.

    Ids may be of any type that sorts; other columns are left out; an empty table has codes and blocks without rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    width = _width(tokenizer)
    staged = written(encoded(docs, tokenizer, doc_id, text), "ids")
    size = H.lengths(_counts(staged, width, Encoder.of(tokenizer).vocabulary))
    known = [(int(i), int(size[i])) for i in np.flatnonzero(size)]
    spark.createDataFrame(known, "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    held = spark.sparkContext.broadcast((H.codes(size), size))

    def block(shard: int, number: int, first: int, rows: list) -> dict:
        ids = np.concatenate([x for _, x in rows])
        payload, marks = H.pack(ids, *held.value)
        return {"shard": shard, "block": number, "first": first, "n": len(ids), "doc_ids": [i for i, _ in rows], "doc_n": [len(x) for _, x in rows], "marks": marks.tolist(), "payload": payload}

    kind = dict(staged.dtypes)["doc_id"]
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(arrow_type(staged, "doc_id"))), ("doc_n", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("payload", pa.binary())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first, rows, held_ids = TaskContext.get().partitionId(), 0, 0, [], 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(x, width)
                if rows and held_ids + len(ids) > BLOCK:
                    yield pa.RecordBatch.from_pylist([block(shard, number, first, rows)], arrow)
                    number, first, rows, held_ids = number + 1, first + held_ids, [], 0
                rows.append((i, ids))
                held_ids += len(ids)
        if rows:
            yield pa.RecordBatch.from_pylist([block(shard, number, first, rows)], arrow)

    # Range partitions ascend with the id; the range bounds come from a sample of the staged table's ids.
    ordered = staged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(code, f"shard int, block int, first long, n long, doc_ids array<{kind}>, doc_n array<long>, marks array<long>, payload binary")
    blocks.write.parquet(f"{path}/blocks")
    dropped(staged)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files: ``start`` counts the ids of all documents before."""
    bounded_batches(spark)
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    size = np.zeros(int(max(codes.column("id").to_pylist(), default=0)) + 1, np.uint8)
    size[codes.column("id").to_numpy()] = codes.column("bits").to_numpy()
    held = spark.sparkContext.broadcast(size)
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row a shard: as many as there are tasks that wrote.
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("shard_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shift = shards.select("shard", F.coalesce(F.sum("shard_n").over(before), F.lit(0)).alias("shift"))
    placed = blocks.join(F.broadcast(shift), "shard").select((F.col("shift") + F.col("first")).alias("start"), "n", "doc_ids", "doc_n", "marks", "payload")
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoding = H.table(held.value)
        for b in batches:
            for r in b.to_pylist():
                marks = np.array(r["marks"], np.int64)
                wanted = np.minimum(H.STRIDE, r["n"] - H.STRIDE * np.arange(len(marks)))
                ids = H.unpack(r["payload"], marks, wanted, decoding).astype("<u4")
                n = np.array(r["doc_n"], np.int64)
                at = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array(r["start"] + at), pa.array(n), pa.array([ids[s : s + k].tobytes() for s, k in zip(at.tolist(), n.tolist())], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of files written to the shared folder and read back.

    Every row of the table is a document, null and empty texts too (the end id alone); equal ids stay separate rows.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
