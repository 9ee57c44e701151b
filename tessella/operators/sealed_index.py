"""A sealed inverted index: postings under opaque labels, found again by labels that are made from counters.

The label of a posting is a keyed hash of its position under the key of its term, or of its visual word, so a store shows
neither terms nor which postings belong together; a searcher who knows how many postings a term has makes their labels and looks
them up. Stores are tables ``(label, inside, record)`` that any key lookup can serve. Postings are labelled where they are and the
store is never shuffled: what a lookup shuffles are the records that it may want.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from ..staging import columns, fresh

RECORD = "id long, tf long"
#: Bits by which a store is thinned before a lookup's join: 16 MB, whatever the size of the store.
BITS = 1 << 27
MAP = 1 << 15


def _key(master: bytes, of: Column, kind: str) -> Column:
    return keyed.centre_key(master, of) if kind == "centre" else keyed.term_key(master, of)


def _padded(key: bytes) -> tuple:
    """The two hashes of an HMAC after the key: made once for a term, copied for each of its labels."""
    block = key.ljust(keyed.BLOCK, b"\0")
    return tuple(hashlib.sha256(bytes(x ^ mask for x in block)) for mask in (0x36, 0x5C))


def _labels(master: bytes):
    """Batches with a label, from the last two columns: what the term's key is over, and the position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(b.num_columns - 2).dictionary_encode()
            keys = [_padded(hmac.digest(master, m, "sha256")) if m is not None else None for m in of.dictionary.to_pylist()]
            pos = b.column(b.num_columns - 1)
            places = np.asarray(pos.fill_null(0)).astype("<i8").astype("<u4").tobytes()
            out: list[bytes | None] = []
            for i, (k, known) in enumerate(zip(of.indices.to_pylist(), pos.is_valid().to_pylist())):
                if k is None or keys[k] is None or not known:
                    out.append(None)
                    continue
                inner, outer = keys[k][0].copy(), keys[k][1].copy()
                inner.update(places[4 * i : 4 * i + 4])
                outer.update(inner.digest())
                out.append(outer.digest())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.binary())], [*b.schema.names[:-2], "label"])

    return run


def labelled(postings: DataFrame, master: bytes, kind: str = "term") -> DataFrame:
    """``postings`` ``(term, pos, doc_id, tf)`` with their ``label``; ``kind`` is ``term``, or ``centre`` for visual words.

    Nothing is shuffled: a task makes the key of each term of a batch once, and postings come in the order of their terms.
    """
    rows = postings.drop("label")
    of = keyed.int32_le(F.col("term")) if kind == "centre" else F.col("term").cast("binary")
    given = rows.select(*columns(rows), of.alias(fresh(rows, "_of")), F.col("pos").cast("long").alias(fresh(rows, "_pos")))
    kinds = ", ".join(f"{c} {t}" for c, (_, t) in zip(columns(rows), rows.dtypes))
    return given.mapInArrow(_labels(master), f"{kinds}, label binary")


def sealed(postings: DataFrame, master: bytes, key: bytes, kind: str = "term") -> DataFrame:
    """``(label, inside, record)`` of every posting, encrypted and bound to its label."""
    record = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("tf").cast("long").alias("tf"))).cast("binary")
    marked = labelled(postings, master, kind)
    return marked.select("label", F.col("label").alias("inside"), keyed.seal(record, key, F.col("label")).alias("record"))


def wanted(counters: DataFrame, master: bytes, kind: str = "term") -> DataFrame:
    """``(term, label)`` of all postings of some terms, from ``(term, df)``; a term's keys are masked once, not for each label."""
    held = counters.where("df > 0").select("term", "df", keyed.masked_keys(_key(master, F.col("term"), kind)).alias("keys"))
    places = held.select("term", "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("df") - 1)).alias("pos"))
    return places.select("term", keyed.label_masked(F.col("keys"), F.col("pos")).alias("label"))


def _number(labels: pa.Array, bits: int) -> np.ndarray:
    """A bit's number from the first four bytes of each label."""
    heads = pc.binary_slice(labels, 0, 4).cast(pa.binary(4))
    return np.frombuffer(heads.buffers()[1], "<u4")[heads.offset : heads.offset + len(heads)] & (bits - 1)


def thinned(store: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the store whose label sets a bit that a wanted one sets: all that are wanted, and few others.

    The bits are gathered first, in bitmaps of 4 KB and BITS in all, so a store of any size is read once,
    where it is. Its rows come here as they were sealed: what is left out has been sealed too.
    """

    total = BITS

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_number(b.column(0), total).astype("int64"))], ["n"])

    wanted_ = labels.where("label IS NOT NULL").select("label").mapInArrow(numbers, "n long")
    # A map of 2^15 bits, 4 KB, at most BITS / 2^15 of them.
    maps = wanted_.groupBy(F.floor(F.col("n") / MAP).alias("at")).agg(F.bitmap_construct_agg(F.col("n") % MAP).alias("bits")).toArrow()
    bits = np.zeros(max(total, MAP) // 8, "u1")
    for at, own in zip(maps.column("at").to_pylist(), maps.column("bits").to_pylist()):
        bits[at * MAP // 8 : (at + 1) * MAP // 8] = np.frombuffer(own, "u1")
    held = store.sparkSession.sparkContext.broadcast(bits)
    where = store.columns.index("label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(where).is_valid())
            n = _number(b.column(where), total)
            yield b.filter(pa.array((held.value[n >> 3] >> (n & 7)) & 1 == 1))

    return store.mapInArrow(run, store.schema)


def opened(store: DataFrame, labels: DataFrame, key: bytes) -> DataFrame:
    """``(term, id, tf)`` of the labels that the store has; the job fails where a record does not belong to its label."""
    got = thinned(store, labels).join(labels, "label")
    plain = keyed.checked(keyed.unseal(F.col("record"), key, F.col("label")), F.col("inside"), F.col("label")).cast("string")
    return got.select("term", F.from_json(plain, RECORD).alias("r")).select("term", "r.id", "r.tf")
