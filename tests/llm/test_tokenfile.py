import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import huffman as H
from tessella.llm import tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")


def want(rows):
    t = Tokenizer.from_file(PATH)
    start, out = 0, []
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, tokenfile.END]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(tuple(r) for r in tokenfile.digest(df, PATH).collect())


def test_round_trip_equals_the_library(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got(docs) == want([(r.doc_id, r.text) for r in docs.collect()])


def test_special_strings_and_odd_spaces(make):
    rows = [(1, "a<|endoftext|>b <|startoftext|> Ć x́"), (2, "don't WE'LL x　y 12,000"), (3, "İSTANBUL ΑΣ ́ a"), (4, "\x00 \x1c\x1f\x85 z"), (5, "x” . A. é. (end). 12. U.S.A., it's, 5, z;\n?! Ok! q?"), (6, "a."), (7, ". b"), (8, ","), (9, ""), (10, "A."), (11, "<|ENDOFTEXT|> I\u0307.")]
    assert got(make(rows)) == want(rows)


def test_odd_rows(odd):
    rows = [r for r in tokenfile.digest(odd, PATH).collect()]
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[None].start == 0 and by[3].n_tokens == by[5].n_tokens == 1
    assert by[4].n_tokens > tokenfile.BLOCK
    ordered = sorted(rows, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))


def test_empty_table(make):
    assert got(make([])) == []


def test_memo_does_not_change_ids(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}y" for x in rng.integers(0, 300, 50)).encode() for _ in range(20)]
    buffers = [(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    plain = [tokenfile.Encoder(PATH).encode(*x)[0] for x in buffers]
    monkeypatch.setattr(tokenfile, "MEMO", 60)
    small = tokenfile.Encoder(PATH)
    assert all((small.encode(*x)[0] == a).all() for x, a in zip(buffers, plain))


@pytest.mark.parametrize("limit", [6, 20])
def test_codes_are_optimal_under_the_limit(limit):
    import heapq

    rng = np.random.default_rng(2)
    counts = (1000 / np.arange(1, 51) ** 1.5).astype(int) * rng.integers(0, 3, 50)
    size = H.lengths(counts, limit)
    assert size.max() <= limit and ((size > 0) == (counts > 0)).all()
    assert sum(2.0 ** -int(s) for s in size if s) == 1
    if limit == 20:
        heap, cost = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            c = heapq.heappop(heap) + heapq.heappop(heap)
            cost += c
            heapq.heappush(heap, c)
        assert cost == int((counts * size).sum())


def test_pack_and_unpack_from_checkpoints():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (255, 5), (256, 400), (5000, 400)):
        ids = (rng.pareto(1.0, n) * 3).astype(np.int64) % kinds
        size = H.lengths(np.bincount(ids, minlength=kinds))
        data, marks = H.pack(ids, H.codes(size), size)
        wanted = np.minimum(H.STRIDE, n - H.STRIDE * np.arange(len(marks)))
        decoding = H.table(size)
        assert (H.unpack(data, marks, wanted, decoding) == ids).all()
        last = H.unpack(data, marks[-1:], wanted[-1:], decoding)
        assert (last == ids[-len(last) :]).all()


def test_files_are_smaller_than_fixed_width(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tokenfile.write(docs, str(tmp_path / "t"), PATH)
    total = spark.read.parquet(str(tmp_path / "t/blocks")).agg(F.sum(F.length("payload")), F.sum("n")).first()
    assert total[0] < 1.6 * total[1]


def test_words_joined_for_the_library_keep_their_ids(monkeypatch):
    words = ["a", "don't", "x.y", "12", "é", "<|endoftext|>", "ś", "﷽", "'", "s", "…", "́", "\x02", "</w>", "i̇"] * 9
    encoder = tokenfile.Encoder(PATH)
    apart = [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    for more in ([], ["a\x01", "\x01", "b"]):
        own = [*words, *more]
        flat, size = encoder._ids([w.encode() for w in own])
        cuts = np.r_[0, np.cumsum(size)]
        assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])][: len(words)] == apart
        assert len(size) == len(own)


def test_a_batch_of_more_words_than_the_memo_holds(monkeypatch):
    text = " ".join(f"w{i}" for i in range(2000)).encode()
    buffers = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    plain = tokenfile.Encoder(PATH).encode(*buffers)[0]
    monkeypatch.setattr(tokenfile, "MEMO", 10)
    assert (tokenfile.Encoder(PATH).encode(*buffers)[0] == plain).all()


def test_other_tokenizers_get_whole_texts(make):
    """One that keeps case and white space, so that its words do not stand alone."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokenfile.Encoder(PATH).alone and not tokenfile.Encoder(path).alone
    t = Tokenizer.from_file(path)
    rows = [(1, "Hello World.  Two  spaces\n\nand more"), (2, ""), (3, " Ünï CÖDÉ 漢字. don't. "), (4, None)]
    found = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in tokenfile.encoded(make(rows), path).collect()}
    assert found == {i: [*t.encode(x or "", add_special_tokens=False).ids, tokenfile.END] for i, x in rows}


def _thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse(make):
    one = _thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, "q" * 8 + one), (2, "q" * 8 + two), (3, one), (4, two), (5, f"{one} {two} {one}"), (6, "a\x00 a a\x00\x00"), (7, "abcdefghijklmnopqrstuvwx abcdefghijklmnopqrstuvwy abcdefghijklmnopqrstuvwxy")]
    assert got(make(rows)) == want(rows)


def test_memo_finds_words_of_equal_hash(monkeypatch):
    from tessella.llm import words

    text = " ".join(f"w{i % 90}" for i in range(500)).encode()
    buffers = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    plain = tokenfile.Encoder(PATH).encode(*buffers)[0]
    monkeypatch.setattr(words, "head_hash", lambda parts, n: parts[0] % np.uint64(3))
    assert (tokenfile.Encoder(PATH).encode(*buffers)[0] == plain).all()


def test_long_texts_go_in_pieces(make, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(1, " ".join(f"W{x}, a{x % 7}." for x in rng.integers(0, 5000, 30_000))), (2, "z" * 700_000), (3, " " * 1_100_000 + "end")]
    monkeypatch.setattr(tokenfile, "SLICE_BYTES", 1000)
    encoder = tokenfile.Encoder(PATH)
    for _, text in rows[::2]:
        raw = np.frombuffer(text.encode(), np.uint8)
        found, at = encoder.texts(raw, np.array([0, len(raw)]))
        assert found.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, tokenfile.END] and at.tolist() == [0, len(found)]
    assert got(make(rows)) == want(rows)


def test_chunks_of_a_block(monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 512)
    rng = np.random.default_rng(3)
    for n in (511, 512, 513, 5000):
        ids = (rng.pareto(1.0, n) * 3).astype(np.int64) % 400
        size = H.lengths(np.bincount(ids, minlength=400))
        data, marks = H.pack(ids, H.codes(size), size)
        bits = "".join(f"{int(H.codes(size)[i]):0{int(size[i])}b}" for i in ids)
        assert data == bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
        wanted = np.minimum(H.STRIDE, n - H.STRIDE * np.arange(len(marks)))
        assert (H.unpack(data, marks, wanted, H.table(size)) == ids).all()


def test_ids_of_other_types(make):
    rows = tokenfile.digest(make([(2, "b c"), (10, "a")]).withColumn("doc_id", F.col("doc_id").cast("string")), PATH).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in rows) == [("10", 0, 2), ("2", 2, 3)]
