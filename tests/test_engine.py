import pytest
from pyspark.sql import functions as F

from tessella.engine import ImageIndex, TextIndex, search_multimodal
from tessella.functions import text as X
from tessella.functions import vector
from tessella.metrics import Metrics
from tessella.operators import text_search
from tessella.sources import files
from tessella.streaming import ingest


def test_text_index_equals_direct_search(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    index = TextIndex(spark, str(tmp_path / "t"), ["the", "of"]).create()
    assert index.size() == 0
    index.add(docs.where("doc_id < 100"), 1)
    index.add(docs.where("doc_id >= 100"), 2)
    index.add(docs.where("doc_id >= 100"), 2)
    counts = X.term_counts(docs, ["the", "of"])
    assert index.size() == counts.count()
    for q in ("thing", "thing || !tion", "zzz"):
        want = text_search.search(counts, docs, q, norm=X.query_word).collect()
        assert index.search(q).collect() == want
    assert index.search_batch([(1, "thing"), (2, "!thing")]).count() == 20
    assert index.postings().count() == index.size()
    index.clear()
    assert index.size() == 0 and index.search("thing").count() == 0


def test_stream_equals_batch(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    index = TextIndex(spark, str(tmp_path / "t"), []).create()
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.ingest_texts(stream, index, str(tmp_path / "c"), available_now=True)
    query.awaitTermination()
    want = X.term_counts(docs)
    got = index.counts.select("doc_id", "term", "tf")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert index.docs.count() == docs.count()


@pytest.mark.parametrize("technique", ["kmeans", "lsh"])
def test_image_index_and_fusion(spark, data, tmp_path, technique):
    x = files.read_descriptors(spark.read.parquet(f"{data}/embeddings.parquet"))
    index = ImageIndex(spark, str(tmp_path / "i")).create(8, 64, technique)
    index.train(x, seed=3)
    index.add(x, 1)
    found = index.search(x.where("image_id = 3")).collect()
    assert len(found) == 15 and found == sorted(found, key=lambda r: (-r.score, r.image_id))
    assert index.search(x.where("image_id = 3"), None).where("image_id = 3").count() == 1
    assert index.statistics().agg(F.sum("df")).first()[0] == index.hist.count()
    texts = TextIndex(spark, str(tmp_path / "t"), []).create()
    texts.add(spark.read.parquet(f"{data}/documents.parquet"), 1)
    fused = search_multimodal(texts, index, "thing", x.where("image_id = 3"))
    assert fused.columns == ["doc_id", "score"] and 0 < fused.count() <= 10
    index.clear()
    assert index.hist.count() == 0


def test_lsh_without_positive_dot_is_bucket_zero(spark):
    from tessella.operators import vision

    book = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "centre int, centre_vec array<float>")
    x = spark.createDataFrame([(1, 0, [-1.0]), (1, 1, [1.0]), (1, 2, None), (1, 3, [1.0, 2.0])], "image_id long, desc_no long, vec array<float>")
    got = {r.desc_no: r.centre for r in vision.assign(x, book, "lsh").collect()}
    assert got == {0: 0, 1: 1}


def test_gaussian_codebook_repeats(spark):
    a, b = (vector.gaussian_codebook(spark, 3, 4, 1).collect() for _ in range(2))
    assert a == b


def test_distances(spark):
    r = spark.range(1).select(
        vector.l2(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("l"),
        vector.dot(F.array(F.lit(2.0)), F.array(F.lit(5.0))).alias("d"),
        vector.squared_l2(F.array(F.lit(2.0)), F.array(F.lit(5.0)), 2.0).alias("w"),
    )
    assert tuple(r.first()) == (5.0, 10.0, 18.0)


def test_file_readers(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.txt").write_text('<doc id="1" title="One">\nfirst line\nred car\n</doc>\n<doc title="Two">\nblue\n</doc>\n')
    (tmp_path / "w/b.txt").write_text("<doc >\nx\n</doc>\n")
    rows = files.read_articles(spark, str(tmp_path / "w")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.article_no, r.text) for r in rows] == [(0, 0, "first line\nred car\n"), (1, 1, "blue\n"), (2, 0, "x\n")]
    compat = files.read_articles(spark, str(tmp_path / "w"), compat=True).orderBy("doc_id").collect()
    assert [r.text for r in compat] == ["first \nred \n", "\n", "", "\n", ""]
    assert files.read_articles(spark, str(tmp_path / "w"), limit=1).count() == 1
    assert files.read_articles(spark, str(tmp_path / "w"), limit=1, whole_files=True).count() == 2
    assert [r.title for r in files.read_titles(spark, str(tmp_path / "w")).collect()] == ["One", "Two"]
    whole = files.read_texts(spark, str(tmp_path / "w"), limit=1, descending=True).collect()
    assert whole[0].path.endswith("b.txt") and whole[0].doc_id == 0
    assert files.list_files(spark, str(tmp_path), "*.txt*", 1, one_level_down=True).count() == 1


def test_tag_queries_images_codebooks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/1.txt").write_bytes(b"red car\r\ndog\r\n")
    assert files.read_tag_queries(spark, str(tmp_path / "t")).first().query == "red_car || dog"
    (tmp_path / "i").mkdir()
    for n in ("012.jpg", "x.jpg"):
        (tmp_path / "i" / n).write_bytes(b"1")
    assert sorted(r.image_id for r in files.read_images(spark, str(tmp_path / "i")).collect()) == [0, 12]
    import numpy as np

    np.arange(6, dtype="<f4").tofile(tmp_path / "book")
    raw = files.read_raw_codebook(spark, str(tmp_path / "book"), 3)
    assert [r.centre_vec for r in raw.orderBy("centre").collect()] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    files.write_codebook(raw, str(tmp_path / "saved"))
    assert files.read_codebook(spark, str(tmp_path / "saved")).count() == 2
    assert files.holidays_queries(spark).count() == 500 and files.wang_queries(spark).count() == 20
    assert files.queries_from_config(spark, ["a", "b"]).count() == 2
    ranked = spark.createDataFrame([(7, 2, 5), (7, 1, 9)], "query_id long, rank int, image_id long")
    files.write_run(ranked, str(tmp_path / "run"))
    assert spark.read.text(str(tmp_path / "run")).first().value == "7.jpg 0 9.jpg 1 5.jpg"
    old = spark.createDataFrame([("k", 1), ("m", 2)], "label string, v int")
    new = spark.createDataFrame([("k", 3)], "label string, v int")
    assert sorted(tuple(r) for r in files.upsert(old, new).collect()) == [("k", 3), ("m", 2)]
    files.write_stats({"df": new}, str(tmp_path / "stats"))
    assert files.read_stats(spark, str(tmp_path / "stats"), "df").count() == 1


def test_keyed(spark):
    import hmac

    from tessella.functions import keyed

    df = spark.createDataFrame([("abc", 5)], "t string, n int")
    row = df.select(
        keyed.hmac_sha256(b"k" * 80, F.col("t")).alias("h"),
        keyed.label(keyed.term_key(bytes(32), F.col("t")), F.col("n")).alias("l"),
    ).first()
    assert bytes(row.h) == hmac.digest(b"k" * 80, b"abc", "sha256")
    assert bytes(row.l) == hmac.digest(hmac.digest(bytes(32), b"abc", "sha256"), b"\5\0\0\0", "sha256")
    with pytest.raises(Exception, match="label does not match"):
        df.select(keyed.checked(F.col("n"), F.col("t"), F.lit("x"))).collect()


def test_fusion_modes(spark):
    from tessella.operators import fusion

    t = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 0.0)], "doc_id long, score double")
    i = spark.createDataFrame([(2, 4.0), (4, 1.0)], "doc_id long, score double")
    got = [tuple(r) for r in fusion.fuse(t, i).orderBy(F.desc("score")).collect()]
    assert got == [(3, float("inf")), (2, 2.125)]
    got = [tuple(r) for r in fusion.fuse(t, i, "rank").orderBy(F.desc("score")).collect()]
    assert got == [(2, 2.5), (1, 1.0)]


def test_metrics(spark):
    m = Metrics()
    with m.phase("count"):
        m.counted("rows", spark.range(7)).count()
    assert m.rows["rows"].get == {"rows": 7} and m.report(spark).first().runs == 1


def test_upsert_keeps_the_last_of_equal_keys(spark):
    old = spark.createDataFrame([("k", 1, 0), ("m", 2, 0)], "label string, v int, at int")
    new = spark.createDataFrame([("k", 9, 1), ("k", 3, 2), ("z", 5, 1), ("z", 5, 1)], "label string, v int, at int")
    assert sorted(tuple(r) for r in files.upsert(old, new, order="at").collect()) == [("k", 3, 2), ("m", 2, 0), ("z", 5, 1)]


def test_sequential_means_do_not_depend_on_tiles_or_tasks(spark, monkeypatch):
    import numpy as np

    from tessella.operators import vision

    rng = np.random.default_rng(5)
    points, centres = rng.normal(size=(300, 4)).astype("float32"), rng.normal(size=(7, 4)).astype("float32")
    schema = "image_id long, desc_no int, vec array<float>"
    rows = [(i, 0, p.tolist()) for i, p in enumerate(points)] + [(900, 0, None), (901, 0, [1.0])]
    book = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "centre int, centre_vec array<float>")
    near = ((points[:, None, :].astype(float) - centres[None]) ** 2).sum(2).argmin(1)
    for cells, numbers in ((4_000_000, 8_000_000), (30, 12)):
        monkeypatch.setattr(vision, "TILE_CELLS", cells)
        monkeypatch.setattr(vision, "BLOCK_NUMBERS", numbers)
        x = spark.createDataFrame(rows, schema).repartition(5)
        assert {r.image_id: r.centre for r in vision.assign(x, book).collect()} == dict(enumerate(near.tolist()))
        for r in vision.macqueen(x, book).collect():
            own = points[near == r.centre].astype(float)
            assert r.n == 1 + len(own)
            assert np.allclose(r.centre_vec, (centres[r.centre] + own.sum(0)) / r.n, atol=1e-5)
    assert vision.macqueen(spark.createDataFrame([], schema), book).where("n = 1").count() == 7


def test_named_terms_are_all_a_search_needs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for terms in ([], ["thing"], ["th", "zzz"], ["hand", "tion", "a"]):
        for stemmed in (True, False):
            want = X.term_counts(docs, ["the"], stemmed).where(F.col("term").isin(terms) if terms else F.lit(False))
            got = X.term_counts(docs, ["the"], stemmed, terms=terms)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "Things thing THE s")], "doc_id long, text string")
    assert sorted(map(tuple, X.term_counts(odd, ["the"]).collect())) == [(3, "s", 1), (3, "thing", 2)]
    assert sorted(map(tuple, X.document_terms(odd).collect())) == [(3, t) for t in ("s", "the", "thing", "things")]


def test_a_word_begins_with_its_stem_but_for_two_letters():
    from itertools import product

    from tessella.functions import porter

    ends = ["", "s", "es", "ies", "ed", "ing", "y", "e", "ll"] + [a for a, _ in porter.STEP2 + porter.STEP3] + list(porter.STEP4)
    for word in map("".join, product(("a", "tr", "hop", "rel", "logi", "iz"), ends, ends, ("", "s", "ed", "ing", "y", "ly"))):
        assert word.startswith(porter.stem(word)[:-2])
