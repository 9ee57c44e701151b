"""The data source of article files: every cut into ranges gives the same articles; streams; odd files."""

import pytest

from tessella.sources import articles as A

FILES = {
    "a.txt": '<doc id="1" title="One">\nfirst line\nsecond\n</doc>\n<doc id="2">\n</doc>\n<doc title="É">\nünï\r\n\n</doc>\n',
    "b.txt": 'before\n<doc title="Four">\nx </doc> y\n <doc z\n</doc>\nbetween\n<doc title="open">\nnever closed',
    "c.txt": "", ".hidden.txt": '<doc title="no">\n</doc>\n', "d.text": '<doc title="no">\n</doc>\n',
    "e.txt": '<doc title="Five">\nlast\n</doc>',
}
WANT = [("a.txt", 0, "One", "first line\nsecond\n"), ("a.txt", 1, None, ""), ("a.txt", 2, "É", "ünï\n\n"), ("b.txt", 0, "Four", "x </doc> y\n <doc z\n"), ("e.txt", 0, "Five", "last\n")]


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "files"
    where.mkdir()
    for name, text in FILES.items():
        (where / name).write_bytes(text.encode())
    return str(where)


def test_every_cut_gives_the_same_articles(folder):
    for split in (*range(1, 90), 1000):
        rows = [r for p in A._Reader({"path": folder, "splitbytes": str(split)}).partitions() for r in A.articles_of(p)]
        assert len(rows) == 5
        assert sorted((p.split("/")[-1], s) for p, s, _, _ in rows) == sorted({(p.split("/")[-1], s) for p, s, _, _ in rows})
        assert [(p.split("/")[-1], t, x) for p, _, t, x in sorted(rows, key=lambda r: r[:2])] == [(p, t, x) for p, _, t, x in WANT]


def test_read_in_order_with_limit(spark, folder):
    got = A.read_article_files(spark, folder, split_bytes=20).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(5))
    assert [(r.path.split("/")[-1], r.article_no, r.title, r.text) for r in got] == WANT
    assert [r.title for r in A.read_article_files(spark, folder, limit=4).orderBy("doc_id").collect()] == ["One", None, "É", "Four"]
    titles = A.read_article_files(spark, folder, bodies=False).orderBy("doc_id").collect()
    assert [(r.title, r.text) for r in titles] == [(t, None) for _, _, t, _ in WANT]
    assert [r.title for r in A.read_article_files(spark, f"{folder}/e.txt").collect()] == ["Five"]


def test_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    def run():
        q = A.stream_article_files(spark, folder, 30).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "log")).trigger(once=True).start().awaitTermination()
        return sorted((r.path.split("/")[-1], r.start, r.title or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert len(run()) == 5
    with open(f"{folder}/f.txt", "w") as f:
        f.write('<doc title="Six">\nnew\n</doc>\n')
    got = run()
    assert len(got) == len(set(got)) == 6 and got[-1] == ("f.txt", 0, "Six")


def test_written_files_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", f"text {i}\nmore") for i in range(40)] + [(None, None)], "title string, text string")
    A.write_article_files(rows, str(tmp_path / "w"), 3)
    got = A.read_article_files(spark, str(tmp_path / "w"), split_bytes=100)
    assert sorted((r.title, r.text) for r in got.collect()) == sorted([(f"t{i}", f"text {i}\nmore\n") for i in range(40)] + [("", "\n")])
    assert got.groupBy("path").count().count() == 3
