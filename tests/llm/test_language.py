"""Scores against a plain version of the same model, held-out accuracy, and odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import regex

from tessella.llm import language as L


def plain(rows):
    """Scores of ``(doc_id, lang, text)`` rows by counters alone; rows fewer than SAMPLE a language, so all are counted."""
    learned = [(lang, text) for i, lang, text in rows if lang is not None and (i is None or zlib.crc32(str(i).encode()) % 3 != 1)]
    tokens = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    langs = sorted({lang for lang, _ in learned})
    words, total = defaultdict(Counter), Counter()
    for lang, text in learned:
        for w in tokens(text):
            words[w][lang] += 1
            total[lang] += 1
    known = {w: c for w, c in words.items() if sum(c.values()) >= 2}
    grams, places = defaultdict(Counter), Counter()
    for w, by in words.items():
        if len(w) > 40:
            continue
        m = f"<{w}>"
        for lang in by:
            places[lang] += len(m)
            for n in range(1, 6):
                for k in range(len(m) - n + 1):
                    grams[m[k : k + n]][lang] += 1
    share = Counter(lang for lang, _ in learned)

    def log(table, sums, item):
        return [math.log(table[item][lang] + 0.1) - math.log(sums[lang] + 0.1 * max(len(table), 1)) for lang in langs]

    def word(w):
        if w in known:
            return log(known, total, w)
        m, found = f"<{w}>", []
        for k in range(len(m)):
            for n in (5, 4, 3, 2, 1):
                if k + n <= len(m) and m[k : k + n] in grams:
                    found.append([x - 0.5 * (5 - n) for x in log(grams, places, m[k : k + n])])
                    break
        return [2.0 * sum(c) / len(found) for c in zip(*found)] if found else [0.0] * len(langs)

    out = {}
    for i, _, text in rows:
        ws = tokens(text)
        if not ws:
            out[i] = ("und", 0.0)
            continue
        sums = [sum(c) for c in zip(*map(word, ws))]
        prior = [math.log(share[lang] / len(learned)) for lang in langs]
        best = max(range(len(langs)), key=lambda k: (sums[k] + prior[k], -k))
        f = min(1.0, (20 / len(ws)) ** 0.5)
        x = [s * f + p for s, p in zip(sums, prior)]
        out[i] = (langs[best], 1 / sum(math.exp(v - x[best]) for v in x))
    return out


def test_scores_equal_plain_version_and_predict_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    want, got = plain(rows), L.digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = want[r.doc_id]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    true = {i: lang for i, lang, _ in rows}
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.95 * len(held)


def test_held_out_labels_and_sources_are_no_inputs(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet")
    other = docs.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    rows = lambda d: sorted(tuple(r) for r in L.digest(d).select("doc_id", "lang_pred", F.round("score", 9)).collect())
    assert rows(docs) == rows(other)


def test_unseen_words_back_off(spark):
    texts = [(i, "de", "schlagen schreiben schneiden") for i in range(8)] + [(i, "fr", "heureux nombreux curieux") for i in range(8, 16)]
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in texts if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, text string, lang string")
    model = L.learn(docs)
    assert sorted(model.langs) == ["de", "fr"]
    scorer = L.Scorer(model)
    assert scorer.score("Schleifen")[0] == "de" and scorer.score("lumineux")[0] == "fr"
    assert scorer.score("12 34 !?") == ("und", 0.0) and scorer.score(None) == ("und", 0.0)
    assert scorer.score("漢字")[0] in ("de", "fr")


def test_bound_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 30)
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 50 = 0, 'b', 'a') AS lang", "concat('t', id) AS text")
    counts, rows = L.sample(docs)
    assert sum(counts.values()) == docs.where(~L.held_out(docs.doc_id)).count()
    kept = Counter(r.lang for r in rows.collect())
    assert kept["a"] == 30 and 25 <= kept["b"] <= 30


def test_odd_rows_and_nothing_to_learn(odd, make):
    assert L.digest(make([])).collect() == []
    got = L.digest(odd).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (5, 3, 9)} == {"und"}
    blank = odd.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang", "'x' AS word", "'x' AS item")
    assert {(r.lang_pred, r.score) for r in L.digest(blank).collect()} == {("und", 0.0)}
