import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from tessella.llm import decontaminate, mixing, tokenfile, toxicity
from tessella.llm.queries import TOKENIZER, registry


def stages(spark, docs, data):
    out = [docs]
    for _, stage in P.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], data).collect() or [], stage(spark, out[-1], data).schema))
    return out


def test_each_stage_takes_effect(spark, data):
    from test_nearcopies import brute

    docs = spark.read.parquet(f"{data}/documents.parquet")
    _, calm, single, clean, mixed, tokens = stages(spark, docs, data)
    texts = {r.doc_id: r.text for r in docs.collect()}
    grammar = toxicity.learn(toxicity.sample(docs, spark.read.parquet(f"{data}/labels.parquet")))
    assert sorted(r.doc_id for r in calm.collect()) == sorted(i for i, t in texts.items() if grammar.score(t) < toxicity.THRESHOLD)
    first = {i for _, i in brute([(r.doc_id, r.text) for r in calm.collect()])}
    assert sorted(r.doc_id for r in single.collect()) == sorted(first)
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    left = {i for i in first if not any(x in decontaminate.normal(texts[i]) for x in items)}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(left)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert clean.columns == mixed.columns == docs.columns
    t = Tokenizer.from_file(TOKENIZER)
    start, want = 0, []
    for i in sorted(r.doc_id for r in mixed.collect()):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, tokenfile.END]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tokens.collect()) == want


def test_run_and_odd_rows(spark, data, odd, make):
    assert P.run(spark, data).count() > 100
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), make([]).select("doc_id", "text", "lang", "source", "n_chars")):
        for frame, (_, stage) in zip(stages(spark, docs, data), P.STAGES):
            out = stage(spark, frame, data)
            assert out.columns == (docs.columns if stage is not P.write_tokens else ["doc_id", "start", "n_tokens", "ids_crc32"])


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(registry()) <= names
