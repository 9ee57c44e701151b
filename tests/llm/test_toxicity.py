import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import toxicity as X


@pytest.fixture(scope="module")
def grammar():
    return X.Grammar({"idiot": 3.0, "grum*": 3.0}, (-3.0, 2.0, 1.0, 1.0, 0.5, -1.0, -0.5, 1.0))


def test_clauses(grammar):
    f = lambda t: grammar.features(t)[2]
    plain = f("what an idiot")
    assert plain == 3.0
    assert f("you idiot") > plain > f("he said what an idiot") > f("not an idiot") > 0
    assert f("no idea.\nidiot") == plain
    assert f("I will kill you") > 0 and f("I will kill. You") == 0 and f("kill time for hours with you") == 0
    assert f("grumble") == 3.0 and f("grum") == 0 and f("an idiotic idiots") == 0
    assert f(None) == f("") == f("clean words only") == 0
    assert f("IDIOT!") == plain
    assert grammar.features("idiot. idiot. fine.")[1] > grammar.features("idiot")[1]


def test_scores_are_ordered(grammar):
    assert 0 < grammar.score("") == grammar.score("fine") < grammar.score("idiot") < grammar.score("idiot. you idiot") < 1


def test_fold(spark):
    rows = spark.range(50).select(F.col("id"), X.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def _made(make, spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, f"word{i % 13} and more text{i % 29}. " + ("such a blorgface here" if bad else "such a pretty day") + f" end{i % 7}"))
        labels.append((i, 1, int(bad)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_clean(make, spark):
    docs, labels = _made(make, spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = X.digest(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    kept = X.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in truth.items() if not t}


def test_held_out_labels_are_never_used(make, spark):
    docs, labels = _made(make, spark)
    wrong = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.learn(X.sample(docs, labels)) == X.learn(X.sample(docs, wrong))


def test_odd_rows_and_no_labels(odd, make, spark):
    _, labels = _made(make, spark, 40)
    out = X.digest(odd, labels.union(spark.createDataFrame([(None, None, None), (1, None, 1), (1, None, 0)], labels.schema))).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    none = X.digest(odd, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert X.digest(make([]), labels).count() == 0


def _brute(symbols):
    """Each hit from the words before it, by the grammar's rules and not by states."""
    total = 0.0
    kinds = [k for k, _ in symbols]
    for i, (kind, weight) in enumerate(symbols):
        near = kinds[max(0, i - X.REACH) : i]
        before = kinds[max(0, i - X.REACH - 1) : i]
        armed = kind == X.AIM and X.THREATEN in before and X.AIM not in before[len(before) - before[::-1].index(X.THREATEN) :]
        own = (weight if kind == X.INSULT else 0.0) + (X.THREAT_WEIGHT if armed else 0.0)
        # A trigger is not marked by itself, nor by another of its kind before it.
        scale = 1.25 if X.AIM in near and kind != X.AIM else 1.0
        scale *= 0.25 if X.NEGATE in near and kind != X.NEGATE else 1.0
        total += own * scale * (0.6 if X.TELL in kinds[:i] else 1.0)
    return total


def test_composed_machine_equals_path_scoring():
    rng = random.Random(6)
    for _ in range(3000):
        clause = [(k, 2.5 if k == X.INSULT else 0.0) for k in (rng.choice(X.SYMBOLS) for _ in range(rng.randrange(14)))]
        assert X.clause_score(clause) == pytest.approx(_brute(clause))
    assert len(X.MACHINE.next) > 50 and all(len(r) == 6 and max(r) < len(X.MACHINE.next) for r in X.MACHINE.next)


@pytest.mark.parametrize("left_out", list(X.PARTS))
def test_each_part_changes_scores(grammar, left_out):
    texts = {"insult": "such an idiot", "threat": "I will kill you", "target": "you idiot", "negation": "not an idiot", "report": "he said what an idiot"}
    rest = X.Grammar(grammar.lexicon, grammar.weights, X.compose([t for n, t in X.PARTS.items() if n != left_out]))
    assert rest.score(texts[left_out]) != grammar.score(texts[left_out])
    assert {n for n, t in texts.items() if rest.score(t) != grammar.score(t)} >= {left_out}


def test_weights_are_learned_from_marks(make, spark):
    """Insults that are negated or reported are labelled clean here, and the fit says so in rows that it has not seen."""
    rows, labels = [], []
    for i in range(1200):
        kind = i % 6
        said = ("such a blorgface here", "a pretty day", "he is not a blorgface", "a pretty day", "she said blorgface to nobody", "you blorgface")[kind]
        rows.append((i, f"word{i % 13} and more text{i % 29}. {said}. end{i % 7}"))
        labels.append((i, 1, int(kind in (0, 5))))
    docs, labels = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = X.digest(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id % 6 in (0, 5)) for r in out if r.held_out)


def test_marks_decide_on_real_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    grammar = X.learn(X.sample(docs, labels))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id in truth]
    predicted = {r.doc_id: grammar.score(r.text) >= X.THRESHOLD for r in held}
    bad = [r.doc_id for r in held if truth[r.doc_id]]
    assert sum(predicted[i] for i in bad) >= 9 * len(bad) / 14 and not any(predicted[r.doc_id] for r in held if not truth[r.doc_id])
    alone = X.Grammar(grammar.lexicon, grammar.weights, X.compose([X.PARTS["insult"]]))
    assert any(alone.score(r.text) != grammar.score(r.text) for r in docs.collect())


def test_long_texts_take_linear_time(grammar):
    import time

    took = []
    for n in (1, 8):
        text = ("words without any mark " * 5 + "idiot! ") * (n * 8700)
        began = time.perf_counter()
        assert len(list(grammar.clauses(text))) == n * 8700
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] and took[1] < 20
    assert len(list(grammar.clauses("idiot " * 1_000_000))) == 1
