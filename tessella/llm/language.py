"""Language identification, word first: known words by their frequency in each language, other words by their characters.

A word that the learned rows show is scored by its log frequency in every language. Any other word is cut into character
n-grams: from each of its places the longest n-gram that the learned words show counts, backing off from ORDERS[0]
characters to one, and the word counts as their mean, WEIGHT times. A text's language is the one whose words and share of
all learned rows are likeliest together.

Languages, their shares and thresholds come from all learned rows. Frequencies come from a bounded sample: at most SAMPLE
rows of each language, those of the least hash. The model, which goes to every task, has at most WORDS words and GRAMS
n-grams, the commonest, a number for each language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, dropped, map_texts, written

#: Rows of one language that frequencies are counted in, at most.
SAMPLE = 5_000
#: Words and n-grams of the model, at most.
WORDS = 200_000
GRAMS = 200_000
#: Occurrences that make a word known.
SEEN = 2
#: Lengths of n-grams, longest first; a word's ends are marked.
ORDERS = (5, 4, 3, 2, 1)
#: What a character shorter costs, in nats, and how many of its n-grams' means an unseen word counts.
BACKOFF = 0.5
WEIGHT = 2.0
#: Added to every count.
SMOOTH = 0.1
#: Unseen words that a task remembers, of at most LONGEST characters.
MEMO = 200_000
LONGEST = 40
#: Words whose evidence counts whole towards a score; more words raise it by the root of their number.
TRUSTED = 20
NONE = "und"

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """Runs of letters with their marks, in lower case."""
    return WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """Log frequencies by language: a row of ``word_logs`` or ``gram_logs`` for each known word or n-gram."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    word_logs: np.ndarray | None = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_logs: np.ndarray | None = None

    def unseen(self, word: str) -> np.ndarray:
        """Mean of the log frequencies of the longest known n-gram at each place; a place without any says nothing."""
        marked = f"<{word}>"
        total, n = np.zeros(len(self.langs)), 0
        for at in range(len(marked)):
            for size in ORDERS:
                gram = marked[at : at + size]
                if len(gram) < size:
                    continue
                k = self.grams.get(gram)
                if k is not None:
                    total += self.gram_logs[k] - BACKOFF * (ORDERS[0] - size)
                    n += 1
                    break
        return WEIGHT * total / n if n else total


class Scorer:
    """A model with the unseen words that it has met."""

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.words)
        self.rows = np.concatenate([model.word_logs, np.zeros((1024, len(model.langs)))])
        self.at = dict(model.words)

    def _place(self, word: str) -> int:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = self.model.unseen(word)
        self.at[word] = self.n
        self.n += 1
        return self.n - 1

    def score(self, text: str | None) -> tuple[str, float]:
        """Likeliest language, the first by name on a tie, and its probability; NONE and 0 for a text without letters."""
        words = words_of(text)
        if not words or not self.model.langs:
            return NONE, 0.0
        if self.n > len(self.model.words) + MEMO:
            self.at, self.n = dict(self.model.words), len(self.model.words)
        total, at, get = np.zeros(len(self.model.langs)), [], self.at.get
        for w in words:
            k = get(w)
            if k is None:
                if len(w) > LONGEST:
                    total += self.model.unseen(w)
                    continue
                k = self._place(w)
            at.append(k)
        total += self.rows[at].sum(0)
        best = int((total + self.model.prior).argmax())
        n = len(words)
        if n > TRUSTED:
            total *= (TRUSTED / n) ** 0.5
        total += self.model.prior
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 3, is 1. A null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """Rows of each language to learn from, and ``(lang, text)`` of at most SAMPLE of each, those of the least hash.

    A threshold for each language, from its count, leaves about as many rows as are wanted inside the tasks; the exact
    bound is a ranking of those. Null languages are left out; equal rows are rows.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    # A row for each language: the size of the model's vectors.
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}, rows.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (SAMPLE + 5 * SAMPLE**0.5) / n))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(1 << 40)) / float(1 << 40)
    few = rows.withColumn("_drawn", drawn).where(F.col("_drawn") < share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("_drawn", "doc_id", F.xxhash64("text"))
    return counts, few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= SAMPLE).select("lang", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, word, n)`` of a task's batches."""
    for b in batches:
        seen: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w, n in Counter(words_of(text)).items():
                seen[lang, w] += n
        langs, words = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(seen.values(), pa.int64())], ["lang", "word", "n"])


def _logs(counts: DataFrame, langs: list[str], totals: dict[str, int], most: int) -> tuple[dict[str, int], np.ndarray]:
    """The ``most`` commonest items of ``(lang, item, n)`` with their log frequencies; ``totals`` are the languages' sums.

    What comes to the driver is bounded by ``most`` times the languages.
    """
    common = counts.groupBy("item").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "item").limit(most)
    got = counts.join(F.broadcast(common.select("item")), "item").select("item", "lang", "n").toArrow()
    items = sorted(set(got.column("item").to_pylist()))
    at, column = {w: k for k, w in enumerate(items)}, {lang: k for k, lang in enumerate(langs)}
    out = np.full((len(items), len(langs)), SMOOTH)
    for w, lang, n in zip(*(got.column(c).to_pylist() for c in ("item", "lang", "n"))):
        out[at[w], column[lang]] += n
    return at, np.log(out) - np.log([totals.get(lang, 0) + SMOOTH * max(len(items), 1) for lang in langs])


def learn(docs: DataFrame) -> Model:
    """A model of ``docs``' learned fold, from its texts and languages. Without rows to learn from it knows no language."""
    counts, rows = sample(docs)
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(0), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    bounded_batches(docs.sparkSession)
    share = np.array([counts[lang] for lang in langs], float)
    found = written(rows.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    total = {r.lang: r.n for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    seen = found.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= SEEN).select("word")
    words, word_logs = _logs(found.join(seen, "word").select("lang", F.col("word").alias("item"), "n"), langs, total, WORDS)
    # A different word of a language counts once: unseen words are like the rare ones.
    marked = found.where(F.length("word") <= LONGEST).select("lang", F.concat(F.lit("<"), "word", F.lit(">")).alias("w"))
    cut = marked.select("lang", "w", F.explode(F.array(*[F.lit(n) for n in sorted(ORDERS)])).alias("size")).where(F.col("size") <= F.length("w"))
    each = cut.select("lang", F.explode(F.expr("transform(sequence(1, length(w) - size + 1), i -> substring(w, i, size))")).alias("item"))
    grams = written(each.groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n")), "grams")
    places = {r.lang: r.n for r in marked.groupBy("lang").agg(F.sum(F.length("w")).alias("n")).collect()}
    gram, gram_logs = _logs(grams, langs, places, GRAMS)
    dropped(found, grams)
    return Model(langs, np.log(share / share.sum()), words, word_logs, gram, gram_logs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, from its text only.

    Texts that are null, empty or without letters are NONE with score 0, and so is every text if nothing was learned. Whole
    texts are read. Equal rows have equal results. Other columns are left out.
    """
    rows = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    own: list[Scorer] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not own:
            own.append(Scorer(held.value))
        found = [own[0].score(t) for t in b.column(1).to_pylist()]
        langs, scores = zip(*found)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_texts(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double", 1)


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row; learned from the rows that are not held out."""
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
