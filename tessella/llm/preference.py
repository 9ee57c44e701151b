"""Preference formatting: pairs of chosen and rejected conversations as one prompt and two masked completions.

DataFrame functions only. The longest common prefix of turns, by role and text, is rendered once as the prompt; what
follows in either conversation is its completion. A completion's mask lists the character spans to train on: the
assistant's turns with their end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    """One turn; a null role or text is empty."""
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(CLOSE), F.coalesce(text, F.lit("")), F.lit(END))


def consecutive(turns: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected)``: conversation 2k beside 2k + 1, where both exist; null ids are no conversation.

    The pair of an id is an exact shift, so ids above 2 ** 53 are paired as well.
    """
    ids = turns.where("conv_id IS NOT NULL").select("conv_id").distinct()
    pair = F.shiftright(F.col("conv_id").cast("long"), 1)
    both = ids.groupBy(pair.alias("pair_id")).agg(F.min("conv_id").alias("chosen"), F.max("conv_id").alias("rejected"))
    return both.where("chosen < rejected")


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected, prompt_turns, prompt, chosen_completion, rejected_completion, chosen_mask, rejected_mask)``.

    Turns are ordered by ``turn``, null first, then role and text, so repeated turn numbers have one order. Equal
    conversations have an empty completion each; without a common turn the prompt is empty. Masks are arrays of
    ``(start, length)``, 0-based. Pairs whose conversations have no turns are left out; other columns are ignored.
    Only turns of paired conversations are gathered, each pair into one row, as large as its output.
    """
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen").alias("conv_id"), F.lit(1).alias("side")), F.struct(F.col("rejected").alias("conv_id"), F.lit(2).alias("side")))).alias("s"))
    sides = sides.select("pair_id", F.col("s.conv_id").alias("conv_id"), F.col("s.side").alias("side"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t")).join(sides, "conv_id")
    each = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("t"))), _by_turn)
    grouped = own.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == 1, F.col("conv_id"))).alias("chosen"), F.max(F.when(F.col("side") == 2, F.col("conv_id"))).alias("rejected"),
        each(1).alias("a"), each(2).alias("b"),
    )
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    first = F.array_position(same, False)
    length = F.when(first > 0, first - 1).otherwise(F.least(F.size("a"), F.size("b"))).cast("int")
    cut = grouped.where("chosen IS NOT NULL AND rejected IS NOT NULL").withColumn("prompt_turns", length)

    def text_of(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: rendered(t.role, t.text)), "")

    def after(name: str) -> Column:
        return F.slice(name, F.col("prompt_turns") + 1, F.size(name))

    def mask(turns: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            head = F.length(t.role) + len(OPEN) + len(CLOSE)
            body = F.length(t.text) + len(END)
            span = F.struct((acc.at + head).alias("start"), body.alias("length"))
            spans = F.when(t.role == TRAINED, F.concat(acc.spans, F.array(span))).otherwise(acc.spans)
            return F.struct((acc.at + head + body).alias("at"), spans.alias("spans"))

        return F.aggregate(turns, start, step, lambda acc: acc.spans)

    return cut.select(
        "pair_id", "chosen", "rejected", "prompt_turns",
        text_of(F.slice("a", 1, F.col("prompt_turns"))).alias("prompt"),
        text_of(after("a")).alias("chosen_completion"), text_of(after("b")).alias("rejected_completion"),
        mask(after("a")).alias("chosen_mask"), mask(after("b")).alias("rejected_mask"),
    )


def _by_turn(x: Column, y: Column) -> Column:
    def order(a: Column, b: Column, rest: Column | int) -> Column:
        return (
            F.when(a.isNull() & b.isNotNull(), -1).when(a.isNotNull() & b.isNull(), 1)
            .when(a < b, -1).when(a > b, 1).otherwise(rest)
        )

    return order(x.turn, y.turn, order(x.role, y.role, order(x.text, y.text, F.lit(0))))


def answered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns, pairs)``: each conversation up to its last answer, chosen, beside itself with another one's last answer, rejected.

    Conversations 2k and 2k + 1 give each other their answers, so a pair has all turns before the answer in common. In the
    new turns ids are text; ``pairs`` has ``(pair_id, chosen, rejected, donor)``, where pair_id is the conversation's own id and donor
    the one whose answer is rejected. Conversations without an id, without an assistant's turn or without a partner that
    has one are left out. Of turns with one number the last by role and text is the answer.
    """
    own = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.struct("turn", "role", "text")
    last = own.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(at).alias("answer"))
    partner = F.col("conv_id").cast("long").bitwiseXOR(F.lit(1))
    both = last.join(last.select(partner.alias("conv_id"), F.col("conv_id").alias("donor"), F.col("answer").alias("given")), "conv_id")
    name = lambda mark: F.concat(F.col("conv_id").cast("string"), F.lit(mark))
    met = own.join(both, "conv_id")
    chosen = met.where(at <= F.col("answer")).select(name("+").alias("conv_id"), "turn", "role", "text")
    before = met.where(at < F.col("answer")).select(name("-").alias("conv_id"), "turn", "role", "text")
    answer = both.select(name("-").alias("conv_id"), "answer.turn", "given.role", "given.text")
    pairs = both.select(F.col("conv_id").alias("pair_id"), name("+").alias("chosen"), name("-").alias("rejected"), "donor")
    return chosen.union(before).union(answer), pairs


def digest(turns: DataFrame) -> DataFrame:
    """Each conversation's own last answer against its partner's; masks as text, ``start+length`` joined by commas.

    ``chosen`` is the conversation and ``rejected`` the one whose answer stands against it. Rows that are null, repeated or without
    a partner are as in ``answered``; an empty table has no pairs.
    """
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s.start.cast("string"), s.length.cast("string"))), ",")
    made, pairs = answered(turns)
    out = format_pairs(made, pairs).drop("chosen", "rejected").join(pairs.select("pair_id", F.col("pair_id").alias("chosen"), F.col("donor").alias("rejected")), "pair_id")
    return out.withColumn("chosen_mask", shown("chosen_mask")).withColumn("rejected_mask", shown("rejected_mask"))


#: The same rows for DuckDB.
SQL = """WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
 rank() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT conv_id, max(k) AS k FROM o WHERE role = 'assistant' GROUP BY 1),
l AS (SELECT DISTINCT o.* FROM o JOIN m ON m.conv_id = o.conv_id AND m.k = o.k),
p AS (SELECT a.conv_id, b.conv_id AS donor, a.turn, a.k, b.text AS given FROM l a JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
u AS (SELECT o.conv_id, 1 AS side, o.turn, o.role, o.text FROM o JOIN p ON p.conv_id = o.conv_id WHERE o.k <= p.k
 UNION ALL SELECT o.conv_id, 2, o.turn, o.role, o.text FROM o JOIN p ON p.conv_id = o.conv_id WHERE o.k < p.k
 UNION ALL SELECT conv_id, 2, turn, 'assistant', given FROM p),
t AS (SELECT conv_id, side, role, text, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) AS k FROM u),
n AS (SELECT conv_id, side, max(k) AS n FROM t GROUP BY 1, 2),
d AS (SELECT a.conv_id, min(a.k) AS k FROM t a JOIN t b ON b.conv_id = a.conv_id AND a.side = 1 AND b.side = 2 AND b.k = a.k
 WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1),
c AS (SELECT p.conv_id, p.donor, CAST(coalesce(d.k - 1, least(x.n, y.n)) AS INTEGER) AS prompt_turns FROM p JOIN n x ON x.conv_id = p.conv_id AND x.side = 1
 JOIN n y ON y.conv_id = p.conv_id AND y.side = 2 LEFT JOIN d ON d.conv_id = p.conv_id),
r AS (SELECT conv_id, side, role, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, length(role) + 5 AS head, length(text) + 8 AS body FROM t),
s AS (SELECT c.donor, c.prompt_turns, r.*,
 sum(head + body) OVER (PARTITION BY r.conv_id, r.side, r.k > c.prompt_turns ORDER BY r.k) - body AS start FROM c JOIN r ON r.conv_id = c.conv_id)
SELECT conv_id AS pair_id, conv_id AS chosen, donor AS rejected, prompt_turns,
 coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 1 AND k <= prompt_turns), '') AS prompt,
 coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 1 AND k > prompt_turns), '') AS chosen_completion,
 coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 2 AND k > prompt_turns), '') AS rejected_completion,
 coalesce(string_agg(start || '+' || body, ',' ORDER BY k) FILTER (side = 1 AND k > prompt_turns AND role = 'assistant'), '') AS chosen_mask,
 coalesce(string_agg(start || '+' || body, ',' ORDER BY k) FILTER (side = 2 AND k > prompt_turns AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY conv_id, donor, prompt_turns"""
