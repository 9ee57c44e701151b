import re

from oracle import connect, rows_of

from tessella.llm import preference as X

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c in by:
        if c % 2 == 0 and c + 1 in by:
            a, b = ([(r, x) for _, _, r, x in sorted(by[k])] for k in (c, c + 1))
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            show = lambda ts: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in ts)
            out[c // 2] = (n, show(a[:n]), show(a[n:]), show(b[n:]))
    return out


def check(spark, rows):
    out = X.format_pairs(df := spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS side", "1 AS pair_id"), X.consecutive(df)).collect()
    assert {r.pair_id: (r.prompt_turns, r.prompt, r.chosen_completion, r.rejected_completion) for r in out} == plain(rows)
    for r in out:
        for text, mask in ((r.chosen_completion, r.chosen_mask), (r.rejected_completion, r.rejected_mask)):
            want = [(m.start(1), len(m.group(1))) for m in re.finditer(r"<\|assistant\|>\n(.*?<\|end\|>\n)", text, re.S)]
            assert [(s.start, s.length) for s in mask] == want
    return out


def test_prefixes_masks_and_odd_rows(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "good"),
        (1, 3, "assistant", "bad"), (1, 2, "user", "more"), (1, 1, "assistant", "a"), (1, 0, "user", "hi"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "x"), (5, 0, "system", "x"),
        (6, None, None, None), (6, 1, "assistant", ""), (7, None, None, None), (7, 1, "assistant", "Ünï 漢字"),
        (8, 0, "user", "alone"), (None, 0, "user", "no id"), (10, 0, "user", "q"), (10, 0, "user", "q"), (11, 0, "user", "q"),
        (12, 0, "user", "long " * 20000), (13, 0, "user", "long " * 20000), (13, 1, "assistant", "z"),
    ]
    out = {r.pair_id: r for r in check(spark, rows)}
    assert out[0].prompt_turns == 3 and out[1].chosen_completion == "" and out[2].prompt == ""
    assert out[5].prompt_turns == 1 and out[3].prompt_turns == 1


def test_empty_table(spark):
    assert check(spark, []) == []


def test_equals_sql(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    got = X.digest(turns)
    cols = sorted(got.columns)
    sql = connect(data).execute(X.SQL)
    names = [c[0] for c in sql.description]
    rows = [[r[names.index(c)] for c in cols] for r in sql.fetchall()]
    assert rows_of(got.select(*cols).collect()) == rows_of(rows)


def test_sql_over_common_prefixes(spark, tmp_path):
    import duckdb

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t < c % 5 else f"c{c}t{t}") for c in range(40) for t in range(c % 4 + 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    got = X.digest(df)
    cols = sorted(got.columns)
    sql = con.execute(X.SQL)
    names = [c[0] for c in sql.description]
    assert rows_of(got.select(*cols).collect()) == rows_of([[r[names.index(c)] for c in cols] for r in sql.fetchall()])


def test_plan_has_no_python(spark, data):
    plan = X.digest(spark.read.parquet(f"{data}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ids_above_doubles(spark):
    big = 2**60
    turns = [(i, 0, "user", f"t{i}") for i in (big, big + 1, big + 2, big + 3, -1, -2)]
    pairs = X.consecutive(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.chosen, r.rejected) for r in pairs) == [(-2, -1), (big, big + 1), (big + 2, big + 3)]


def test_most_registered_pairs_have_a_prompt(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    rows = X.digest(turns).collect()
    assert rows and sum(r.prompt_turns > 0 and r.prompt != "" for r in rows) > 0.9 * len(rows)
    assert all(r.rejected == r.chosen ^ 1 for r in rows)


def test_answers_are_swapped(spark):
    rows = [
        (4, 0, "user", "q4"), (4, 1, "assistant", "a4"), (4, 2, "user", "thanks"), (5, 7, "assistant", "a5"), (5, 6, None, "q5"),
        (8, 0, "user", "no answer"), (9, 0, "assistant", "alone"), (None, 0, "assistant", "no id"), (12, 0, "assistant", "same"), (13, 0, "assistant", "same"),
        (20, 1, "assistant", "twice"), (20, 1, "assistant", "twice"), (20, 0, "user", "u"), (21, None, "assistant", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS donor", "2 AS answer")
    got = {r.pair_id: r for r in X.digest(df).collect()}
    assert sorted(got) == [4, 5, 12, 13, 20, 21]
    assert (got[4].prompt, got[4].chosen_completion, got[4].rejected_completion) == ("<|user|>\nq4<|end|>\n", "<|assistant|>\na4<|end|>\n", "<|assistant|>\na5<|end|>\n")
    assert (got[5].prompt_turns, got[5].rejected, got[5].rejected_mask) == (1, 4, "14+10")
    assert got[12].prompt_turns == 1 and got[12].chosen_completion == got[12].rejected_completion == ""
    assert got[21].rejected_completion == "<|assistant|>\ntwice<|end|>\n" and got[20].prompt_turns == 1
