"""SQL text of the stemmer, from the same published tables, for checks against another engine."""

from __future__ import annotations

from .functions.porter import STEP2, STEP3, STEP4

def _cv(word: str) -> str:
    return (
        f"list_reduce(list_prepend('', string_split({word}, '')), lambda a, ch: a || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') "
        f"OR (ch = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END)"
    )


def _m(cv: str) -> str:
    return f"len(regexp_extract_all({cv}, 'v+c+'))"


def _cut(n: int) -> str:
    """Word without its last n letters."""
    return f"left(w, length(w) - {n})"


def _cut_cv(n: int) -> str:
    return f"left(cv, length(w) - {n})"


def _longest_first(suffixes):
    return sorted(suffixes, key=lambda s: -len(s[0] if isinstance(s, tuple) else s))


def _swap(rules) -> str:
    cases = [
        f"WHEN ends_with(w, '{a}') THEN CASE WHEN {_m(_cut_cv(len(a)))} > 0 THEN {_cut(len(a))} || '{b}' ELSE w END"
        for a, b in _longest_first(rules)
    ]
    return f"CASE {' '.join(cases)} ELSE w END"


def _drop() -> str:
    def rule(s: str) -> str:
        more = f" AND right({_cut(3)}, 1) IN ('s', 't')" if s == "ion" else ""
        return f"WHEN ends_with(w, '{s}') THEN CASE WHEN {_m(_cut_cv(len(s)))} > 1{more} THEN {_cut(len(s))} ELSE w END"

    return f"CASE {' '.join(map(rule, _longest_first(STEP4)))} ELSE w END"


def porter_sql(words: str) -> str:
    """CTEs that end in ``stems(word, stem)`` for the lower-case words of a query with the column ``word``."""
    plural = (
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) "
        "WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"
    )
    past = (
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m(_cut_cv(3))} > 0 THEN {_cut(1)} ELSE w END "
        f"WHEN ends_with(w, 'ed') THEN CASE WHEN contains({_cut_cv(2)}, 'v') THEN '+' || {_cut(2)} ELSE w END "
        f"WHEN ends_with(w, 'ing') THEN CASE WHEN contains({_cut_cv(3)}, 'v') THEN '+' || {_cut(3)} ELSE w END ELSE w END"
    )
    # A '+' in front marks a word whose ending was removed; the pattern is that of the word without the mark.
    mend = (
        "CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' "
        "WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(cv, 1) = 'c' THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE left(w, length(w) - 1) END "
        f"WHEN {_m('cv')} = 1 AND right(cv, 3) = 'cvc' AND right(w, 1) NOT IN ('w', 'x', 'y') THEN w || 'e' ELSE w END"
    )
    y_to_i = f"CASE WHEN ends_with(w, 'y') AND contains({_cut_cv(1)}, 'v') THEN {_cut(1)} || 'i' ELSE w END"
    final_e = (
        f"CASE WHEN ends_with(w, 'e') AND ({_m(_cut_cv(1))} > 1 OR ({_m(_cut_cv(1))} = 1 AND NOT "
        f"(right({_cut_cv(1)}, 3) = 'cvc' AND right({_cut(1)}, 1) NOT IN ('w', 'x', 'y')))) THEN {_cut(1)} ELSE w END"
    )
    final_l = f"CASE WHEN ends_with(w, 'll') AND {_m('cv')} > 1 THEN {_cut(1)} ELSE w END"

    def step(name: str, source: str, expression: str) -> str:
        return f"{name} AS MATERIALIZED (SELECT word, {expression} AS w FROM (SELECT word, w, {_cv('w')} AS cv FROM {source}))"

    steps = [
        f"p0 AS MATERIALIZED (SELECT word, word AS w FROM ({words}) WHERE length(word) > 2)",
        step("p1", "p0", plural),
        step("p2", "p1", past),
        f"p3 AS MATERIALIZED (SELECT word, {mend} AS w FROM (SELECT word, cut, w, {_cv('w')} AS cv FROM (SELECT word, starts_with(w, '+') AS cut, ltrim(w, '+') AS w FROM p2)))",
        step("p4", "p3", y_to_i),
        step("p5", "p4", _swap(STEP2)),
        step("p6", "p5", _swap(STEP3)),
        step("p7", "p6", _drop()),
        step("p8", "p7", final_e),
        step("p9", "p8", final_l),
        f"stems AS (SELECT word, w AS stem FROM p9 UNION ALL SELECT word, word FROM ({words}) WHERE length(word) <= 2)",
    ]
    return ", ".join(steps)
