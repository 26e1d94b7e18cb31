"""Quality rules: a table of thresholds compiled into one projection of DataFrame functions.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]``; lines are split at ``\\n`` and count only with a word in them.
Nulls and empty texts have no words: all counts are 0, ratios 0.0, ``base_failed`` true. Repeated rows are judged row by row;
an empty table gives an empty result; columns other than the two named ones are ignored by ``measure`` and kept by ``passing``.
There is no shuffle: every figure of a row comes from that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for as on are this was by or at "
    "der die das und den von zu mit ist im nicht ein eine auf für sich des dem "
    "le la les et des en un une est que dans pour qui sur du de pas au "
    "el los las y una por con para del se lo su al"
).split()
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Threshold table: figure, least, most (None: open).
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_length", 2.0, 12.0),
    ("symbol_ratio", None, 0.1),
    ("stop_words", 2, None),
    ("alpha_word_ratio", 0.7, None),
    ("dup_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the text.

    Windows are compared by a 64-bit hash of their words; positions of repeated hashes are found by sorting (hash, position)
    pairs, and only where some hash does repeat.
    """
    empty = F.array().cast("array<bigint>")

    def covered(pairs: Column) -> Column:
        again = F.filter(pairs, lambda x, j: (F.try_element_at(pairs, F.when(j > 0, j)).getField("h") == x.getField("h")) | (F.try_element_at(pairs, j + 2).getField("h") == x.getField("h")))
        starts = F.array_sort(F.transform(again, lambda x: x.getField("i")))
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
        total = F.aggregate(starts, zero, lambda a, p: F.struct((a.getField("n") + F.least(F.lit(WINDOW), p - a.getField("last"))).cast("bigint").alias("n"), p.alias("last")))
        return total.getField("n")

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bind(pairs, covered)).otherwise(F.lit(0).cast("bigint"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _bind(hashed, lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hs, i, WINDOW))))
    return _bind(F.when(F.size(words) > WINDOW, windows).otherwise(empty), count)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per row of ``docs`` with every figure, ``base_failed`` and ``kept``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    parts = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), words.alias("w"), lines.alias("l"))
    long = lambda c: c.cast("bigint")
    w, lns = F.col("w"), F.col("l")
    counts = parts.select(
        "doc_id",
        long(F.size(w)).alias("n_words"),
        F.aggregate(w, long(F.lit(0)), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        long(F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size(lns) - F.size(F.array_distinct(lns))).alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        long(F.size(lns)).alias("n_lines"),
        long(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))).alias("stop_words"),
        long(F.size(F.filter(w, lambda x: x.rlike(r"\p{L}")))).alias("n_alpha_words"),
        long(F.size(F.filter(lns, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")))).alias("n_bullet_lines"),
        long(F.size(F.filter(lns, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))).alias("n_ellipsis_lines"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    figures = {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_words": F.col("stop_words"),
        "alpha_word_ratio": ratio("n_alpha_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
    }
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    holds = F.lit(True)
    for name, least, most in rules:
        holds = holds & (figures[name] >= least if least is not None else F.lit(True)) & (figures[name] <= most if most is not None else F.lit(True))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "stop_words", "n_alpha_words",
        base.alias("base_failed"), (~base & holds).alias("kept"),
    )


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    boxed = docs.select(row.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return measure(boxed, rules=rules).where("kept").select("doc_id.*")


def sql(rules=RULES) -> str:
    """The same rows for DuckDB."""
    figure = {
        "mean_word_length": "word_chars / n_words",
        "symbol_ratio": "n_symbols / n_words",
        "stop_words": "stop_words",
        "alpha_word_ratio": "n_alpha_words / n_words",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "bullet_line_ratio": "CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0 END",
        "ellipsis_line_ratio": "CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0 END",
    }
    tests = [f"{figure[n]} >= {a}" for n, a, _ in rules if a is not None] + [f"{figure[n]} <= {b}" for n, _, b in rules if b is not None]
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i:i + {WINDOW - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range({WINDOW}) r(k) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS stop_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, stop_words, n_alpha_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {' AND '.join(tests)} END AS kept FROM b"""
