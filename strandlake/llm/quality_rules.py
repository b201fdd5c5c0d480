"""Line-first quality rules: bad lines go, then documents that lost too much text.

Every line that holds a word is judged by itself (navigation, symbols, shouting,
boilerplate, missing end punctuation).  Failing lines are removed; a document is
rejected if the removed lines hold more than ``max_lost`` of its text.  Everything is
one projection over the scan: no shuffle, no Python.

Defined results: null text counts as empty; a text without words has ``n_words`` 0 and
is ``base_failed``; repeated rows and ties do not influence each other, as each row is
judged alone; boilerplate phrases count as whole words only ("catalog in" holds no "log
in") and in short lines only; a text of any length is judged whole, row by row; further columns are passed through by :func:`clean_documents` under any names and
are never read; :func:`with_rules` replaces those named as its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: Phrases of lines that belong to a site, not to a text.
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "use cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in",
    "privacy policy",
    "read more",
    "sign up",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
]

#: Blanks of a line up to which a phrase tells that the line is no text.
SHORT_LINE = 20
#: A phrase between ends of the line or characters that are no letter and no digit.
PHRASE = "(^|[^0-9a-zß-öø-ɏ])(" + "|".join(BOILERPLATE) + ")($|[^0-9a-zß-öø-ɏ])"


def _without(text: str, chars: list[str]) -> str:
    for c in chars:
        text = f"replace({text}, '{c}', '')"
    return text


#: The rules of one line ``l`` that is free of outer blanks, in SQL that Spark and DuckDB both read
#: (octet_length is DuckDB's strlen, regexp_like its regexp_matches).
LINE_FAILS = {
    "navigation": "octet_length(l) - octet_length(replace(l, '|', '')) >= 2",
    "symbols": f"100 * (octet_length(l) - octet_length({_without('l', list(SYMBOLS))})) > 10 * octet_length(l)",
    "exclamation": "octet_length(l) - octet_length(replace(l, '!!', '')) >= 6",
    "boilerplate": f"octet_length(l) - octet_length(replace(l, ' ', '')) <= {SHORT_LINE} AND regexp_like(lower(l), '{PHRASE}')",
    "punctuation": "instr('.!?:;…\"”’»)', right(l, 1)) = 0 AND octet_length(l) - octet_length(replace(l, ' ', '')) >= {open_words}",
}


def fails(open_words: int) -> str:
    return " OR ".join(f"({x.replace('{open_words}', str(open_words))})" for x in LINE_FAILS.values())


MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
HELPERS = ["_text", "_bare", "_words", "_raw", "_lines", "_grams", "_twice", "_sorted", "_places", "_marked", "_low", "_named", "_good"]


def with_rules(docs: DataFrame, **rules: float) -> DataFrame:
    """``docs`` with base statistics, ``kept`` and ``clean_text``; options as in :func:`judged`."""
    step, names = aside(docs, [*MADE, *HELPERS])
    back = [F.col(there).alias(c) for c, there in names.items() if c not in MADE]
    return judged(step, **rules).select(*back, *MADE)


def judged(
    docs: DataFrame, max_lost: float = 0.3, open_words: int = 30, min_words: int = 10, max_repeated: float = 0.2
) -> DataFrame:
    """``docs`` with base statistics, ``kept`` and ``clean_text``, the text without failing lines.

    ``open_words``: from so many blanks on, a line must end like a sentence.
    ``min_words``, ``max_repeated``: the base rules on words and on words in repeated
    five-word windows.
    """
    step = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    # "\x0b" and "\x0c" by their numbers, as SQL strings know no shorter form
    step = step.withColumn("_bare", F.expr(r"trim(BOTH ' \t\n\u000b\u000c\r' FROM _text)"))
    step = step.withColumns(
        {
            "_words": F.expr(r"CASE WHEN _bare = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(_bare, '[\\x20\\x09-\\x0D]+', -1) END"),
            "_raw": F.expr(r"filter(split(_text, '\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"),
            "n_symbols": F.expr(f"CAST(octet_length(_text) - octet_length({_without('_text', list(SYMBOLS))}) AS BIGINT)"),
            "word_chars": F.expr(
                "CAST(length(_text) - octet_length(_text) + octet_length("
                + _without("_text", [" ", r"\t", r"\n", r"\u000b", r"\u000c", r"\r"])
                + ") AS BIGINT)"
            ),
            "_low": F.lower("_text"),
        }
    )
    step = step.withColumn("_named", F.expr(" OR ".join(f"_low LIKE '%{x}%'" for x in BOILERPLATE)))
    # equal windows have equal hashes: only texts where a hash comes twice are looked at by their words
    step = step.withColumn(
        "_grams",
        F.expr(
            "CASE WHEN size(_words) < 6 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(_words) - 5), i -> "
            "xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])) END"
        ),
    )
    step = step.withColumn("_twice", F.expr("size(array_distinct(_grams)) < size(_grams)"))
    step = step.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN _twice THEN sort_array(transform(sequence(0, size(_words) - 5), i -> "
            "struct(concat_ws(' ', slice(_words, i + 1, 5)) AS g, i AS i))) END"
        ),
    )
    step = step.withColumn(
        "_places",
        F.expr(
            "CASE WHEN _twice THEN sort_array(transform(filter(transform(_sorted, (x, k) -> struct(x.i AS i, "
            "(k > 0 AND x.g = _sorted[greatest(k - 1, 0)].g) OR (k < size(_sorted) - 1 AND x.g = _sorted[least(k + 1, size(_sorted) - 1)].g) AS same)), "
            "x -> x.same), x -> x.i)) ELSE CAST(array() AS ARRAY<INT>) END"
        ),
    )
    step = step.withColumns(
        {
            "n_words": F.expr("CAST(size(_words) AS BIGINT)"),
            "n_dup_lines": F.expr("CAST(size(_raw) - size(array_distinct(_raw)) AS BIGINT)"),
            "n_repeat_words": F.expr(
                "CAST(aggregate(_places, struct(CAST(-5 AS INT) AS last, CAST(0 AS BIGINT) AS n), "
                "(a, p) -> struct(p AS last, a.n + least(5, p - a.last) AS n), a -> a.n) AS BIGINT)"
            ),
            "_lines": F.expr(r"transform(_raw, l -> trim(BOTH ' \t\r\u000b\u000c' FROM l))"),
            # without any of these marks in the text no line can fail but by its end
            "_marked": F.expr("_named OR n_symbols > 0 OR contains(_text, '!!')"),
        }
    )
    rules, last = fails(open_words), LINE_FAILS["punctuation"].replace("{open_words}", str(open_words))
    step = step.withColumn("_good", F.expr(f"CASE WHEN _marked THEN filter(_lines, l -> NOT ({rules})) ELSE filter(_lines, l -> NOT ({last})) END"))
    step = step.withColumn("base_failed", F.expr(f"n_words < {min_words} OR n_repeat_words > {max_repeated}D * n_words"))
    held = "CAST(aggregate({0}, 0L, (n, l) -> n + length(l)) AS DOUBLE)"
    step = step.withColumn(
        "kept", F.expr(f"NOT base_failed AND {held.format('_lines')} - {held.format('_good')} <= {max_lost}D * {held.format('_lines')}")
    )
    step = step.withColumn("clean_text", F.array_join("_good", "\n"))
    # a generator of one row: filters on these columns stay above it, where everything is computed once
    return step.select(*docs.columns, F.inline(F.array(F.struct(*MADE))))


def clean_documents(docs: DataFrame, **rules: float) -> DataFrame:
    """The documents that pass, with their columns and their texts without failing lines."""
    step, names = aside(docs, [*MADE, *HELPERS])
    out = judged(step, **rules).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(there).alias(c) for c, there in names.items()))
