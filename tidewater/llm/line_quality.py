"""Line-first quality rules, all in DataFrame functions.

Each line is judged alone: by its punctuation (symbols, shouting), as
navigation (separators between few words) and as boilerplate (fixed phrases,
one word over and over).  Failing lines are removed; then a document is
rejected if it lost too much of its text, or if it fails the base rules on
length and on repeated three-word windows.

Words are runs of anything but ASCII white space.  A null or empty text has no
words, no lines and no kept text; it fails for its length.  Window equality is
that of 64-bit hashes of three words within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as common

SPACE = r"[ \t-\r]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a document's word characters that may go with its failing lines.
MAX_LOST = 0.3
#: Symbols for each word character of a line.
MAX_SYMBOLS = 0.1
#: Share of capitals in the letters of a line of some words, and of words with two marks at their end.
MAX_CAPITALS, MAX_SHOUTS, SHOUT_WORDS = 0.7, 0.3, 4
#: Different words for each word of a line of some words.
MIN_VARIETY, VARIETY_WORDS = 0.25, 12
SEPARATOR = r"[|>»›•·]"
#: What a line with too many symbols, separators, marks or capitals has: one of these, or two capitals with no other letter between, or one capital as its only letter.
SUSPECT = r"[#*$%&|<>»›•·]|[!?]{2}|\p{Lu}\P{L}*\p{Lu}|\A\P{L}*\p{Lu}\P{L}*\z"
BOILERPLATE = r"(?i)\b(cookies?|javascript|all rights reserved|terms of (use|service)|privacy policy|subscribe to|sign up|log ?in|click here|read more|lorem ipsum)\b"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def has_words(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]")


def line_fails(line: Column) -> Column:
    """Whether a line is to be removed; lines without words never are.

    Symbols, marks, separators or capitals fail a line only if it matches
    ``SUSPECT``, so the counts are taken of such lines alone.
    """
    solid = _without(line, SPACES)
    chars = F.length(solid)
    n_words = F.regexp_count(line, F.lit(r"[^ \t-\r]+"))
    symbols = chars - F.length(_without(solid, SYMBOLS))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    capitals = chars - F.length(F.regexp_replace(solid, r"\p{Lu}", ""))
    letters = chars - F.length(F.regexp_replace(solid, r"\p{L}", ""))
    shouts = F.regexp_count(line, F.lit(r"[!?]{2,}(?=[ \t-\r]|$)"))
    form = (
        (symbols > MAX_SYMBOLS * chars)
        | ((separators >= 2) & (3 * separators >= n_words))
        | ((n_words >= SHOUT_WORDS) & ((shouts > MAX_SHOUTS * n_words) | (capitals > MAX_CAPITALS * letters)))
    )
    words = words_of(line)
    return has_words(line) & (
        (line.rlike(SUSPECT) & form)
        | ((F.size(words) >= VARIETY_WORDS) & (F.size(F.array_distinct(words)) < MIN_VARIETY * F.size(words)))
        | (line.rlike(BOILERPLATE) & (F.size(words) <= 12))
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_kept_lines", "lost", "kept", "clean_text"]


def judge(docs: DataFrame, name: str = "quality", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` and, as its last column, a struct of ``MEASURES``; one pass, no shuffle.

    Each row is judged by its own text, so repeated rows have equal results and a
    very long text is one row's work.  If ``docs`` has a column ``name``, it
    stays and the new one gets underscores before its name.
    """
    name = common.free_name(docs, name)
    held = {k: common.free_name(docs, f"_{k}") for k in ("text", "words", "lines", "hashes", "grams", "places", "left")}
    text, words, lines, hashes, grams, places, left = (F.col(c) for c in held.values())
    out = docs.withColumn(held["text"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumns({held["words"]: words_of(text), held["lines"]: F.split(text, "\n")})
    gram = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    out = out.withColumn(held["hashes"], F.when(F.size(words) > 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), gram)).otherwise(F.expr("cast(array() as array<bigint>)")))
    # places are only sought where a window comes twice
    out = out.withColumn(
        held["grams"],
        F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")),
    )
    same = lambda g, k: F.coalesce(F.get(grams, k).h == g.h, F.lit(False))
    twice = F.filter(grams, lambda g, k: same(g, k - 1) | same(g, k + 1))
    out = out.withColumns({held["places"]: F.sort_array(F.transform(twice, lambda g: g.i)), held["left"]: F.filter(lines, lambda x: ~line_fails(x))})
    n_words, word_chars = F.size(words).cast("long"), F.length(_without(text, SPACES)).cast("long")
    repeated = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a.n
    )
    real = F.filter(lines, has_words)
    kept_chars = F.when(F.size(left) == F.size(lines), word_chars).otherwise(F.length(_without(F.array_join(left, "\n"), SPACES)))
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    lost = F.when(word_chars > 0, 1 - kept_chars / word_chars).otherwise(0.0)
    out = out.withColumn(
        name,
        F.struct(
            n_words.alias("n_words"),
            word_chars.alias("word_chars"),
            (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size(real) - F.size(F.array_distinct(real))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.size(lines).alias("n_lines"),
            F.size(left).alias("n_kept_lines"),
            lost.alias("lost"),
            (~failed & (kept_chars >= (1 - max_lost) * word_chars)).alias("kept"),
            F.array_join(left, "\n").alias("clean_text"),
        ),
    )
    return out.drop(*held.values())
