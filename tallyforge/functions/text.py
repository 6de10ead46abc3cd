"""Text measures and clean-ups as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of markdown and numbers.
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
BULLET = r"(?m)^\s*(?:[-*+•·‣▪◦⁃]|\d+\.)\s+\S"
HEADING = r"(?m)^\s{0,3}#{1,6}\s+\S"
TABLE_RULE = r"(?m)^\s*\|?[\s:|-]*-{2,}[\s:|-]*\|?\s*$"
SENTENCE = r"[.!?]+(?:\s|$)"
PUNCTUATION_WORD = r"^[*_`~#>|\-–—•·.,:;!?()\[\]{}\"']+$"
TRAILING_NOISE = r"[\s*_`~.,:;!?)\]}\"'$]+$"
UNCERTAIN = (
    "don't know", "do not know", "not know", "not sure", "uncertain", "unknowab", "unpredictab", "impossib", "unattainab", "unanswerab",
    "cannot", "can't", "unable to", "not possible", "no way", "no one", "nobody", "don't have access", "do not have access",
    "only estimate", "only an estimate", "rough estimate", "beyond anyone", "not feasible",
)
CHARS_PER_TOKEN, NGRAM, TAIL = 4.7, 8, 0.25
LOOP, CHAR_LOOP, SAME_CALLS = 0.5, 0.9, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once; named plainly inside a lambda, it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def prose_words(text: Column) -> Column:
    """Words that are more than punctuation."""
    return F.filter(words(text), lambda w: ~F.rlike(w, F.lit(PUNCTUATION_WORD)))


def strip_reasoning(text: Column) -> Column:
    """Without <think> blocks; up to a stray closing tag and from a stray opening one, all is reasoning."""
    paired = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    after = F.regexp_replace(paired, r"(?is)^.*?</think>", "")
    return stripped(F.regexp_replace(after, r"(?is)<think>.*$", ""))


def repetition(text: Column, n: int = NGRAM) -> Column:
    """The share of word n-grams that repeat an earlier one; 0 for texts of fewer than two windows."""

    def share(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(n)]))
        return F.when(F.size(w) < 2 * n, 0.0).otherwise(let(grams, lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)))

    return let(words(F.lower(text)), share)


def loop_ratio(text: Column) -> Column:
    """The stronger repetition of the whole text and of its last quarter."""
    start = F.floor(F.length(text) * (1 - TAIL)).cast("int")
    return F.greatest(repetition(text), repetition(F.substring(text, start + 1, F.length(text))))


def last_number(text: Column) -> Column:
    """The last number in a text, without thousands' commas; null without one."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), 0)
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")).try_cast("double")


def bullets(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BULLET))


def headings(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HEADING))


def sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("long")


def salt_offset(salt: Column) -> Column:
    """A number below a million from a salt's hash; 0 for an empty salt."""
    return F.when(salt == "", F.lit(0)).otherwise(F.conv(F.substring(F.sha2(salt, 256), 1, 8), 16, 10).cast("long") % 1_000_000).cast("long")


def normalize_file(text: Column) -> Column:
    """Line ends as LF, no white space before them, no blank lines at the end, one final line end; empty stays empty."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)[ \t\x0B\f]+$", "")
    body = F.regexp_replace(lines, r"\n+\z", "")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "_")


def slug_each(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9._-]", "_")


def is_uncertain(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "[*_`]", "")
    return reduce(lambda a, s: a | F.contains(plain, F.lit(s)), UNCERTAIN, F.lit(False))


def truncation_class(truncated: Column, loop: Column, char_loop: Column, same_calls: Column) -> Column:
    """'' for a whole answer; else whether it ran in circles or only out of room."""
    circles = (loop > LOOP) | (char_loop > CHAR_LOOP) | (same_calls >= SAME_CALLS)
    return F.when(~truncated, "").when(circles, "degenerate").otherwise("incomplete")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def set_hash(keys: Column) -> Column:
    """Over a group: the hash of its distinct keys, sorted, a line each."""
    return short_hash(F.array_join(F.array_sort(F.collect_set(keys)), "\n"))


def infer_band(band: Column, difficulty: Column) -> Column:
    return F.coalesce(band, F.when(difficulty == "easy", "anchor").when(difficulty == "hard", "hard").otherwise("mid"))


def read_timeout(floor: Column, cap: Column, rate: Column, allowance: Column) -> Column:
    return F.greatest(floor, cap / rate + allowance)


def within_budget(made: Column, optimal: Column) -> Column:
    """Calls up to twice the optimum, and never fewer than three above it."""
    return F.when((made == 0) | (optimal <= 0), True).otherwise(made <= F.greatest(2 * optimal, optimal + 3))
