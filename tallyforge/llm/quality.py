"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Defined cases: a null text counts as empty and fails (no words); repeated rows are judged alike, each on its own;
columns beyond doc_id and text are ignored by ``measure`` and kept by ``filter_documents``; an empty table gives an empty
table. Every text is measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, SPACES

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on are as with be by this from or an at which not have has but were they he a "
    "le la les de des du et un une en est que qui dans pour pas sur par au avec ce plus ou il elle ne se sont "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "el los las y del se por con una su para como más al lo o pero sus le ya fue este"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low/100 * per <= value <= high/100 * per, in whole numbers; None is no limit."""

    name: str
    value: str
    per: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        at = F.col(self.value) * 100
        tests = [at >= self.low * F.col(self.per)] if self.low is not None else []
        tests += [at <= self.high * F.col(self.per)] if self.high is not None else []
        return reduce(lambda a, b: a & b, tests)

    def sql(self) -> str:
        tests = [f"100 * {self.value} >= {self.low} * {self.per}"] if self.low is not None else []
        tests += [f"100 * {self.value} <= {self.high} * {self.per}"] if self.high is not None else []
        return " AND ".join(tests)


#: The threshold table: percentages of `per`.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=40),
)


def measure(documents: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: list[str] | None = None) -> DataFrame:
    """doc_id, the base measures, the method's own (n_lines, n_stop_words), base_failed, a column per rule, and kept."""
    stops = sorted(set(stop_words or STOP_WORDS))
    arrays = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "").alias("lines"),
    )
    n = F.size("words")
    hashes = F.transform(
        F.slice("words", 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    # An undetermined column stays below what uses it: later filters aren't pushed below it, nor is it computed for each use.
    once = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    stop_count = F.size(F.filter("words", lambda w: F.lower(w).isin(stops)))
    hashed = arrays.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        stop_count.cast("long").alias("n_stop_words"),
        once(hashes).alias("hashes"),
    )
    # Places matter only where a window is found twice; most texts have no such window.
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    places = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    counted = hashed.withColumn("sorted_windows", once(F.when(repeated, F.sort_array(places)).otherwise(none))).drop("hashes")
    same = lambda x, j: F.get("sorted_windows", j)["h"] == x["h"]
    found = F.filter(
        "sorted_windows", lambda x, j: ((j > 0) & same(x, j - 1)) | F.coalesce(same(x, j + 1), F.lit(False))
    )
    starts = F.sort_array(F.transform(found, lambda x: x["i"]))
    # A window covers its start and the two words after it, less what the next start covers again.
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    judged = counted.withColumn("n_repeat_words", covered).drop("sorted_windows")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    verdict = reduce(lambda a, b: a & b, [r.passes() for r in rules], F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict).alias("kept"), "n_lines", "n_stop_words",
        *[r.passes().alias(f"passes_{r.name}") for r in rules],
    )


def filter_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of documents that the rules keep, with their own columns.

    The measures are computed beside the row and dropped again, in one scan without a shuffle.
    """
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)])
    text = F.col("text") if "text" in documents.columns else F.lit(None).cast("string")
    rows = documents.select(own.alias("doc_id"), text.alias("text"))
    kept = measure(rows, rules).filter("kept")
    return kept.select(*[F.col(f"doc_id.c{i}").alias(c) for i, c in enumerate(documents.columns)])


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    stops = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    none = lambda of: f"translate({of}, {spaces}, '')"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, text,
         list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: {none("x")} <> '') AS lines
  FROM d
), p AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n FROM p
), r AS (
  SELECT rid, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n >= 2) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length({none("text")}) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN r USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(r.sql() for r in rules)} AS kept, n_lines, n_stop_words,
       {", ".join(f"{r.sql()} AS passes_{r.name}" for r in rules)}
FROM f"""
