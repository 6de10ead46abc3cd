"""Source divergence audit: how far the sources of a language are from each other in their use of its common terms.

Terms are runs of ASCII letters and of all that isn't ASCII, with A-Z in lower case. They are found by bytes: one table look-up
over the concatenated UTF-8 of many texts marks what belongs to a term, and its edges are the terms' bounds. Slices are grouped by
their xxhash and then compared byte by byte with the first of their group, so that a collision splits again. A language keeps the
terms in at least ``least_docs`` of its documents. Each group (language and source) gives each kept term the smoothed share
p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), in whole numbers, with N the group's count of kept terms and V their number.

Divergences are sums of absolute differences over all V terms. Kept terms are dealt to blocks by hash, sources to tiles; a
task holds the compressed sparse rows of at most two tiles over one block and sums with reduceat, where only stored counts are visited:
what a source lacks is the same smallest share for every term, and its part of the sum comes from sorted prefix sums. Partial sums
of the blocks are added by Spark. Tasks stay small however many terms or sources there are; no table is collected or hinted for broadcast.

Defined cases: null text, lang and source are ''; a document without terms still makes its group occur; a group without kept terms
gives every kept term an equal share; a language that keeps no term has pairs of value 0 and no terms; repeated rows are
documents of their own; ties go to the smaller item in UTF-8; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_bytes, materialize

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 10**9, 50
#: Bytes of text that are tokenised at once, rows of counts held before they are passed on, terms of a block, sources of a tile.
CHUNK, HELD, BLOCK_TERMS, TILE = 4 << 20, 400_000, 1024, 256

#: For each byte: does it belong to a term, and its lower case.
IN_TERM = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts that lie one after the other; none crosses a text's end."""
    inside = IN_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    first[starts] = inside[starts]
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: Callable[[bytes], int]) -> tuple[np.ndarray, list[bytes]]:
    """A number for each slice, equal for equal bytes alone, and the bytes of each number."""
    raw = data.tobytes()
    marks = np.fromiter((hashed(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, number = np.unique(marks, return_index=True, return_inverse=True)
    found = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    lengths, leader = ends - starts, first[number]
    differ = lengths != lengths[leader]
    alike = np.flatnonzero(~differ & (leader != np.arange(len(starts))))
    if len(alike):
        sizes, step = lengths[alike], within(lengths[alike])
        own = data[np.repeat(starts[alike], sizes) + step]
        same = own == data[np.repeat(starts[leader[alike]], sizes) + step]
        differ[alike] = ~np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(differ).tolist():  # collisions
        number[i] = others.setdefault(raw[starts[i] : ends[i]], len(found) + len(others))
    return number, found + list(others)


def count_terms(batch: pa.RecordBatch, hashed: Callable[[bytes], int]) -> pa.Table:
    """lang, source, term, n, docs of a batch of (lang, source, text)."""
    text = batch.column(2).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    offsets, base = offsets - offsets[0], int(offsets[0])
    data = LOWER[np.frombuffer(text.buffers()[2] or b"", np.uint8, int(offsets[-1]), base)]
    starts, ends = boundaries(data, offsets)
    number, terms = group_slices(data, starts, ends, hashed)
    doc = np.searchsorted(offsets, starts, "right") - 1
    groups = pa.StructArray.from_arrays(batch.columns[:2], ["lang", "source"]).to_pylist()
    known: dict[tuple, int] = {}
    of_doc = np.array([known.setdefault((g["lang"], g["source"]), len(known)) for g in groups], np.int64)
    width = max(len(terms), 1)
    seen, times = np.unique(doc * width + number, return_counts=True)  # a row for each document and term
    key = of_doc[seen // width] * width + seen % width
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    n, docs = np.add.reduceat(times, at) if len(at) else times, np.diff(np.append(at, len(key)))
    group, term = key[at] // width, pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(key[at] % width))
    names = list(known)
    lang, source = (pa.array([g[i] for g in names], pa.string()).take(pa.array(group)) for i in (0, 1))
    return pa.table([lang, source, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def summed(parts: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    found = pa.concat_tables(parts).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])


def term_counts(documents: DataFrame, hashed: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it) of every term of every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in by_bytes(batches, 2, CHUNK):
            held.append(count_terms(b, hashed))
            if sum(t.num_rows for t in held) > HELD:
                held = [summed(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches(50_000)
        if held:
            yield from summed(held).to_batches(50_000)

    rows = grouped(documents).select("lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Dealt by language and term: one exchange serves these sums and those over the sources of a term.
    counts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def grouped(documents: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return documents.select(name("lang"), name("source"), "text")


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) in whole numbers, for count <= total < 2**53: three digits of a long division at a time."""
    quotient, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + digits
    return quotient + 1


def distances(indptr: np.ndarray, column: np.ndarray, p: np.ndarray, least: np.ndarray, width: int, own: range) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``own`` the sums of |p - q| over all ``width`` columns to every row; a row's absent columns have its least.

    indptr, column and p are compressed sparse rows.
    """
    filled = np.flatnonzero(np.diff(indptr))
    row = np.repeat(np.arange(len(least)), np.diff(indptr))
    for i in own:
        dense = np.full(width, least[i])
        dense[column[indptr[i] : indptr[i + 1]]] = p[indptr[i] : indptr[i + 1]]
        order = np.sort(dense)
        prefix = np.concatenate([[0], np.cumsum(order)])
        below = np.searchsorted(order, least)
        total = least * below - prefix[below] + (prefix[-1] - prefix[below]) - least * (width - below)
        if len(filled):
            there = dense[column]
            stored = np.abs(there - p) - np.abs(there - least[row])
            total[filled] += np.add.reduceat(stored, indptr[filled])
        yield i, total


PARTS = {"lang": "string", "term": "string", "i": "long", "j": "long", "value": "long", "seen": "long", "gap": "long", "vocabulary": "long"}
SCHEMA = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in PARTS.items()])


def block_sums(key: tuple[pa.Scalar, ...], rows: pa.Table, tile: int = TILE) -> pa.Table:
    """Of one block of terms and two tiles of sources: partial sums for each pair, and each source's first terms.

    rows: a row (no term) for each source, and one for each source and kept term it has.
    """
    lang, _, left, right = (k.as_py() for k in key)
    rows = rows.sort_by([("i", "ascending"), ("term", "ascending")])
    sources, kept = rows.filter(pc.is_null(rows["term"])), rows.filter(pc.is_valid(rows["term"]))
    number = lambda t, c: t[c].to_numpy().astype(np.int64)
    ids, vocabulary = number(sources, "i"), int(sources["vocabulary"][0].as_py())
    totals = number(sources, "total") + SMOOTH * vocabulary
    least = shares(np.full(len(ids), SMOOTH), totals) if vocabulary else np.zeros(len(ids), np.int64)
    row = np.searchsorted(ids, number(kept, "i"))
    indptr = np.searchsorted(row, np.arange(len(ids) + 1))
    terms, column = np.unique(kept["term"].cast(pa.binary()).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    p = shares(number(kept, "n") + SMOOTH, totals[row]) if len(row) else row
    own = range(int(np.searchsorted(ids, (left + 1) * tile)))
    out = []
    for i, total in distances(indptr, column, p, least, len(terms), own):
        to = slice(i + 1 if left == right else len(own), len(ids))
        size = len(ids) - to.start
        pair = [np.full(size, ids[i]), ids[to], total[to], np.full(size, len(terms)), np.abs(least[i] - least[to]), np.full(size, vocabulary)]
        out.append(pa.table([pa.array([lang] * size, pa.string()), pa.nulls(size, pa.string()), *map(pa.array, pair)], schema=SCHEMA))
    if left == right and len(row):
        q = shares(number(kept, "lang_n") + SMOOTH, number(kept, "lang_total") + SMOOTH * vocabulary)
        value = p - q
        order = np.lexsort((column, -value, row))
        place = np.arange(len(order)) - indptr[row[order]]
        first = order[(place < TOP) & (value[order] > 0)]
        texts = pa.array(terms[column[first]], pa.binary()).cast(pa.string())
        n, nothing = len(first), pa.nulls(len(first), pa.int64())
        out.append(pa.table([pa.array([lang] * n, pa.string()), texts, pa.array(ids[row[first]]), nothing, pa.array(value[first]), *[nothing] * 3], schema=SCHEMA))
    return pa.concat_tables(out) if out else SCHEMA.empty_table()


def ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    return out.filter(F.col("rank") <= limit) if limit else out


def audit(
    documents: DataFrame, least_docs: int = LEAST_DOCS, hashed: Callable[[bytes], int] = xxhash.xxh64_intdigest, block_terms: int = BLOCK_TERMS, tile: int = TILE
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of every group; blocks and tiles change the work's shape alone."""
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(documents, hashed).withColumns({"lang_n": F.sum("n").over(by_term), "lang_docs": F.sum("docs").over(by_term)})
    kept = materialize(counts.filter(F.col("lang_docs") >= least_docs).drop("docs", "lang_docs"), "terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("lang_total"))
    every = grouped(documents).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0)
    by_lang = Window.partitionBy("lang")
    groups = every.withColumns({"i": F.row_number().over(by_lang.orderBy("source")).cast("long") - 1, "sources": F.count("*").over(by_lang)})
    groups = materialize(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / block_terms))), "groups")
    shape = ["lang", "i", "total", "vocabulary", "lang_total", "sources", "blocks"]
    listed = groups.select(*shape, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    listed = listed.select(*shape, "block", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    dealt = listed.unionByName(kept.join(groups, ["lang", "source"]).select(*shape, block, "term", "n", "lang_n"))
    # A tile meets every tile, itself included: one row for each.
    own, other = F.floor(F.col("i") / tile), F.col("other")
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / tile)))
    dealt = dealt.withColumn("other", tiles).withColumns({"left": F.least(own, other), "right": F.greatest(own, other)})

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return block_sums(key, rows, tile)

    found = dealt.drop("sources", "blocks", "other").groupBy("lang", "block", "left", "right").applyInArrow(run, ", ".join(f"{c} {t}" for c, t in PARTS.items()))
    found = materialize(found, "sums")
    names = groups.select("lang", "i", "source")
    named = lambda c, label: names.select("lang", F.col("i").alias(c), F.col("source").alias(label))
    # Terms of the language that neither source has were seen in no block of their tiles.
    unseen = (F.max("vocabulary") - F.sum("seen")) * F.max("gap")
    pairs = found.filter("term is null").groupBy("lang", "i", "j").agg((F.sum("value") + unseen).alias("value"))
    pairs = pairs.join(named("i", "a"), ["lang", "i"]).join(named("j", "b"), ["lang", "j"])
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    terms = found.filter("term is not null").join(named("i", "source"), ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return ranked(pairs).unionByName(ranked(terms, TOP)).select("lang", "source", "part", "item", "value", "rank")


def oracle_sql(least_docs: int = LEAST_DOCS) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = lambda n, total: f"1 + (CAST({n} + {SMOOTH} AS HUGEINT) * {SCALE}) // ({total} + {SMOOTH} * vocabulary)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{upper}', '{upper.lower()}') AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {least_docs}
), v AS (
  SELECT lang, count(*) AS vocabulary, sum(lang_n) AS lang_total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term
), t AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "coalesce(total, 0)")} AS p, {share("lang_n", "lang_total")} AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}"""
