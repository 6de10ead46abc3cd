"""Queries over texts and JSON with their SQL: constraints, file checks, clean-ups, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import files as D
from ..functions import fuzzy as Z
from ..functions import jsonx as J
from ..functions import text as X
from ..operators import matching
from . import fixtures as P
from .registry import entry, rounded

AN = f"WITH {P.ANSWERS_SQL}"
#: RE2 has the same syntax for all of these; in it white space is ASCII, as it is in these texts.
BULLET = r"(?m)^\s*(?:[-*+•·‣▪◦⁃]|\d+\.)\s+\S"
HEADING = r"(?m)^\s{0,3}#{1,6}\s+\S"
TABLE_RULE = r"(?m)^\s*\|?[\s:|-]*-{2,}[\s:|-]*\|?\s*$"
PUNCT = r"^[*_`~#>|\-–—•·.,:;!?()\[\]{}\"'']+$"


def count_sql(pattern: str, column: str = "answer") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


WORDS = f"len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '{PUNCT}')))"
CHECKS: dict[str, tuple[C.Check, str]] = {
    "contains_any": ({"type": "contains", "any": ["the", "der "]}, "contains(lower(answer), 'the') OR contains(lower(answer), 'der ')"),
    "contains_all": ({"type": "contains", "all": ["e", "a", "i"]}, "contains(lower(answer), 'e') AND contains(lower(answer), 'a') AND contains(lower(answer), 'i')"),
    "contains_none": ({"type": "contains"}, "false"),
    "not_contains": ({"type": "not_contains", "value": "tion"}, "NOT contains(lower(answer), 'tion')"),
    "not_contains_none": ({"type": "not_contains"}, "true"),
    "regex": ({"type": "regex", "value": r"^- The \w+"}, r"regexp_matches(answer, '(?im)^- The \w+')"),
    "not_regex": ({"type": "not_regex", "value": r"!!"}, "NOT contains(answer, '!!')"),
    "min_words": ({"type": "min_words", "value": 200}, f"{WORDS} >= 200"),
    "max_words": ({"type": "max_words", "value": 300}, f"{WORDS} <= 300"),
    "min_chars": ({"type": "min_chars", "value": 1000}, "length(trim(answer)) >= 1000"),
    "max_chars": ({"type": "max_chars", "value": 2000}, "length(trim(answer)) <= 2000"),
    "min_sentences": ({"type": "min_sentences", "value": 20}, f"{count_sql(r'[.!?]+(?:\s|$)')} >= 20"),
    "max_sentences": ({"type": "max_sentences", "value": 30}, f"{count_sql(r'[.!?]+(?:\s|$)')} <= 30"),
    "min_bullets": ({"type": "min_bullets", "value": 10}, f"{count_sql(BULLET)} >= 10"),
    "exact_bullets": ({"type": "exact_bullets", "value": 12}, f"{count_sql(BULLET)} = 12"),
    "max_bullets": ({"type": "max_bullets", "value": 15}, f"{count_sql(BULLET)} <= 15"),
    "min_headings": ({"type": "min_headings", "value": 1}, f"{count_sql(HEADING)} >= 1"),
    "exact_headings": ({"type": "exact_headings", "value": 1}, f"{count_sql(HEADING)} = 1"),
    "has_table": ({"type": "has_table"}, f"contains(answer, '|') AND regexp_matches(answer, '{TABLE_RULE}')"),
    "has_code_fence": ({"type": "has_code_fence"}, f"{count_sql('```')} >= 2"),
    "starts_with": ({"type": "starts_with", "value": "# EN"}, "starts_with(lower(trim(answer)), '# en')"),
    "ends_with": ({"type": "ends_with", "value": "7"}, "ends_with(lower(trim(answer)), '7')"),
    "ends_with_number": ({"type": "ends_with_number"}, r"""regexp_matches(regexp_replace(answer, '[\s*_`~.,:;!?)\]}"''$]+$', ''), '-?\d[\d,]*(?:\.\d+)?$')"""),
    "lowercase": ({"type": "lowercase"}, "answer = lower(answer)"),
    "uppercase": ({"type": "uppercase"}, "answer = upper(answer)"),
    "unknown": ({"type": "no_such_check"}, "false"),
}


@entry(AN + " SELECT doc_id, " + ", ".join(f"({sql}) AS c_{name}" for name, (_, sql) in CHECKS.items()) + " FROM answers")
def c_text_constraints(spark, sf_dir):
    a = P.answers(spark, sf_dir)
    return a.select("doc_id", *[C.passes(check, F.col("answer")).alias(f"c_{name}") for name, (check, _) in CHECKS.items()])


SHARE = ["min_words", "max_sentences", "min_bullets", "ends_with_number", "not_contains"]


@entry(f"{AN} SELECT doc_id, round(CAST({' + '.join(f'CAST(({CHECKS[n][1]}) AS INT)' for n in SHARE)} AS DOUBLE) / {len(SHARE)}, 6) AS fraction FROM answers")
def c_fraction(spark, sf_dir):
    a = P.answers(spark, sf_dir)
    return rounded(a.select("doc_id", C.fraction([CHECKS[n][0] for n in SHARE], F.col("answer")).alias("fraction")))


def props(spark, sf_dir):
    """Constructed objects around the events' props."""
    e = P.table(spark, sf_dir, "events")
    text = F.concat(
        F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit(', "tags": ["'),
        F.col("event_type"), F.lit('", "t'), (F.col("event_id") % 4).cast("string"), F.lit('"], "ok": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(', "none": null}'),
    )
    broken = F.when(F.col("event_id") % 13 == 0, F.lit("not json")).when(F.col("event_id") % 7 == 0, F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```\nDone."))).otherwise(text)
    return e.select("event_id", "event_type", broken.alias("answer"))


PROPS_SQL = """q AS (SELECT event_id, event_type, event_id % 13 <> 0 AS good, '{"id": ' || CAST(event_id AS VARCHAR) || ', "kind": "' || event_type || '", "props": ' || props || ', "tags": ["' || event_type || '", "t'
  || CAST(event_id % 4 AS VARCHAR) || '"], "ok": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "none": null}' AS j FROM events)"""
K = "CAST(json_extract_string(j, '$.props.k') AS BIGINT)"
JSON: dict[str, tuple[C.Check, str]] = {
    "valid_json": ({"type": "valid_json"}, "true"),
    "has_keys": ({"type": "json_has_keys", "keys": ["id", "props.k", "tags.1", "none"]}, "true"),
    "lacks_key": ({"type": "json_has_keys", "keys": ["id", "tags.2"]}, "false"),
    "type_string": ({"type": "json_path_type", "path": "kind", "value": "string"}, "true"),
    "type_number": ({"type": "json_path_type", "path": "ok", "value": "number"}, "true"),
    "type_integer": ({"type": "json_path_type", "path": "ok", "value": "integer"}, "false"),
    "type_array": ({"type": "json_path_type", "path": "tags", "value": "array"}, "true"),
    "type_object": ({"type": "json_path_type", "path": "", "value": "object"}, "true"),
    "value_bool_as_int": ({"type": "json_value", "path": "ok", "value": 1}, "event_id % 2 = 0"),
    "value_string": ({"type": "json_value", "path": "kind", "value": "click"}, "event_type = 'click'"),
    "value_number": ({"type": "json_value", "path": "props.k", "value": 30}, f"{K} = 30"),
    "array_min": ({"type": "json_array_min", "path": "tags", "value": 2}, "true"),
    "array_len": ({"type": "json_array_len", "path": "tags", "value": 3}, "false"),
    "enum": ({"type": "json_enum", "path": "kind", "values": ["view", "signup"]}, "event_type IN ('view', 'signup')"),
    "exact_keys": ({"type": "json_exact_keys", "keys": ["tags", "id", "kind", "props", "ok", "none"]}, "true"),
    "path_exact_keys": ({"type": "json_path_exact_keys", "path": "props", "keys": ["k"]}, "true"),
    "path_not_contains": ({"type": "json_path_not_contains", "path": "kind", "value": "c"}, "NOT contains(event_type, 'c')"),
    "all_values_in": ({"type": "json_all_values_in", "path": "tags", "values": ["click", "view", "t0", "t1"]}, "event_type IN ('click', 'view') AND event_id % 4 < 2"),
}


@entry(f"WITH {PROPS_SQL} SELECT event_id, " + ", ".join(f"good AND ({sql}) AS j_{name}" for name, (_, sql) in JSON.items()) + " FROM q")
def c_json_constraints(spark, sf_dir):
    a = props(spark, sf_dir).withColumn("v", J.parse(F.col("answer")))
    return a.select("event_id", *[C.passes(check, F.col("answer"), F.col("v")).alias(f"j_{name}") for name, (check, _) in JSON.items()])


@entry(f"WITH {PROPS_SQL} SELECT event_id, CASE WHEN good THEN {K} END AS k, CASE WHEN good THEN 't' || CAST(event_id % 4 AS VARCHAR) END AS tag FROM q")
def x11_json_lookup(spark, sf_dir):
    v = props(spark, sf_dir).withColumn("v", J.parse(F.col("answer")))
    at = lambda p, t: F.try_variant_get(J.lookup(F.col("v"), p), "$", t)
    return v.select("event_id", at("props.k", "bigint").alias("k"), at("tags.1", "string").alias("tag"))


@entry(f"{AN} SELECT doc_id, CAST({count_sql(BULLET)} AS INT) AS bullets, CAST({count_sql(HEADING)} AS INT) AS headings, CAST({count_sql(r'[.!?]+(?:\s|$)')} AS INT) AS sentences, CAST({WORDS} AS INT) AS words FROM answers")
def x14_markdown_counts(spark, sf_dir):
    a = F.col("answer")
    return P.answers(spark, sf_dir).select("doc_id", X.bullets(a).alias("bullets"), X.headings(a).alias("headings"), X.sentences(a).alias("sentences"), F.size(X.prose_words(a)).alias("words"))


GRAMS = "list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))"


def repetition_sql(w: str) -> str:
    g = f"list_transform(range(1, len({w}) - 6), lambda i: array_to_string(list_slice({w}, i, i + 7), ' '))"
    return f"CASE WHEN len({w}) < 16 THEN 0 ELSE 1 - CAST(len(list_distinct({g})) AS DOUBLE) / len({g}) END"


SPLIT = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"


@entry(f"""{AN}, s AS (SELECT doc_id, {SPLIT.format("text")} AS w, {SPLIT.format("substr(text, CAST(floor(length(text) * CAST(0.75 AS DOUBLE)) AS BIGINT) + 1)")} AS v FROM answers)
SELECT doc_id, round({repetition_sql("w")}, 6) AS repetition, round(greatest({repetition_sql("w")}, {repetition_sql("v")}), 6) AS loop_ratio FROM s""")
def x3_loop_ratio(spark, sf_dir):
    t = F.col("text")
    return rounded(P.answers(spark, sf_dir).select("doc_id", X.repetition(t).alias("repetition"), X.loop_ratio(t).alias("loop_ratio")))


@entry(rf"""{AN} SELECT doc_id, CAST(replace(list_extract(regexp_extract_all(answer, '-?\d[\d,]*(?:\.\d+)?'), -1), ',', '') AS DOUBLE) AS number,
abs(CAST(replace(list_extract(regexp_extract_all(answer, '-?\d[\d,]*(?:\.\d+)?'), -1), ',', '') AS DOUBLE) - 1500) <= 15 AS close FROM answers""")
def r2_numeric(spark, sf_dir):
    n = X.last_number(F.col("answer"))
    return P.answers(spark, sf_dir).select("doc_id", n.alias("number"), (F.abs(n - 1500) <= F.greatest(F.lit(0.01 * 1500), F.lit(0.01))).alias("close"))


@entry(f"{AN} SELECT doc_id, CAST(floor(length(answer) / CAST(4.7 AS DOUBLE)) AS BIGINT) AS tokens, CAST(('0x' || substr(sha256('s' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000000 AS salt, substr(sha256(answer), 1, 16) AS hash FROM answers")
def x17_hashes(spark, sf_dir):
    a = P.answers(spark, sf_dir)
    return a.select("doc_id", X.estimate_tokens(F.col("answer")).alias("tokens"), X.salt_offset(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("salt"), X.short_hash(F.col("answer")).alias("hash"))


def thought(text: Column, no: Column) -> Column:
    return (
        F.when(no % 4 == 0, F.concat(F.lit("<think>plan\nit</think> "), text)).when(no % 4 == 1, F.concat(F.lit("was thinking</THINK>"), text))
        .when(no % 4 == 2, F.concat(text, F.lit(" <think>and then"))).otherwise(text)
    )


@entry(r"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>plan' || chr(10) || 'it</think> ' || text WHEN 1 THEN 'was thinking</THINK>' || text WHEN 2 THEN text || ' <think>and then' ELSE text END AS x FROM conversations)
SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?is)<think>.*?</think>', '', 'g'), '(?is)^.*?</think>', ''), '(?is)<think>.*$', ''), '^\s+|\s+$', '', 'g')) AS answer FROM t""")
def x1_strip_reasoning(spark, sf_dir):
    c = P.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.sha2(X.strip_reasoning(thought(F.col("text"), F.col("turn"))), 256).alias("answer"))


@entry(f"{AN} SELECT doc_id, " + " OR ".join(f"contains(regexp_replace(lower(text), '[*_`]', '', 'g'), '{s.replace(chr(39), chr(39) * 2)}')" for s in X.UNCERTAIN) + " AS uncertain FROM answers")
def r4_calibration(spark, sf_dir):
    return P.answers(spark, sf_dir).select("doc_id", X.is_uncertain(F.col("text")).alias("uncertain"))


@entry(r"""WITH t AS (SELECT page_id, url || '  ' || chr(13) || chr(10) || '  ' || url || chr(9) || chr(10) || chr(10) AS x FROM pages)
SELECT page_id, sha256(regexp_replace(regexp_replace(replace(x, chr(13) || chr(10), chr(10)), '(?m)[ \t]+$', '', 'g'), '\n+$', '') || chr(10)) AS file, regexp_replace(x, '[^a-zA-Z0-9._-]+', '_', 'g') AS slug, regexp_replace(x, '[^a-zA-Z0-9._-]', '_', 'g') AS slug_each FROM t""")
def x18_normal_files(spark, sf_dir):
    p = P.table(spark, sf_dir, "pages")
    x = F.concat("url", F.lit("  \r\n  "), "url", F.lit("\t\n\n"))
    return p.select("page_id", F.sha2(X.normalize_file(x), 256).alias("file"), X.slug(x).alias("slug"), X.slug_each(x).alias("slug_each"))


@entry("""WITH e AS (SELECT event_id, event_type, CAST(event_id % 9 AS INT) AS made, CAST(event_id % 4 AS INT) AS optimal, event_id % 2 = 0 AS cut, value FROM events)
SELECT event_id, made = 0 OR optimal <= 0 OR made <= greatest(2 * optimal, optimal + 3) AS within, CASE WHEN NOT cut THEN '' WHEN value > 50 OR made >= 3 THEN 'degenerate' ELSE 'incomplete' END AS truncation,
CASE event_id % 3 WHEN 0 THEN 'anchor' WHEN 1 THEN 'hard' ELSE 'mid' END AS band, greatest(CAST(180 AS DOUBLE), value * 100 / 20.8 + 30) AS timeout FROM e""")
def x22_small_rules(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    made, best = (F.col("event_id") % 9).cast("int"), (F.col("event_id") % 4).cast("int")
    level = F.when(F.col("event_id") % 3 == 0, "easy").when(F.col("event_id") % 3 == 1, "hard").otherwise("medium")
    return e.select(
        "event_id", X.within_budget(made, best).alias("within"), X.truncation_class(F.col("event_id") % 2 == 0, F.col("value") / 100, F.lit(0.0), made).alias("truncation"),
        X.infer_band(F.lit(None).cast("string"), level).alias("band"), X.read_timeout(F.lit(180.0), F.col("value") * 100, F.lit(20.8), F.lit(30)).alias("timeout"),
    )


@entry(r"""WITH w AS (SELECT conv_id, turn, text, CAST(len(regexp_extract_all(replace(text, '. ', '.' || chr(10) || '- '), '(?m)^\s*(?:[-*+•·‣▪◦⁃]|\d+\.)\s+\S')) AS INT) AS b FROM conversations)
SELECT conv_id, turn, b AS bullets, coalesce(b >= lag(b) OVER (PARTITION BY conv_id ORDER BY turn), true) AS kept FROM w""")
def c34_bullets_kept(spark, sf_dir):
    from pyspark.sql import Window

    c = P.table(spark, sf_dir, "conversations").withColumn("x", F.replace("text", F.lit(". "), F.lit(".\n- ")))
    before = F.lag("x").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("before", before).select("conv_id", "turn", X.bullets(F.col("x")).alias("bullets"), C.cross_turn_bullets(F.col("x"), F.col("before")).alias("kept"))


HTML = r"regexp_replace(html, '<h[1-6][^>]*>', chr(10) || '# ', 'g')"


@entry(rf"""WITH h AS (SELECT page_id, regexp_replace({HTML}, '<[^>]*>', chr(10), 'g') AS t FROM pages)
SELECT page_id, CAST({count_sql(HEADING, "t")} AS INT) AS headings, contains(lower(t), 'the') AS has_the, true AS kept FROM h""")
def d_html_files(spark, sf_dir):
    t = F.regexp_replace(F.regexp_replace("html", "<h[1-6][^>]*>", "\n# "), "<[^>]*>", "\n")
    p = P.table(spark, sf_dir, "pages").select("page_id", t.alias("t"))
    return p.select(
        "page_id", X.headings(F.col("t")).alias("headings"), D.section_contains(F.col("t"), {"value": "the"}).alias("has_the"),
        D.passes({"type": "lines_preserved"}, F.concat(F.col("t"), F.lit("\nmore")), F.col("t")).alias("kept"),
    )


@entry(r"""WITH t AS (SELECT doc_id, lang, n_chars, 'title: ' || lang || chr(10) || '## Data' || chr(10) || '| k | v |' || chr(10) || '|---|---|' || chr(10) || '| a | ' || CAST(n_chars AS VARCHAR) || ' |' || CASE WHEN doc_id % 3 = 0 THEN ' x |' ELSE '' END || chr(10) || '| b | 2 |' || chr(10) || '## End' AS x FROM documents)
SELECT doc_id, lang = 'en' AS front, doc_id % 3 <> 0 AS wellformed, true AS rows_kept, CAST(n_chars AS VARCHAR) LIKE '%7%' AS position FROM t""")
def d_table_files(spark, sf_dir):
    d = P.table(spark, sf_dir, "documents")
    n = F.col("n_chars").cast("string")
    extra = F.when(F.col("doc_id") % 3 == 0, " x |").otherwise("")
    x = F.concat(F.lit("title: "), "lang", F.lit("\n## Data\n| k | v |\n|---|---|\n| a | "), n, F.lit(" |"), extra, F.lit("\n| b | 2 |\n## End"))
    x = d.select("doc_id", x.alias("x"))
    c = lambda **k: D.passes({"section": "## Data", **k}, F.col("x"), F.col("x"))
    return x.select(
        "doc_id", c(type="frontmatter", key="title", value="en").alias("front"), c(type="table_wellformed").alias("wellformed"),
        c(type="table_rows_preserved").alias("rows_kept"), c(type="table_row_position", contains="7", index=0).alias("position"),
    )


def lcs_sql(pairs: str) -> str:
    """CTEs that end in lcs(id, n): the longest common subsequence of each pair (id, a, b), a row of the table at a time."""
    return f"""pr AS ({pairs}), gr AS (
  SELECT id, 0 AS i, unnest(range(0, len(b) + 1)) AS j, 0 AS v FROM pr
  UNION ALL
  SELECT id, i + 1, j, CAST(max(t) OVER (PARTITION BY id ORDER BY j) AS INT) FROM (
    SELECT gr.id, gr.i, gr.j, CASE WHEN gr.j > 0 AND pr.a[gr.i + 1] = pr.b[gr.j] THEN lag(gr.v) OVER (PARTITION BY gr.id ORDER BY gr.j) + 1 ELSE gr.v END AS t FROM gr JOIN pr USING (id) WHERE gr.i < len(pr.a)
  )
), lcs AS (SELECT pr.id, max(CASE WHEN gr.i = len(pr.a) THEN v END) AS n FROM gr JOIN pr USING (id) GROUP BY pr.id)"""


PAIRED = "SELECT x.item_id AS id, x.text AS a, y.text AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1"


@entry(f"WITH RECURSIVE {lcs_sql(PAIRED)} SELECT id AS item_id, round(2 * CAST(n AS DOUBLE) / (len(a) + len(b)), 6) AS ratio FROM lcs JOIN pr USING (id)")
def x6_indel_ratio(spark, sf_dir):
    """Benchmark items against each other's neighbours, on distinct pairs."""
    b = P.table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return rounded(Z.on_distinct(b.join(nxt, "item_id"), ["text", "next"], "ratio", Z.ratio).select("item_id", "ratio"))


@entry("""WITH r AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: len(w) >= 200)) AS run FROM documents),
c AS (SELECT doc_id, run[1:4096] AS s, unnest(range(1, least(64, len(run[1:4096]) // 2) + 1)) AS p FROM r),
m AS (SELECT doc_id, max(CAST(list_sum(list_transform(range(1, len(s) - p + 1), lambda i: CASE WHEN s[i] = s[i + p] THEN 1 ELSE 0 END)) AS DOUBLE) / (len(s) - p)) AS v FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(v, 0), 6) AS char_loop FROM documents LEFT JOIN m USING (doc_id)""")
def x4_char_loop(spark, sf_dir):
    return rounded(P.table(spark, sf_dir, "documents").select("doc_id", Z.char_loop_ratio(F.col("text")).alias("char_loop")))


KINDS = "SELECT event_type AS id, event_type AS a, 'signup page' AS b FROM events GROUP BY event_type"


@entry(f"""WITH RECURSIVE {lcs_sql(KINDS)}, kd AS (SELECT id, CASE WHEN contains(b, a) THEN 0.8 ELSE 2 * CAST(n AS DOUBLE) / (len(a) + len(b)) END AS kind FROM lcs JOIN pr USING (id))
SELECT event_id, round(CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 0 ELSE (CAST(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) = 30 AS INT) + kind) / 2 END, 6) AS match FROM events JOIN kd ON id = event_type""")
def x8_value_match(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    want = F.concat(F.lit('{"k": 30, "kind": "'), "event_type", F.lit('"}'))
    got = F.concat(F.lit('{"k": "'), F.get_json_object("props", "$.k"), F.lit('", "kind": "signup page", "more": [1]}'))
    pairs = e.select("event_id", want.alias("want"), got.alias("got"))
    return rounded(matching.match(pairs, "want", "got", "match").select("event_id", "match"))
