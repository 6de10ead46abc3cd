"""How far JSON values match wanted ones, as relations: values taken apart level by level, leaves compared, marks rolled up again.

A pair of values is a node; what it holds are its children: the fields of a wanted object, the places of a wanted array, or, where a plain value meets
an array, every element of that. Going down is narrow (an explode for each level); going up is a group by parent. Only texts that are neither equal nor
parts of one another need Python, and of these each different pair once. functions.fuzzy.value_match says the same for one pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.fuzzy import CONTAINED, on_distinct, ratio
from ..functions.text import stripped
from ..sources.scratch import written

#: Texts that spell a number.
SPELT = r"^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|(?i:inf|infinity))$"
VARIANTS, FIELDS = "array<variant>", "map<string,variant>"


def kind(v: Column) -> Column:
    """number, text, truth, array, object or null; a missing value is null."""
    own = J.kind(v)
    named = F.when(own.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number").when(own == "STRING", "text").when(own == "BOOLEAN", "truth")
    return F.coalesce(named.when(own.isin("ARRAY", "OBJECT"), F.lower(own)), F.lit("null"))


def text_of(v: Column) -> Column:
    """A plain value's text; numbers as they are written shortest."""
    whole = J.kind(v) == "BIGINT"
    return F.when(J.is_number(v) & ~whole, F.try_variant_get(v, "$", "double").cast("string")).otherwise(F.try_variant_get(v, "$", "string"))


def spelt(text: Column) -> Column:
    plain = F.replace(stripped(text), F.lit("_"), F.lit(""))
    return F.when(F.rlike(stripped(text), F.lit(SPELT)), plain.try_cast("double"))


def depth(text: Column) -> Column:
    """How deep a JSON text is nested."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", ""), "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.coalesce(F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"]), F.lit(0))


def leaf(w: Column, g: Column, kw: Column, kg: Column, strict: Column) -> tuple[Column, Column, Column]:
    """(mark, left, right) of two values without children; where the mark is null, it is the ratio of the texts left and right."""
    tw, tg = stripped(F.lower(text_of(w))), stripped(F.lower(text_of(g)))
    either = F.contains(tw, tg) | F.contains(tg, tw)
    near = F.when(tw == tg, 1.0).when(either, CONTAINED)
    nw, ng = (F.when(k == "text", spelt(text_of(v))).otherwise(J.as_number(v)) for v, k in ((w, kw), (g, kg)))
    mixed = ((kw == "text") & (kg == "number")) | ((kw == "number") & (kg == "text"))
    both = nw.isNotNull() & ng.isNotNull()
    equal = (J.as_number(w) == J.as_number(g)).cast("double")
    texts = (kw == "text") & (kg == "text")
    mark = (
        F.when(kg == "null", 0.0).when(texts, near).when(mixed & strict, 0.0).when(mixed & both, (nw == ng).cast("double")).when(mixed, near)
        .when(kw.isin("number", "truth") & kg.isin("number", "truth"), equal).otherwise(0.0)
    )
    return mark, tw, tg


def children(w: Column, g: Column, kw: Column, kg: Column) -> Column:
    """The pairs that two values hold, as an array; null for leaves."""
    wm, gm = (F.try_variant_get(v, "$", FIELDS) for v in (w, g))
    wa, ga = (F.try_variant_get(v, "$", VARIANTS) for v in (w, g))
    pair = lambda a, b: F.struct(a.alias("w"), b.alias("g"))
    fields = F.transform(F.map_entries(wm), lambda e: pair(e["value"], F.try_element_at(gm, e["key"])))
    return (
        F.when((kw == "object") & (kg == "object"), fields)
        .when((kw == "array") & (kg == "array"), F.transform(wa, lambda x, i: pair(x, F.get(ga, i))))
        .when(kw.isin("number", "text") & (kg == "array"), F.transform(ga, lambda x: pair(w, x)))
    )


def pair_marks(pairs: DataFrame) -> DataFrame:
    """mark of each pair (id, want, got: JSON texts, strict). A wanted object or array counts the mean of its parts, 1 without any; among an array's elements the best counts, 0 without any."""
    own = written(pairs.withColumn("depth", depth(F.col("want")) + depth(F.col("got"))), "pairs")
    levels = own.agg(F.max("depth")).first()[0]
    if levels is None:
        return own.select("id", F.lit(0.0).alias("mark"))
    c = F.col
    nodes = own.select("id", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.try_parse_json("want").alias("w"), F.try_parse_json("got").alias("g"), "strict")
    found = []
    for level in range(levels + 1):
        nodes = nodes.withColumns({"kw": kind(c("w")), "kg": kind(c("g"))})
        nodes = nodes.withColumn("parts", children(c("w"), c("g"), c("kw"), c("kg")))
        mark, left, right = leaf(c("w"), c("g"), c("kw"), c("kg"), c("strict"))
        whole = c("parts").isNotNull()
        how = F.when(whole & (c("kw").isin("object", "array")), "mean").when(whole, "best").otherwise("leaf")
        found.append(nodes.select("id", "path", "parent", "level", how.alias("how"), F.when(~whole, mark).alias("mark"), left.alias("left"), right.alias("right")))
        nodes = nodes.filter(whole).select("id", "path", "strict", F.posexplode("parts").alias("at", "x")).select(
            "id", F.concat_ws("/", "path", c("at").cast("string")).alias("path"), c("path").alias("parent"), F.lit(level + 1).alias("level"), c("x.w").alias("w"), c("x.g").alias("g"), "strict"
        )
    every = written(reduce(DataFrame.unionByName, found), "nodes")
    open_ = (c("how") == "leaf") & c("mark").isNull()
    ratios = on_distinct(every.filter(open_).select("id", "path", "left", "right"), ["left", "right"], "ratio", ratio).select(c("id").alias("r_id"), c("path").alias("r_path"), "ratio")
    every = every.join(ratios, (c("id") == c("r_id")) & (c("path") == c("r_path")), "left").withColumn("mark", F.coalesce("mark", "ratio")).drop("r_id", "r_path", "ratio", "left", "right")
    below = None
    for level in range(levels, -1, -1):
        here = every.filter(c("level") == level)
        if below is not None:
            sums = below.groupBy(c("id").alias("b_id"), c("parent").alias("b_path")).agg(F.avg("mark").alias("mean"), F.max("mark").alias("best"))
            rolled = F.when(c("how") == "mean", F.coalesce("mean", F.lit(1.0))).when(c("how") == "best", F.coalesce("best", F.lit(0.0))).otherwise(c("mark"))
            here = here.join(sums, (c("id") == c("b_id")) & (c("path") == c("b_path")), "left").withColumn("mark", rolled).select(*every.columns)
        else:
            here = here.withColumn("mark", F.coalesce("mark", F.when(c("how") == "mean", 1.0).otherwise(0.0)))
        below = here
    return below.select("id", "mark")


def match(rows: DataFrame, want: str, got: str, name: str, strict: Column | None = None) -> DataFrame:
    """Adds how far the JSON text `got` matches `want`; each different pair is looked at once. A text that is null, or no JSON, is a missing value."""
    plain = lambda col: F.when(F.try_parse_json(F.col(col)).isNotNull(), F.col(col))
    marked = rows.withColumns({"_w": plain(want), "_g": plain(got), "_s": F.coalesce(strict if strict is not None else F.lit(False), F.lit(False))})
    marked = marked.withColumn("_id", F.sha2(F.to_json(F.struct("_w", "_g", "_s")), 256))
    pairs = marked.select(F.col("_id").alias("id"), F.col("_w").alias("want"), F.col("_g").alias("got"), F.col("_s").alias("strict")).dropDuplicates(["id"])
    marks = pair_marks(pairs).select(F.col("id").alias("_m"), F.col("mark").alias(name))
    return marked.join(marks, F.col("_id") == F.col("_m"), "left").drop("_w", "_g", "_s", "_id", "_m")
