"""Texts against any number of patterns that are rows of a table.

An inverted index leads from texts to the patterns that may match: every pattern has a word that any match must contain, and
the word's rarest run of three letters among all patterns is its entry. Texts, once each however often they occur, look their
own runs of three letters up; only the pairs found are verified, each with its row's own expression. Patterns without such a
word are one small list that each text walks through. Nothing of the table comes to the driver, and the plan does not grow
with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.joins import measured
from auditloom.functions.once import explode_kept

GRAM = 3


def grams(text: Column) -> Column:
    """Distinct runs of three code points."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1)))


def required_word(regex: Column) -> Column:
    """The longest lower-case word that any match must contain; null for patterns with groups, choices or classes."""
    body = F.regexp_replace(regex, r"^\(\?i\)", "")
    body = F.regexp_replace(body, r"\\[()*.\\$]", " ")                     # escaped signs are literals but not words
    body = F.regexp_replace(body, r"\\[swdb][+*]?(\{\d+,?\d*\})?", " ")
    body = F.replace(body, F.lit(".*"), F.lit(" "))
    words = F.regexp_extract_all(F.lower(body), F.lit("[a-z_]{3,}"), F.lit(0))
    longest = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.when(~body.rlike(r"[|()\[\]?*+{}\\]") & (longest != ""), longest)


def indexed(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns (with ``_word``, lower case) that have an entry, ``_gram``, and the others."""
    keyed = patterns.withColumn("_key", F.xxhash64(*patterns.columns)).withColumn("_grams", grams(F.col("_word")))
    each = keyed.where(F.size("_grams") > 0).select("_key", F.explode("_grams").alias("_gram")).distinct()
    entry = each.join(each.groupBy("_gram").agg(F.count("*").alias("_n")), "_gram").groupBy("_key").agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    return keyed.join(entry, "_key").drop("_key", "_grams"), patterns.where(F.coalesce(F.char_length("_word"), F.lit(0)) < GRAM)


def hits(texts: DataFrame, patterns: DataFrame, text: str, verify) -> DataFrame:
    """The columns of distinct ``texts`` and ``patterns`` for every pair that ``verify`` (a condition on the text, its lower
    form and the pattern's columns) accepts. ``patterns`` has ``_word``, the word to look for, or null."""
    names = [c for c in patterns.columns if c != "_word"]
    found, rest = indexed(patterns)
    low = texts.withColumn("_low", F.lower(text))
    pairs = explode_kept(low, "_gram", grams(F.col("_low"))).join(measured(found), "_gram").drop("_gram")
    sure = pairs.where(F.contains("_low", "_word") & verify(F.col(text), F.col("_low"), {n: F.col(n) for n in [*names, "_word"]}))
    # Patterns without an entry: one list for all texts, a single value of the plan.
    listed = rest.agg(F.collect_list(F.struct(*names, "_word"))).scalar()
    own = F.filter("_list", lambda p: F.coalesce(verify(F.col(text), F.col("_low"), {n: p[n] for n in [*names, "_word"]}), F.lit(False)))
    loose = explode_kept(low.withColumn("_list", listed), "_p", own).select(*texts.columns, *[F.col("_p")[n].alias(n) for n in names])
    return sure.select(*texts.columns, *names).unionByName(loose)


def keyword_search(df: DataFrame, patterns: DataFrame, q: str = "query") -> DataFrame:
    """Rows with ``pattern_ids``, the patterns (pattern_id, keyword, regex) that the text matches, for texts that match any.

    A text matches that contains the keyword, in any case, and the regex, if there is one. Patterns without a keyword match
    nothing.
    """
    table = patterns.where("keyword is not null AND keyword <> ''").select(
        "pattern_id", F.coalesce("regex", F.lit("")).alias("_regex"), F.lower("keyword").alias("_word"))
    texts = df.select(F.col(q).alias("_text")).where("_text is not null").distinct()

    def verify(text: Column, low: Column, p: dict[str, Column]) -> Column:
        return F.contains(low, p["_word"]) & ((p["_regex"] == "") | F.rlike(text, F.concat(F.lit("(?i)"), p["_regex"])))
    ids = hits(texts, table, "_text", verify).groupBy("_text").agg(F.array_sort(F.collect_set("pattern_id")).alias("pattern_ids"))
    ids = measured(ids)
    return df.join(ids, df[q] == ids["_text"]).drop("_text")


def library_table(spark: SparkSession, library: Sequence) -> DataFrame:
    """Attack patterns as rows (pattern_id, attack_type, weight, regex), one per expression."""
    rows = [(p.pattern_id, p.attack_type, float(p.weight), r) for p in library for r in p.regexes]
    return spark.createDataFrame(rows, "pattern_id string, attack_type string, weight double, regex string")


def merged_library(base: DataFrame, updates: DataFrame) -> DataFrame:
    """The library with the updates' patterns; a pattern id that it already has is replaced as a whole."""
    cols = ["pattern_id", "attack_type", "weight", "regex"]
    return base.select(*cols).join(updates.select("pattern_id").distinct(), "pattern_id", "left_anti").select(*cols).unionByName(updates.select(*cols))


def attack_matches(contents: DataFrame, patterns: DataFrame, content: str = "content") -> DataFrame:
    """``contents`` with pattern_id, attack_type, weight and every distinct piece that a pattern of the table matches."""
    table = patterns.where("regex is not null").select("pattern_id", "attack_type", "weight", "regex", required_word(F.col("regex")).alias("_word")).distinct()
    texts = contents.select(F.col(content).alias("_text")).where("_text is not null").distinct()
    found = hits(texts, table, "_text", lambda text, low, p: F.rlike(text, p["regex"]))
    pieces = explode_kept(found, "matched", F.array_distinct(F.regexp_extract_all("_text", F.col("regex"), F.lit(0)))).select(
        "_text", "pattern_id", "attack_type", "weight", "matched").distinct()
    pieces = measured(pieces)
    return contents.join(pieces, contents[content] == pieces["_text"]).drop("_text")
