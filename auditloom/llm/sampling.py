"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is its words weighted by how often they occur. For sample k every word draws two Gamma(2, 1) values r, c and a
uniform value b from a hash of the word and k, quantises the logarithm of its weight S to t = floor(ln S / r + b) and gets
ln a = ln c - r (t - b + 1). The word with the least value is the sample; as that value depends on the word and t alone,
two documents have the same least value with the probability of their generalised Jaccard similarity (sum of the smaller
weights over the sum of the larger ones). A fingerprint is four hexadecimal digits of a hash of each least value.

Plan: the words of a text are sorted inside its row, runs of equal words become terms with counts, and the least values
are aggregated per document, which combines fully before the shuffle. The ring of documents is cut into ranges of the
id; only the last row of a range looks at the head of the next. The edited text needs one shuffle of texts and one of
the heads that the next document gives.

Defined results: a null text is empty; an empty text has an empty fingerprint, which is like another empty one (1.0) and
unlike all others (0.0). Documents are the distinct (doc_id, text); repeated rows get equal results, one per row. Equal
ids are ordered by a hash of the text, a null id comes last. A single document is its own next one. Other columns are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.cut import written

SAMPLES = 32
KEY = ("_k", "_h")


def uniform(h: Column, low: int, bits: int) -> Column:
    """A value in (0, 1) from ``bits`` bits of a hash."""
    part = F.shiftrightunsigned(h, low) if low else h
    return (part.bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * (0.5**bits)


def least_value(term: Column, log_weight: Column, k: int) -> Column:
    """Logarithm of the value of a term in sample ``k``; ``term`` is a 64-bit hash."""
    h = F.xxhash64(term, F.lit(k))
    g = F.xxhash64(h, F.lit(~k))
    r = -F.ln(uniform(h, 0, 32) * uniform(h, 32, 32))
    log_c = F.ln(-F.ln(uniform(g, 0, 26) * uniform(g, 26, 26)))
    b = uniform(g, 52, 12)
    return log_c - r * (F.floor(log_weight / r + b).cast("double") - b + 1.0)


def terms(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, 64-bit hash of each distinct word, logarithm of its count; one row of nulls for a text without words."""
    run = F.expr(f"regexp_extract_all(array_join(sort_array(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+')), ' '), '([^ ]+)(?: \\\\1(?= |$))*+', 0)")
    word = F.substring_index("_run", " ", 1)
    return df.select(*keys, F.explode_outer(run).alias("_run")).select(
        *keys, F.when(F.col("_run").isNotNull(), F.xxhash64(word)).alias("_term"),
        F.ln(F.round((F.octet_length("_run") + 1) / (F.octet_length(word) + 1))).alias("_weight"))


def fingerprints(df: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys and fingerprint of every text."""
    least = terms(df, keys, text).groupBy(*keys).agg(
        *[F.min(F.when(F.col("_term").isNotNull(), least_value(F.col("_term"), F.col("_weight"), k))).alias(f"_m{k}") for k in range(samples)])
    digits = [F.lpad(F.lower(F.hex(F.xxhash64(f"_m{k}").bitwiseAND(F.lit(0xFFFF)))), 4, "0") for k in range(samples)]
    return least.select(*keys, F.when(F.col("_m0").isNull(), F.lit("")).otherwise(F.concat(*digits)).alias("fingerprint"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = sum((F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(same / F.lit(float(samples)))


def ring(documents: DataFrame, parts: int) -> DataFrame:
    """``documents`` (doc_id, _k, _h, ...) with the key of the next one by descending id, ``_nk`` and ``_nh``.

    No window holds all rows: each range of ids is ordered for itself, and one head row per range closes the gaps.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h"), F.col("_k")]
    cut = written(documents.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(*order)
    ordered = cut.withColumn("_nk", F.lead("_k").over(own)).withColumn("_nh", F.lead("_h").over(own)).withColumn("_at", F.row_number().over(own))
    heads = ordered.where("_at = 1").select("_part", F.struct(*KEY).alias("_head"))
    every = Window.orderBy("_part")
    # One row per range: the single partition of this window is bounded by the number of ranges.
    after = heads.select("_part", F.coalesce(F.lead("_head").over(every), F.first("_head").over(every.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    return ordered.join(after, "_part").withColumn("_nk", F.coalesce("_nk", "_after._k")).withColumn("_nh", F.coalesce("_nh", "_after._h")) \
        .drop("_part", "_at", "_after")


def compared(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text whose last third of code points gives way to the head of the next document.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text")) \
        .withColumn("_k", F.xxhash64("doc_id", "_h", F.lit(1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = rows.select("doc_id", *KEY, F.char_length("text").cast("long").alias("n_chars")) \
        .groupBy("doc_id", *KEY, "n_chars").agg(F.count("*").alias("_rows"))
    edges = written(ring(slim, parts).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int")))
    own = written(fingerprints(rows, list(KEY), "text", samples))
    text = rows.select(*KEY, "text").dropDuplicates(list(KEY))
    wants = edges.select(F.col("_k").alias("_dk"), F.col("_h").alias("_dh"), F.col("_nk").alias("_k"), F.col("_nh").alias("_h"), "_cut")
    heads = wants.join(text, list(KEY)).select(F.col("_dk").alias("_k"), F.col("_dh").alias("_h"), "_cut", F.left("text", F.col("_cut")).alias("_head"))
    edited = text.join(heads, list(KEY)).select(*KEY, F.concat(F.left("text", (F.char_length("text") - F.col("_cut")).cast("int")), F.col("_head")).alias("_edited"))
    edited = edited.withColumn("edited_sha256", F.sha2("_edited", 256))
    changed = fingerprints(edited, [*KEY, "edited_sha256"], "_edited", samples).withColumnRenamed("fingerprint", "edited_fingerprint")
    following = own.select(F.col("_k").alias("_nk"), F.col("_h").alias("_nh"), F.col("fingerprint").alias("_next"))
    joined = edges.join(own, list(KEY)).join(changed, list(KEY)).join(following, ["_nk", "_nh"])
    return joined.withColumn("_row", F.explode_outer(F.sequence(F.lit(1), F.col("_rows").cast("int")))).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), likeness("fingerprint", "_next", samples).alias("near_next"))
