"""Column expressions for record fields other than the SQL text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import strip

# The label tag put into simulated statements and its keys.
TAG_PATTERN = r"/\* SIM_META:(.*?) \*/"
TAG_KEYS = {"beh_type": ("BEH", "NORMAL"), "is_anomaly": ("ANO", "0"), "sim_ts": ("TS", None),
            "sim_prog": ("PROG", "Unknown"), "sim_os": ("OS", "Unknown"), "sim_conn": ("CONN", "Unknown"),
            "sim_host": ("HOST", "Unknown"), "sim_complexity": ("CMP", "unknown"), "sim_strategy": ("STR", "unknown")}
# Fields that may carry a score, in order.
SCORE_FIELDS = ("score", "severity", "details.score", "details.anomaly_score", "details.probability",
                "details.confidence")


def timer_ms(picoseconds: Column, divisor: float = 1e9) -> Column:
    """Timer value in milliseconds. ``divisor=1e12`` gives the seconds that some publishers send as ms."""
    return picoseconds.cast("double") / F.lit(divisor)


def _starting_with(values: Column, prefix: str) -> Column:
    return F.filter(values, lambda v: v.startswith(prefix))


def read_tag(df: DataFrame, query: str = "query", user: str = "user", host: str = "client_ip") -> DataFrame:
    """Label columns from the statement tag; ``clean_query`` is the statement without it."""
    q = F.col(query)
    body = F.regexp_extract(q, TAG_PATTERN, 1)
    parts = F.split(body, r"\|")
    tagged = F.size(parts) >= 2
    out = {"sim_user": F.when(tagged, parts[0]).otherwise(F.col(user)),
           "sim_ip": F.when(tagged, F.get(parts, 1)).otherwise(F.split_part(F.col(host), F.lit(":"), F.lit(1)))}
    for name, (key, default) in TAG_KEYS.items():
        # The last entry of a key counts, as later entries replace earlier ones.
        hits = _starting_with(F.slice(parts, 3, F.size(parts)), f"{key}:")
        value = F.when(tagged & (F.size(hits) > 0), F.replace(F.element_at(hits, -1), F.lit(f"{key}:"), F.lit("")))
        out[name] = F.coalesce(value, F.lit(default)) if default is not None else value
    out["is_anomaly"] = out["is_anomaly"].try_cast("int")
    out["clean_query"] = F.when(tagged, strip(F.regexp_replace(q, TAG_PATTERN, ""))).otherwise(q)
    return df.withColumns(out)


def rewrite_error_host(message: Column, ip: Column) -> Column:
    """Replace the host of the first ``'user'@'host'`` everywhere that pair occurs."""
    user = F.regexp_extract(message, r"'([^']+)'@'([^']+)'", 1)
    host = F.regexp_extract(message, r"'([^']+)'@'([^']+)'", 2)
    quote, at = F.lit("'"), F.lit("'@'")
    old = F.concat(quote, user, at, host, quote)
    new = F.concat(quote, user, at, ip, quote)
    return F.when(F.coalesce(message, F.lit("")) == "", F.lit("")).when(host == "", message).otherwise(
        F.replace(message, old, new))


def score_value(*candidates: Column) -> Column:
    """First number among the candidates; percentages become fractions."""
    s = F.coalesce(*[F.when(~F.isnan(c.cast("string").try_cast("double")), c.cast("string").try_cast("double"))
                     for c in candidates])
    return F.when((s > 1) & (s <= 100), s / 100).otherwise(s)


def timestamp_format(ts: Column) -> Column:
    return (F.when(~ts.contains("T"), "NON_ISO").when(ts.endswith("Z"), "ISO_WITH_Z")
            .when(F.lower(ts).contains("z"), "ISO_WITH_LOWERCASE_Z").otherwise("ISO_NO_Z"))


def mixed_case(c: Column) -> Column:
    return (c != F.lower(c)) & (c != F.upper(c))


def non_numeric(c: Column) -> Column:
    return F.coalesce(~F.replace(c.cast("string"), F.lit("."), F.lit("")).rlike(r"^\d+$"), F.lit(False))


def access_violations(df: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows whose user has grants, none of which allow this database and command.

    ``grants``: user, database ('*' for all), commands (array; 'ALL' for every command).
    """
    up = F.upper(strip(F.col("query")))
    cmd = (F.when(up.startswith("SELECT"), "SELECT").when(up.startswith("INSERT"), "INSERT")
           .when(up.startswith("UPDATE"), "UPDATE").when(up.startswith("DELETE"), "DELETE").otherwise("UNKNOWN"))
    known = grants.select("user").distinct()
    rows = df.withColumn("_cmd", cmd).join(known, "user", "left_semi")
    g = grants.select(F.col("user").alias("_u"), F.col("database").alias("_d"), "commands")
    allowed = (rows["user"] == g["_u"]) & ((g["_d"] == "*") | ((g["_d"] == rows["database"]) & (
        F.array_contains("commands", "ALL") | F.array_contains("commands", "ALL PRIVILEGES")
        | F.array_contains(F.col("commands"), F.col("_cmd")))))
    return rows.join(g, allowed, "left_anti").withColumnRenamed("_cmd", "command")
