"""Column expressions over SQL text. All stay on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names the detectors treat as system or sensitive.
SYSTEM_SCHEMAS = ("information_schema", "performance_schema", "mysql", "sys")
SENSITIVE_TABLES = ("hr_db.salaries", "hr_db.employees", "hr_db.salary", "mysql.user",
                    "information_schema.user_privileges", "performance_schema.accounts",
                    "salaries", "employees", "users")
RISKY_COMMANDS = ("DELETE", "DROP", "TRUNCATE", "UPDATE", "INSERT", "GRANT", "REVOKE", "CREATE USER", "ALTER USER")
ADMIN_COMMANDS = ("GRANT", "REVOKE", "CREATE USER", "ALTER USER", "SET PASSWORD")
DCL_COMMANDS = ("GRANT", "REVOKE", "CREATE USER")
DDL_COMMANDS = ("CREATE", "DROP", "ALTER", "TRUNCATE")
SQL_VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE", "CREATE", "DROP", "ALTER", "TRUNCATE", "GRANT",
             "REVOKE", "SET", "SHOW", "DESC", "DESCRIBE", "EXPLAIN", "USE", "CALL", "RENAME", "LOAD", "WITH", "BEGIN",
             "START", "COMMIT", "ROLLBACK", "LOCK", "UNLOCK", "FLUSH", "KILL", "ANALYZE", "OPTIMIZE")

# Text patterns for database and table names.
_Q = "[`'\"]?"
_NAME = "[a-zA-Z0-9_]+"
_QUALIFIED = rf"{_Q}({_NAME}){_Q}\s*\.\s*{_Q}{_NAME}{_Q}"
DATABASE_PATTERNS = (
    rf"(?:FROM|JOIN|UPDATE|INTO|TABLE|REPLACE\s+INTO)\s+{_QUALIFIED}",
    rf"USE\s+{_Q}({_NAME}){_Q}(?:\s|;|$)",
    rf"(?:CREATE|DROP|ALTER)\s+(?:DATABASE|SCHEMA)\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?{_Q}({_NAME}){_Q}",
    rf"SHOW\s+(?:TABLES|COLUMNS|INDEX)\s+(?:FROM|IN)\s+{_Q}({_NAME}){_Q}",
    rf"INSERT\s+(?:IGNORE\s+)?INTO\s+{_QUALIFIED}",
    rf"DELETE\s+FROM\s+{_QUALIFIED}",
    rf"CALL\s+{_QUALIFIED}",
    rf"(?:DESCRIBE|DESC)\s+{_QUALIFIED}",
)
READ_TABLE_PATTERN = r"(?i)(?:FROM|JOIN)\s+(?:`?(\w+)`?\.)?`?(\w+)`?"
ANY_TABLE_PATTERN = (r"(?i)(?:\bFROM\b|\bJOIN\b|\bUPDATE\b|\bINTO\b)\s+"
                     r"([`'\"]?\w+[`'\"]?(?:\.[`'\"]?\w+[`'\"]?)?)")


# Pieces of a statement that are no code: literals (an open one runs to the end) and comments. Repetitions give nothing back,
# so that long literals need no stack.
_STRING = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+(?:'|\z)"
_QUOTED = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+(?:"|\z)'
_TICKED = r"`[^`]*+(?:`|\z)"
_COMMENT = r"--[^\n]*+|#[^\n]*+|/\*.*?(?:\*/|\z)"
PIECES = f"(?s){_STRING}|{_QUOTED}|{_TICKED}|{_COMMENT}|[^'\"`#/-]++|."
NOT_CODE = r"['\"`#]|--|/\*"


def code(q: Column, names: bool = False) -> Column:
    """The statement without comments, and with a question mark for every literal; names in backticks stay with ``names``."""
    def kept(p: Column) -> Column:
        quote, two = F.left(p, F.lit(1)), F.left(p, F.lit(2))
        literal_ = quote.isin("'", '"') if names else quote.isin("'", '"', "`")
        return F.when(literal_, "?").when((quote == "#") | two.isin("--", "/*"), " ").otherwise(p)
    return F.when(q.rlike(NOT_CODE), F.array_join(F.transform(F.regexp_extract_all(q, F.lit(PIECES), F.lit(0)), kept), "")).otherwise(q)


def subquery_depth(plain: Column, most: int = 10) -> Column:
    """How deep sub-queries are nested in code without literals and comments, at most ``most``.

    One pass over the parentheses: ``open`` holds one sign for each that is open, S if a sub-query began there.
    """
    signs = F.regexp_extract_all(plain, F.lit(r"(?i)\(\s*SELECT\b|\(|\)"), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(s: Column, sign: Column) -> Column:
        closes, deeper = sign == ")", F.length(sign) > 1
        inner = F.when(closes, s["depth"] - F.when(F.right(s["open"], F.lit(1)) == "S", 1).otherwise(0)).otherwise(s["depth"] + deeper.cast("int"))
        left = F.when(closes, F.left(s["open"], F.greatest(F.length(s["open"]) - 1, F.lit(0)))).otherwise(
            F.concat(s["open"], F.when(deeper, "S").otherwise("-")))
        return F.struct(left.alias("open"), inner.alias("depth"), F.greatest(s["most"], inner).alias("most"))
    return F.when(plain.rlike(r"(?i)\(\s*SELECT\b"), F.least(F.aggregate(signs, start, step, lambda s: s["most"]), F.lit(most))).otherwise(0)


def literal(words) -> str:
    """Case-insensitive alternation that matches any of the words literally (Java regex)."""
    return "(?i)" + "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def has_any(c: Column, words) -> Column:
    """True if the text contains one of the words, ignoring case."""
    return c.rlike(literal(words)) if words else F.lit(False)


def may_have(c: Column, words) -> Column:
    """True if the text contains one of the words after both were put in upper case: cheap, and true wherever a pattern that
    ignores case finds one of them.

    A projection with a function over an array is compiled apart, in small methods. In one method with joins and labels the
    rules passed the size (8,000 bytes) up to which the JVM compiles a method at all.
    """
    def has(up: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(up, F.upper(F.lit(w)))
        return out
    # The one-element array binds the upper-case text once.
    return F.exists(F.array(F.upper(c)), has)


def spots_any(c: Column, words) -> Column:
    """``has_any``, with the search behind ``may_have``."""
    return may_have(c, words) & has_any(c, words) if words else F.lit(False)


def contains_any(c: Column, words) -> Column:
    """Case-sensitive containment of any word."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def upper_has(c: Column, words) -> Column:
    return contains_any(F.upper(c), words)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_query(q: Column) -> Column:
    """Quoted words and digit runs become placeholders."""
    q = F.regexp_replace(q, r'(?U)"\w+"', '"?"')
    q = F.regexp_replace(q, r"(?U)'\w+'", "'?'")
    return strip(F.regexp_replace(q, r"(?U)\d+", "?"))


def normalize_for_detection(q: Column) -> Column:
    """Lower case, single spaces, literals replaced by type names, comments removed."""
    q = F.regexp_replace(F.lower(q), r"(?U)\s+", " ")
    q = F.regexp_replace(q, r"'[^']*'", "'STRING'")
    q = F.regexp_replace(q, r"(?U)\b\d+\b", "NUMBER")
    q = F.regexp_replace(q, r"/\*.*?\*/", "")
    return strip(F.regexp_replace(q, r"(?m)--.*$", ""))


def entropy(q: Column) -> Column:
    """Shannon entropy in bits per character."""
    # The one-element array binds the text once, however it was computed.
    return F.element_at(F.transform(F.array(q), _entropy_of), 1)


def _entropy_of(s: Column) -> Column:
    # Text, length and the share of each character are bound, so that a character costs one replacement; an empty piece
    # of the split has no share.
    bound = F.array(F.struct(s.alias("s"), F.length(s).cast("double").alias("n"), F.array_distinct(F.split(s, "")).alias("chars")))
    shares = F.transform(bound, lambda b: F.transform(b["chars"], lambda c: (b["n"] - F.length(F.replace(b["s"], c, F.lit("")))) / b["n"]))
    return F.when(F.length(s) > 0, F.aggregate(
        F.flatten(shares), F.lit(0.0), lambda acc, p: F.when(p > 0, acc - _plogp(p)).otherwise(acc))).otherwise(0.0)


def _plogp(p: Column) -> Column:
    return p * F.log2(p)


def read_tables(q: Column) -> Column:
    """Distinct lower-cased tables after FROM or JOIN in code, with their schema if one is written."""
    return F.element_at(F.transform(F.array(code(q, names=True)), _read_tables_of), 1)


def _read_tables_of(q: Column) -> Column:
    dbs = F.regexp_extract_all(q, F.lit(READ_TABLE_PATTERN), F.lit(1))
    names = F.regexp_extract_all(q, F.lit(READ_TABLE_PATTERN), F.lit(2))
    return F.array_distinct(F.zip_with(
        dbs, names, lambda d, t: F.lower(F.when(F.coalesce(d, F.lit("")) == "", t).otherwise(F.concat_ws(".", d, t)))))


def touched_tables(q: Column) -> Column:
    """Distinct tables after FROM, JOIN, UPDATE or INTO; sub-queries are skipped."""
    hits = F.regexp_extract_all(q, F.lit(ANY_TABLE_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(hits, lambda t: F.lower(F.regexp_replace(t, "[`'\"]", ""))))


def touches_table(q: Column) -> Column:
    """True if ``touched_tables`` has any; the names are not made."""
    return q.rlike(ANY_TABLE_PATTERN)


def database_from_sql(q: Column) -> Column:
    """First schema name found, trying the patterns in order; null if none matches."""
    found = F.lit(None).cast("string")
    for p in reversed(DATABASE_PATTERNS):
        hit = F.regexp_extract(q, f"(?i){p}", 1)
        found = F.when(hit != "", F.lower(hit)).otherwise(found)
    return found


def resolve_database(current_schema: Column, q: Column) -> Column:
    known = F.lower(current_schema)
    return F.when(current_schema.isNotNull() & ~known.isin("unknown", "none", "", "null"), known).otherwise(
        F.coalesce(database_from_sql(q), F.lit("unknown")))


def client_ip(host: Column) -> Column:
    return F.when(F.coalesce(host, F.lit("")) == "", "unknown").otherwise(F.split_part(host, F.lit(":"), F.lit(1)))


def command_type(q: Column) -> Column:
    """Leading verb; if there is none, the first of four verbs the text contains."""
    up = F.upper(strip(q))
    first = F.regexp_extract(up, r"^(\w+)", 1)
    return (F.when(first.isin(*SQL_VERBS), first)
            .when(up.contains("SELECT"), "SELECT").when(up.contains("INSERT"), "INSERT")
            .when(up.contains("UPDATE"), "UPDATE").when(up.contains("DELETE"), "DELETE").otherwise("UNKNOWN"))


def parse_failed(q: Column) -> Column:
    return F.when(F.regexp_extract(F.upper(strip(q)), r"^(\w+)", 1).isin(*SQL_VERBS), 0).otherwise(1)


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def count_of(q: Column, pattern: str) -> Column:
    return F.regexp_count(q, F.lit(pattern)).cast("int")


def clause_size(q: Column, keyword: str) -> Column:
    """Number of comma-separated items after GROUP BY / ORDER BY, 0 without the clause."""
    body = F.regexp_extract(q, rf"(?is)\b{keyword}\s+BY\s+(.*?)(?:\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b|\)|;|$)", 1)
    return F.when(body == "", 0).otherwise(F.size(F.split(body, ","))).cast("int")


def query_bucket(q: Column) -> Column:
    up = F.upper(strip(q))
    out = F.lit("OTHER")
    # Statement classes, in order.
    for verb in reversed(("SELECT", "INSERT", "UPDATE", "DELETE", "SHOW", "SET", "CREATE", "ALTER", "DROP")):
        out = F.when(up.startswith(verb), verb).otherwise(out)
    return out
