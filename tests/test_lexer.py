"""Statement shapes against a plain scanner, sign by sign."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text
from auditloom.operators import features as FE

CASES = ["", "SELECT 1", "SELECT 'a JOIN b' FROM t -- JOIN u", "SELECT \"x\" FROM `join` # WHERE", "/* open JOIN", "'open JOIN", "SELECT 'it''s' JOIN b", r"SELECT 'a\' JOIN' JOIN c",
         "SELECT (SELECT (SELECT 1))", "(SELECT 1) UNION (SELECT 2)", "SELECT f((1)) FROM (  select 2 from (SELECT 3) a) b", ")) (SELECT 1) ) (SELECT (SELECT 2))",
         "SELECT" + "(SELECT" * 14 + " 1" + ")" * 14, "SELECT a-b/c FROM t/*x*/JOIN u", "FROM/**/a JOIN`b`.`c`", "SELECT '" + "x'' " * 20_000 + "' JOIN t"]


def scan(q):
    """The statement without comments, literals as question marks."""
    out, i = [], 0
    while i < len(q):
        c = q[i]
        if c in "'\"`":
            j = i + 1
            while j < len(q) and q[j] != c or c != "`" and q[j:j + 2] == c * 2:
                j += 2 if c != "`" and (q[j] == "\\" or q[j:j + 2] == c * 2) else 1
            if j > len(q):  # a lone backslash at the end
                out.append(c)
                i += 1
                continue
            out.append("?")
            i = j + 1
        elif c == "#" or q[i:i + 2] == "--":
            j = q.find("\n", i)
            out.append(" ")
            i = len(q) if j < 0 else j
        elif q[i:i + 2] == "/*":
            j = q.find("*/", i + 2)
            out.append(" ")
            i = len(q) if j < 0 else j + 2
        else:
            out.append(c)
            i += 1
    return "".join(out)


def depth(code):
    stack, most = [], 0
    for m in re.finditer(r"(?i)\(\s*SELECT\b|\(|\)", code):
        if m[0] == ")":
            stack = stack[:-1]
        else:
            stack.append(len(m[0]) > 1)
        most = max(most, sum(stack))
    return min(most, 10)


def statements():
    r = random.Random(2)
    bits = ["'", "''", "\"", "`", "--", "\n", "/*", "*/", "#", "(", ")", "(SELECT ", " JOIN ", " WHERE ", "a", " ", ",", "-", "/", "FROM x"]
    return CASES + ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(400)]


def test_code_and_depth(spark):
    rows = list(enumerate(statements()))
    df = spark.createDataFrame(rows, "id long, q string").withColumn("code", text.code(F.col("q")))
    got = {r.id: r for r in df.select("id", "code", text.subquery_depth(F.col("code")).alias("depth")).collect()}
    for i, q in rows:
        assert got[i].code == scan(q) and got[i].depth == depth(scan(q)), q


@pytest.mark.parametrize("q,want", [("SELECT a FROM t1 JOIN s.t2 ON 1 = 1 -- FROM t3", ["s.t2", "t1"]), ("SELECT 'FROM t1' FROM `s`.`t2`", ["s.t2"]),
                                    ("SELECT a FROM/* FROM t1 */t2", ["t2"]), (None, None)])
def test_tables(spark, q, want):
    row = spark.createDataFrame([(q,)], "q string").select(F.array_sort(text.read_tables(F.col("q"))).alias("t")).first()
    assert row.t == want


def test_counts(spark):
    q = "SELECT 'JOIN', `where` FROM a JOIN b ON 1 = 1 WHERE x = 'AND' AND y IN (SELECT z FROM c WHERE w = (SELECT 1)) GROUP BY p, q ORDER BY r -- LIMIT 1"
    df = spark.createDataFrame([(q,)], "query string").withColumn("accessed_tables", text.read_tables(F.col("query")))
    one = df.select(*[c.alias(n) for n, c in FE.shape_features(F.col("query")).items()]).first()
    assert (one.num_tables, one.num_joins, one.num_where_conditions, one.subquery_depth, one.is_parse_failed) == (3, 1, 2, 2, 0)
    two = df.select(*[c.alias(n) for n, c in FE.shape_features_detailed(F.col("query")).items()]).first()
    assert (two.num_joins, two.num_where_conditions, two.num_group_by_cols, two.num_order_by_cols, two.has_limit, two.has_subquery, two.has_where) == (1, 2, 2, 1, 0, 1, 1)
