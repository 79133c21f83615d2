"""Pattern tables against plain loops over all patterns, whatever their number."""

import random
import re

from auditloom.functions.once import required_words
from auditloom.monitor import library as L
from auditloom.monitor import patterns as P
from auditloom.monitor import search as K
from pyspark.sql import functions as F

TEXTS = ["SELECT * FROM users WHERE id = 7 OR 1=1", "grant all privileges on x TO y", "Set  Global a = 1; shutdown", "", None, "ab", "sleeping",
         "SELECT SLEEP ( 5 )", "éclair über SLEEP(1)\nGRANT x", "use shop", "use shop", "x" * 5000 + " into outfile 'f'"]
KEYWORDS = [("k1", "sleep", r"sleep\s*\("), ("k2", "SLEEP", ""), ("k3", "ab", None), ("k4", None, "a"), ("k5", "", "a"), ("k6", "grant", r"to\s+y"), ("k7", "über", None),
            ("k8", "s", "id = (\\d)"), ("k1", "use", None)]


def test_keywords(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, query string")
    table = spark.createDataFrame(KEYWORDS, "pattern_id string, keyword string, regex string")
    want = {}
    for i, t in enumerate(TEXTS):
        ids = sorted({p for p, k, r in KEYWORDS if t is not None and k and k.lower() in t.lower() and (not r or re.search(r, t, re.I))})
        if ids:
            want[i] = ids
    assert {r.id: r.pattern_ids for r in K.keyword_search(df, table).collect()} == want and len(want) > 6


def test_many_patterns_keep_the_plan(spark):
    """Twenty thousand patterns: the same plan as ten, and the result of a loop."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)]
    texts = [" ".join(r.choice(words) if r.random() < .1 else "zz" for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, query string")
    many = spark.createDataFrame([(f"p{i}", w, None) for i, w in enumerate(words)], "pattern_id string, keyword string, regex string")
    found = K.keyword_search(df, many)
    want = {i: sorted(f"p{k}" for k, w in enumerate(words) if w in t) for i, t in enumerate(texts)}
    assert {x.id: x.pattern_ids for x in found.collect()} == {i: ids for i, ids in want.items() if ids}
    few = K.keyword_search(df, many.limit(10))
    assert abs(len(found._jdf.queryExecution().optimizedPlan().toString()) - len(few._jdf.queryExecution().optimizedPlan().toString())) < 200


def test_library_as_a_table(spark):
    events = spark.createDataFrame([(i, {"query": t} if t else {}) for i, t in enumerate(TEXTS)], "event_id long, action_details map<string,string>")
    cols = ["event_id", "content_type", "pattern_id", "attack_type", "weight", "matched"]
    plain = {tuple(r) for r in P.attack_matches(events).select(*cols).collect()}
    base = K.library_table(spark, L.ATTACK_PATTERNS)
    assert {tuple(r) for r in K.attack_matches(P.content_rows(events), base).select(*cols).collect()} == plain and len(plain) > 5
    update = spark.createDataFrame([("privesc_003", "privilege_escalation", 0.1, "(?i)shutdown"), ("new", "persistence", 0.2, "sleep")],
                                   "pattern_id string, attack_type string, weight double, regex string")
    got = {(r.event_id, r.pattern_id, r.weight, r.matched) for r in K.attack_matches(P.content_rows(events), K.merged_library(base, update)).collect()}
    assert (2, "privesc_003", 0.1, "shutdown") in got and (6, "new", 0.2, "sleep") in got and not any(p == "privesc_003" and w != 0.1 for _, p, w, _ in got)


def test_required_words(spark):
    regexes = [r for p in L.ATTACK_PATTERNS for r in p.regexes] + ["abc", "a|b", "x.*password", "[ab]cde", "(?i)set\\s+global", "no"]
    got = {r.x: r.w for r in spark.createDataFrame([(r,) for r in regexes], "x string").select("x", K.required_word(F.col("x")).alias("w")).collect()}
    for x in regexes:
        words = required_words(x)
        assert (got[x] is None) == (not words) and (not words or got[x] in words and len(got[x]) == max(map(len, words)))
