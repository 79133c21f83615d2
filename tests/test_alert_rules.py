"""Notification rules against a loop over all pairs."""

import random

from auditloom.monitor import alerts as AL


def test_rules_by_postings(spark):
    r = random.Random(4)
    names, tags = [f"c{k}" for k in range(6)], [f"t{k}" for k in range(5)]

    def some(pool):
        return r.choice([None, [], r.sample(pool, r.randrange(1, 4)), r.sample(pool, 2) * 2])
    alerts = [(k, r.randrange(1, 5), some(names), some(tags)) for k in range(80)]
    rules = [(f"r{k}", r.random() < .9, r.randrange(1, 6), some(names), some(tags)) for k in range(60)]
    got = AL.matching_rules(spark.createDataFrame(alerts, "alert_id long, priority int, affected_components array<string>, tags array<string>"),
                            spark.createDataFrame(rules, "rule_id string, enabled boolean, min_priority int, components array<string>, tags array<string>"))
    want = sorted((a, rule) for a, p, c, t in alerts for rule, on, least, wc, wt in rules
                  if on and p >= least and (not wc or set(wc) & set(c or [])) and (not wt or set(wt) & set(t or [])))
    assert sorted((x.alert_id, x.rule_id) for x in got.collect()) == want and len(want) > 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join Inner") == 3
