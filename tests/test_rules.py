import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.plans import rules as R
from tracewell.schema import conform


def loaded(*texts):
    return R.load_text("\n---\n".join(texts))


def rule(title, detection, logsource="{product: linux, service: auth}", **more):
    return f"title: {title}\n" + "".join(f"{k}: {v}\n" for k, v in more.items()) + f"logsource: {logsource}\ndetection:\n" + "\n".join(f"  {k}: {v}" for k, v in detection.items())


@pytest.mark.parametrize(
    "detection,want",
    [
        ({"a": "{message|contains: 'Failed*Password'}", "condition": "a"}, {"password"}),
        ({"a": "{message|contains: [one, three]}", "b": "{user: administrator}", "condition": "a and b"}, {"administrator"}),
        ({"a": "{message|contains|all: [one, three]}", "condition": "a"}, {"three"}),
        ({"a": "{message|contains: one}", "b": "{user: two}", "condition": "a or b"}, {"one", "two"}),
        ({"a": "{message|contains: one}", "b": "{user: two}", "condition": "a and not b"}, {"one"}),
        ({"a": "{message|contains: one}", "condition": "not a"}, None),
        ({"a": "{message|contains: one}", "b": "{pid|gt: 5}", "condition": "a or b"}, None),
        ({"a": "{message|re: 'one.*'}", "condition": "a"}, None),
        ({"a": "{message: null}", "condition": "a"}, None),
        ({"a": "[keyword, other]", "condition": "a"}, {"keyword", "other"}),
        ({"a1": "{message|contains: one}", "a2": "{user: four}", "condition": "1 of a*"}, {"one", "four"}),
        ({"a": "{message|contains|windash: ' -exec'}", "condition": "a"}, {"exec"}),
        ({"a": "{message|contains: 'C:\\Users\\x'}", "condition": "a"}, {"users"}),
        ({"a": "{message|contains: ab}", "condition": "a"}, None),
    ],
)
def test_texts_that_a_rule_needs(detection, want):
    (r,) = loaded(rule("t", detection))
    got = R.needed(r).texts
    assert (set(got) if got is not None else None) == want


def rows_and_rules(n_rules, n_rows=300):
    rng = random.Random(n_rules)
    words = [f"{a}{b}{c}" for a in "qxzvk" for b in "aeiou" for c in "mnrst"]
    rows = []
    for i in range(n_rows):
        source = rng.choice(["auth", "cron", "syslog"])
        extra = rng.choice([None, '{"x":"%s"}' % rng.choice(words), '{"x":"\\u0071am"}', '{"x":"a \\"%s"}' % rng.choice(words)])
        rows.append((i, datetime(2024, 1, 1, 0, i % 60), source, rng.choice([None, *words[:20]]), " ".join(rng.choices(words, k=4)).upper() if i % 3 else None, rng.choice(["ssh_failed", None]), extra, rng.choice([None, 5, 77]), " ".join(rng.choices(words, k=2))))
    texts = []
    for k in range(n_rules):
        w = lambda: rng.choice(words)
        detection = rng.choice(
            [
                {"a": f"{{message|contains: {w()}}}", "condition": "a"},
                {"a": f"{{user: [{w()}, {w()}]}}", "condition": "a"},
                {"a": f"{{message|contains|all: [{w()}, {w()}]}}", "b": f"{{user: {w()}}}", "condition": "a and not b"},
                {"a": f"{{message|contains: {w()}}}", "b": f"{{x|contains: {w()}}}", "condition": "a or b"},
                {"a": f"{{x: {w()}}}", "condition": "a"},
                {"a": f"[{w()}]", "condition": "a"},
                {"a": f"{{message|startswith: {w()[:2]}}}", "b": f"{{message|endswith: '{w()}'}}", "condition": "all of them"},
                {"a": "{type: SSH_FAILED}", "b": f"{{message|re: '(?i){w()}'}}", "condition": "a and b"},
                {"a": f"{{CommandLine|contains: '{w()} {w()}'}}", "condition": "a"},
            ]
        )
        texts.append(rule(f"r{k % 50}", detection, rng.choice(["{product: linux, service: auth}", "{product: linux}", "{product: linux, service: cron}"])))
    return rows, loaded(*texts)


SCHEMA = "id long, ts timestamp_ntz, source string, user string, message string, event string, extra string, pid int, raw string"


def test_indexed_rules_hit_what_each_rule_hits_alone(spark, monkeypatch):
    rows, rules = rows_and_rules(120)
    ev = conform(spark.createDataFrame(rows, SCHEMA)).repartition(3).cache()
    want = sorted((r["rule_id"], r["id"], r["matched"]) for r in R.hits(ev, rules[:100]).collect())
    monkeypatch.setattr(R, "RULES_AT_ONCE", 20)
    got = sorted((r["rule_id"], r["id"], r["matched"]) for r in R.hits(ev, rules[:100]).collect())
    assert got == want and len(want) > 100
    out = R.hits(ev, rules[:100])
    assert out.columns == [*ev.columns, "rule", "rule_id", "matched"]


def test_thousands_of_rules_scan_the_events_once(spark, tmp_path):
    rows, _ = rows_and_rules(1)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ev = conform(spark.createDataFrame(rows, SCHEMA))
    ev = ev.mapInArrow(count, ev.schema)
    texts = [rule(f"r{k}", {"a": f"{{message|contains: '{a}{b}{c}'}}", "b": f"{{pid|gt: {k % 7}}}", "condition": "a and not b"}) for k, (a, b, c) in enumerate((a, b, c) for a in "qxz" for b in "aeiouy" for c in "mnrstbcdfg")]
    rules = loaded(*texts * 2)
    assert len(rules) == 360
    found = {r["rule_id"]: r["n"] for r in R.findings(ev, rules).collect()}
    assert seen.value == len(rows)  # read once
    want = {}
    for k, r in enumerate(rules):
        text, most = r.detection["a"]["message|contains"], r.detection["b"]["pid|gt"]
        hit = [x for x in rows if x[2] == "auth" and text in (x[4] or "").lower() and x[7] is not None and not x[7] > most]
        if hit:
            want[r.title if k < 180 else f"{r.title}#2"] = len(hit)
    assert found == want


WEB = rule("web", {"a": "{sc-status: 500}", "condition": "a"}, "{category: webserver}", name="web")
SSH = rule("ssh", {"a": "{event: ssh_failed}", "condition": "a"}, name="ssh")


@pytest.mark.parametrize("order", [(WEB, SSH), (SSH, WEB)])
def test_correlated_fields_mean_what_each_rule_says(spark, order):
    corr = "title: both\ncorrelation: {type: temporal, rules: [web, ssh], group-by: [c-ip], timespan: 5m}"
    users = "title: users\ncorrelation: {type: event_count, rules: [ssh], group-by: [user], timespan: 5m, condition: {gte: 2}}"
    rules = loaded(*order, corr, users)
    t = datetime(2024, 1, 1)
    rows = [(1, t, "access", None, "10.0.0.1", 500, None), (2, t, "auth", None, "10.0.0.1", None, "ssh_failed"), (3, t, "auth", None, "10.0.0.2", None, "ssh_failed"), (4, t, "auth", "joe", "10.0.0.3", None, "ssh_failed"), (5, t, "access", None, None, 500, None)]
    ev = conform(spark.createDataFrame(rows, "id long, ts timestamp_ntz, source string, user string, src_ip string, status int, event string"))
    # c-ip is a field of web logs alone: ssh events have none, and meet web events without an address
    got = [(r["c-ip"], r["n"], r["first_id"]) for r in R.correlate(ev, rules, rules[2]).collect()]
    assert got == [(None, 2, 2)]
    assert [(r["user"], r["n"]) for r in R.correlate(ev, rules, rules[3]).collect()] == [(None, 2)]
    other = loaded(SSH, rule("win", {"a": "{b: 1}", "condition": "a"}, "{product: windows}", name="win"), "title: c\ncorrelation: {type: temporal, rules: [ssh, win], timespan: 5m}")
    with pytest.raises(R.RuleError):
        R.correlate(ev, other, other[2])
    assert ev.where(F.col("id") < 0).count() == 0
