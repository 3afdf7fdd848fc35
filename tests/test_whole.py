"""Registered queries over whole tables against brute force."""

import datetime
from collections import Counter

from lodestone.plans import registered

KINDS = ("view", "click", "buy")


def events(spark, path, rows):
    schema = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_findings_of_all_events(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, k % 7, at, KINDS[k % 3], float(k * 37 % 50), f"p{k}|") for k in [*range(1900, 2100), 70_000]]
    d = events(spark, tmp_path, rows)
    md = {r["ord"]: r["md"] for r in registered.q_findings_md(spark, d).collect()}
    assert set(md) == {r[0] for r in rows} and md[70_000].endswith(f"| u{70_000 % 7}:70000 | p70000\\|\\| x |")
    groups = {r["review"]: (r["n"], r["first_ord"]) for r in registered.q_findings_group(spark, d).collect()}
    counts = Counter(r[3] for r in rows)
    assert groups == {k: (counts[k], min(r[0] for r in rows if r[3] == k)) for k in KINDS}
    rank = lambda v: 4 if v < 5 else 3 if v < 15 else 2 if v < 40 else 1
    want = [r[0] for r in sorted(rows, key=lambda r: (rank(r[4]), r[3], f"u{r[1]}", r[0]))][:100]
    assert [r["ord"] for r in sorted(registered.q_findings_sort(spark, d).collect(), key=lambda r: r["place"])] == want


def test_walks_over_all_edges(spark, tmp_path, monkeypatch):
    pairs = [(8, 9), (9, 10), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (15, 16), (10, 8), (20, 21), (21, 20), (12, 20)]
    monkeypatch.setattr(registered, "edges", lambda spark, d: spark.createDataFrame(pairs, "src long, dst long"))

    def depths(origin, most):
        found = {origin: 0}
        for k in range(1, most + 1):
            for b in {b for a, b in pairs if found.get(a) == k - 1} - set(found):
                found[b] = k
        return found

    assert {r["node"]: r["depth"] for r in registered.q_reach(spark, "").collect()} == depths(8, 6)
    got = {(r["origin"], r["node"]): r["depth"] for r in registered.q_reach_pairs(spark, "").collect()}
    assert got == {(a, b): k for a in {a for a, _ in pairs} for b, k in depths(a, 3).items() if b != a}
