"""Exact dedup, word runs and the filter audit against brute force and SQL, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, filter_audit, queries, word_runs
from tests.llm import brute
from tests.llm.test_operators import DATA, ODD, SCHEMA, docs, empty, local, odd  # noqa: F401  fixtures

PLAIN = brute.re.compile(r"[\x20\x09-\x0D]+")


def same_as_sql(spark, name, tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    want = want.fetchall()
    got = queries.QUERIES[name](spark, DATA)
    assert set(columns) == set(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def brute_classes(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[PLAIN.sub(" ", text or "")].append(doc)
    out = []
    for text, ids in groups.items():
        known = [x for x in ids if x is not None]
        keep = min(known, default=None)
        for k, doc in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            out.append((doc, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_op11_sql(spark):
    same_as_sql(spark, "op11_exact_dedup", ["documents"])


def test_op11_odd(spark, odd, empty):  # noqa: F811
    rows = [(r[0], r[1]) for r in ODD]
    assert sorted(map(tuple, exact_dedup.classes(odd).collect()), key=repr) == brute_classes(rows)
    # the same by chunks in other tasks
    assert sorted(map(tuple, exact_dedup.classes(odd, huge=10).collect()), key=repr) == brute_classes(rows)
    assert exact_dedup.classes(empty).count() == 0
    stay = exact_dedup.drop_copies(odd)
    assert stay.columns == odd.columns and stay.count() == sum(r[3] for r in brute_classes(rows))


def test_op11_collisions_are_taken_apart(spark):
    """With primes of one digit most texts of a length collide; only their bytes tell them apart."""
    draw = random.Random(3)
    rows = [(k if k % 7 else None, "".join(draw.choice("ab \n") for _ in range(draw.randrange(6)))) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for huge in (3, 1 << 20):
        assert sorted(map(tuple, exact_dedup.classes(frame, primes=(2, 3), huge=huge).collect()), key=repr) == brute_classes(rows)


def test_op11_fingerprint_is_that_of_the_whole():
    raw = random.Random(1).randbytes(100_000)
    plain = [0, 0]
    for x in raw:
        plain = [(h * b + x) % p for h, b, p in zip(plain, exact_dedup.BASES, exact_dedup.PRIMES)]
    assert exact_dedup.fingerprint(raw) == exact_dedup.packed(plain)
    cut = [exact_dedup.shifted(raw[a:b], len(raw) - b, exact_dedup.PRIMES) for a, b in [(0, 17), (17, 40_000), (40_000, 100_000)]]
    assert [sum(h) % p for h, p in zip(zip(*cut), exact_dedup.PRIMES)] == plain


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            e = i
            while e + p < n and w[e] == w[e + p]:
                e += 1
            length = e + p - i
            if length >= max(6, 4 * p):
                own = w[i : i + length]
                if not any(all(own[k] == own[k + q] for k in range(length - q)) for q in range(1, p)):
                    out.append((i, length, p))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = brute.words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_row(doc_id, text):
    w = planted(doc_id, text)
    found = brute_runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_op12_runs_of_random_words():
    draw = random.Random(5)
    for k in range(1500):
        letters = draw.choice(["a", "ab", "abc", "abcdef"])
        w = [draw.choice(letters) for _ in range(draw.randrange(60))]
        if k % 3 == 0:  # nested repetitions
            part = [draw.choice(letters) for _ in range(draw.randrange(1, 5))] * draw.randrange(1, 7) + [draw.choice(letters)]
            w = w[:5] + part * draw.randrange(1, 9) + w[:7]
        assert word_runs.runs(w) == brute_runs(w), w


def test_op12_long_periods_use_hashes():
    draw = random.Random(6)
    for period in (1, 7, 40, 300, 1500):
        root = [str(draw.randrange(3 if period < 50 else 10**6)) for _ in range(period)]
        w = [str(-draw.randrange(9)) for _ in range(50)] + (root * 9)[: 8 * period + period // 2] + ["end"] + root * 4
        assert word_runs.runs(w) == brute_runs(w)


def test_op12_chance_meetings_of_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(word_runs, "MODULUS", 3)
    draw = random.Random(7)
    for _ in range(200):
        root = [draw.choice("abcd") for _ in range(draw.randrange(1, 30))]
        w = (root * 6)[: draw.randrange(200)] + [draw.choice("abcd") for _ in range(40)] + root * 5
        # hashes never differ where words don't, and what they say too much is cut at the first other word
        assert word_runs.runs(w) == brute_runs(w)


def test_op12_time_is_near_linear():
    import time

    w = [str(k % 3000) for k in range(150_000)]
    began = time.process_time()
    assert word_runs.runs(w) == [(0, 150_000, 3000)]
    assert word_runs.runs(["a"] * 150_000) == [(0, 150_000, 1)]
    assert time.process_time() - began < 20


def test_op12(spark, local, odd, empty):  # noqa: F811
    want = sorted((brute_row(d, t) for d, t, *_ in local), key=repr)
    assert sorted(map(tuple, queries.op12_word_runs(spark, DATA).collect()), key=repr) == want
    rows = word_runs.find_runs(odd.where("doc_id is null or doc_id <> 5")).collect()
    assert len(rows) == len(ODD) - 1 and next(r for r in rows if r["doc_id"] == 1)["collapsed"] == ""
    assert next(r for r in word_runs.find_runs(spark.createDataFrame([(1, "x y x y x y x y z")], "doc_id long, text string")).collect()).collapsed == "x y z"
    assert word_runs.find_runs(empty).count() == 0


def brute_audit(rows, labels):
    """Straight through every order, row by row."""
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs_ = []
    for d, t, _, source, *_ in rows:
        t = t or ""
        w = brute.words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t],
        }
        docs_.append((source or "", {k for k, v in fails.items() if v}, d))
    out, shapley = {}, Counter()
    for part in {x[0] for x in docs_}:
        for order in permutations("ABCDE"):
            left = [x for x in docs_ if x[0] == part]
            gone = []
            for k, f in enumerate(order):
                lost = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(lost)
                alone = sum(x[1] == {f} for x in docs_ if x[0] == part)
                out[part, "".join(order), k + 1] = (len(left), len(lost), redundant, alone, sum((x[2], "q") in labels for x in lost), sum((x[2], "t") in labels for x in lost))
                gone += lost
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_op13_sql(spark):
    same_as_sql(spark, "op13_filter_audit", ["documents", "labels"])


def test_op13_odd(spark, odd, empty):  # noqa: F811
    rows = [*ODD, (10, "copy # of one", "en", "a", 3), (11, "copy # of one", "en", None, 3), (11, "copy # of one", "en", "a", 3), (None, "copy # of one", "en", "b", 3)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("digest", F.lit("y"))
    labels = [(10, 1, 0), (11, 1, 1), (11, 0, 0), (5, None, 1), (None, 1, 1), (99, 1, 1)]
    marked = {(d, "q") for d, q, _ in labels if q == 1 and d is not None} | {(d, "t") for d, _, t in labels if t == 1 and d is not None}
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(frame, table).collect()}
    assert got == brute_audit(rows, marked)
    assert filter_audit.audit(empty, table).count() == 0
    assert filter_audit.audit(odd, table.where("false")).where("good_lost > 0").count() == 0
