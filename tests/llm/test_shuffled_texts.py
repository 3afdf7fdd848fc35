"""What the pipeline's stages hold on disk and move: no copies of all texts, and each text once."""

import os

from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.llm import divergence, fuzzy_lines, simhash
from tests.llm.test_fuzzy_lines import frame, variants

WORDS = "the of and to a in is that for it was with on be this river stone water cloud light morning evening house street".split()


def documents(spark, n):
    rows = [(k, " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + str(i * k % 97) for i in range(80)), "en") for k in range(n)]
    rows += [(n, "short", "en"), (n, None, None), (None, None, "en"), (None, rows[0][1], None), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_quality_rules_copy_no_texts(spark, monkeypatch):
    cut, whole = {}, scratch.materialize

    def seen(df, label="cut"):
        out = cut[label] = whole(df, label)
        return out

    for module in (divergence, scratch):
        monkeypatch.setattr(module, "materialize", seen)
    df = documents(spark, 60).cache()
    kept = divergence.keep_good(df)
    judged = divergence.quality(df, ["doc_id", "text", "lang"]).where("kept").select("doc_id", "text", "lang")
    key = [F.coalesce(c, F.lit("-")) for c in (F.col("doc_id").cast("string"), "text", "lang")]
    assert sorted(map(tuple, kept.select(*key).collect())) == sorted(map(tuple, judged.select(*key).collect()))
    assert 0 < kept.count() < df.count() and kept.columns == df.columns
    assert all("text" not in t.columns for label, t in cut.items() if label != "quality")


def test_near_dedup_deals_texts_out_once(spark):
    df = documents(spark, 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(df)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        kept.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("Exchange" in x and "text" in y for x, y in zip(plan.splitlines(), plan.splitlines()[1:])) <= 1


def test_profiles_move_to_buckets_once(spark):
    distinct = fuzzy_lines._distinct(fuzzy_lines.occurrences(frame(spark, variants(5, 40, 3)), "doc_id", "text"))
    members = fuzzy_lines._buckets(distinct).where("n > 2").select("bucket", "id", "weight", F.col("id").alias("group"))
    texts = spark.createDataFrame([], "id long, line string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = fuzzy_lines._met(fuzzy_lines._led(fuzzy_lines._apart(members), 16), fuzzy_lines._profiles(texts, distinct))
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(bucket" in x and "block" in x]
    assert len(moved) == 2
    assert plan.count("parity") and not [x for x in plan.splitlines() if "Exchange hashpartitioning(bucket" in x and "block" not in x and "parity" in x]


def test_texts_of_lines_leave_with_the_groups(spark):
    lines = variants(3, 12, 2)
    df = frame(spark, lines)
    held = scratch._MADE.set([])
    try:
        judged = fuzzy_lines.judged_lines(df)
        made = list(scratch._MADE.get())
    finally:
        scratch._MADE.reset(held)
    assert judged.count() == len(lines)
    left = [p for p in made if os.path.isdir(p.removeprefix("file://"))]
    assert [("places" in p) for p in left] == [True]
