"""Documents that share an id, or have none."""

from lodestone.llm import simhash


def test_different_texts_of_one_id_stay(spark):
    texts = ["".join(f"{w}{k} " for k in range(40)) + "é" for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[0]), (9, texts[3]), (None, texts[2])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3])])


def test_exploded_rows_are_not_broadcast(spark):
    """The planner takes exploded rows to be as few as their sources, which gathered them all in the driver."""
    distinct = spark.range(100).selectExpr("id * 7919 as fp")
    assert "Broadcast" not in simhash.links(distinct)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in simhash.cells(distinct)._jdf.queryExecution().executedPlan().toString()
