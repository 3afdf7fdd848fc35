"""Edge cases of the store, BPE, vector search and page extraction."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, exact_topk, html_text, token_store


def test_a_store_with_exchanged_recipes_is_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "one two three"), (2, "six ten seven"), (3, "")], "doc_id long, text string")
    token_store.write_store(df, path, P.path("word_bpe_49k.json"), 1)
    assert token_store.read_digests(spark, path).count() == 3 and token_store.verify_manifest(spark, path).count() == 0
    rows = spark.read.parquet(f"{path}/recipes").collect()
    one, two = (next(r for r in rows if r["doc_id"] == k) for k in (1, 2))
    other = {1: two["digests"], 2: one["digests"]}
    changed = [(r["start"], r["doc_id"], r["n_tokens"], other.get(r["doc_id"], r["digests"]), r["root"]) for r in rows]
    spark.createDataFrame(changed, spark.read.parquet(f"{path}/recipes").schema).write.mode("overwrite").parquet(f"{path}/recipes")
    assert token_store.verify_manifest(spark, path).count() == 1
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_digests(spark, path)


def test_overlapping_merges_of_one_rank():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.byte_bpe(path, P.PATTERN)
    exact = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    r, overlapped = random.Random(1), 0
    for _ in range(3000):
        text = "".join(r.choice(r.choice(["ab", "ha -=_!.", "annala", "\n 01sé日"])) for _ in range(r.randint(1, 40)))
        overlapped += bool(bpe.overlap.search(text.encode()))
        assert bpe.encode([text])[0] == np.array(exact.encode_ordinary(text), "<u4").tobytes(), text
        for piece in bpe.pattern.findall(text):
            assert bpe.merged(piece.encode()) == exact.encode_ordinary(piece)
    assert overlapped > 100


def test_tiny_and_huge_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [-1e-20, 0.0]), (2, [1e306, 0.0]), (3, [1e200, 1.0]), (4, [0.5, float("nan")]), (5, [0.0, -2e-4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {r["vec_id"]: r["v"] for r in exact_topk.whole_vectors(df, "vec_id", "embedding").collect()}
    assert set(whole) == {0, 1, 3, 5} and whole[1] == [-1.0, 0.0] and whole[5] == [0.0, -1.0] and whole[3] == [1e200 * 1024, 1024.0]
    found = exact_topk.search(df.where("vec_id <> 3"), k=10, every=100).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1, -1024), (2, 5, -1024)]


def test_deep_pages_and_names_in_articles(spark):
    deep = "<div>" * 100_000 + "<article><p>" + "word, " * 50 + "</p></article>"
    article = (
        "<html><body><article><p class='ad-hoc'>" + "one two three, " * 9 + "</p><div class='side-effects'>" + "four five, " * 9
        + "</div><p class='notice-period'>six seven.</p><div class='share-buttons'>share</div><div class='ad-slot'>buy</div><div class='related-posts'>more</div></article></body></html>"
    )
    df = spark.createDataFrame([(1, "http://a/x", deep), (2, "http://a/y", article), (3, None, None), (4, "http://a/z", "")], "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html_text.extract(df.withColumn("host", F.lit("clash"))).collect()}
    assert text[1] == " ".join(["word,"] * 50) and text[3] == text[4] == ""
    assert text[2] == "\n\n".join([" ".join(["one two three,"] * 9), " ".join(["four five,"] * 9), "six seven."])
    assert html_text.extract(df.limit(0)).count() == 0
