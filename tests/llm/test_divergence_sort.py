"""Of a text's windows of three words only those are sorted that may be repeated."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence
from lodestone.llm.text_sql import let, words


def repeated(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(let(words(F.col("text")), divergence._repeated_words)).first()[0]


def test_a_text_without_a_repeated_window_is_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_covered_words", lambda w, at: F.raise_error(F.lit("sorted")).cast("long"))
    assert repeated(spark, "a b c d a b d c") == 0
    with pytest.raises(Exception, match="sorted"):
        repeated(spark, "a b c d a b c")


@pytest.mark.parametrize("few", [0, 2, 64])
@pytest.mark.parametrize("seed", range(6))
def test_repeated_words_by_sets(spark, monkeypatch, seed, few):
    monkeypatch.setattr(divergence, "FEW", few)
    r = random.Random(seed)
    w = [r.choice("abcdefgh"[: 2 + seed]) for _ in range(40 if seed else 2)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    assert repeated(spark, " ".join(w)) == len({k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)})
