"""The thin ``opN_`` queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import oracles
from lodestone.llm.byte_bpe import round_trip
from lodestone.llm.divergence import quality
from lodestone.llm.exact_dedup import classes
from lodestone.llm.exact_topk import search
from lodestone.llm.filter_audit import audit
from lodestone.llm.fuzzy_lines import dedup_report
from lodestone.llm.hilbert import hilbert_shards
from lodestone.llm.html_text import extract
from lodestone.llm.mixing import mixed_sizes
from lodestone.llm.secret_scan import scan
from lodestone.llm.simhash import components
from lodestone.llm.text_sql import let, words
from lodestone.llm.token_store import read_digests, write_store
from lodestone.llm.word_runs import find_runs
from lodestone.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id", "source", "lang",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("size_class", F.floor(F.log2("size") * 4).cast("int"))
    placed = hilbert_shards(narrow, ["source", "lang", "size_class"], "doc_id", n_shards=24, ties=["text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary; imported late, so that the other queries don't need the files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_digests(spark, path)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumnRenamed("sha256", "text_sha256")


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text's words joined by one space; in one document of ten by the id's hash, from some word on they repeat.  A null id plants none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)

        def from_(at: Column) -> Column:
            period = F.floor((n - at) / (3 + g % 8)) + 1
            return F.array_join(F.transform(w, lambda x, i: F.when(i >= at, F.get(w, (at + (i - at) % period).cast("int"))).otherwise(x)), " ")

        return F.when(n > 0, let(g % n, from_)).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_divergence": op2_divergence,
    "op3_token_store": op3_token_store,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash": op5_simhash,
    "op6_mix": op6_mix,
    "op7_secrets": op7_secrets,
    "op8_exact_topk": op8_exact_topk,
    "op9_html_text": op9_html_text,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_word_runs": op12_word_runs,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op2_divergence": oracles.op2(),
    "op6_mix": oracles.op6(),
    "op8_exact_topk": oracles.op8(),
    "op11_exact_dedup": oracles.op11(),
    "op13_filter_audit": oracles.op13(),
}
