"""What earlier probes found: memos that outgrow a worker, null and repeated ids, ordinary names taken for secrets."""

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_topk, hilbert, mixing, secret_scan, token_store
from lodestone.llm.text_sql import word_count


def test_memos_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO_BYTES", 1 << 20)
    monkeypatch.setattr(token_store, "TURN", 512)
    encoder = token_store.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"w{k * 7919 % 100_003}x," for k in range(60_000)).encode()
    encoder.encode(b"warm up")
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for at in range(0, len(text), 1 << 16):
        encoder.encode(text[at : at + (1 << 16)])
    grown = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert grown < 2.5 * (1 << 20)  # two generations
    assert not encoder.memo.old or not getattr(encoder.memo.old, "old", None)


def test_memos_leave_long_words_out_and_ids_as_they_are(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO_BYTES", 2000)
    monkeypatch.setattr(token_store, "TURN", 3)
    encoder = token_store.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = ("river stone " * 20 + "日本語" * 50 + " don't a1b2 -- , 7 <|END|> CAFÉ Straße, ŁÓDŹ İzmir " + "x" * 90) * 3
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(3):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == want
    assert all(len(k) <= token_store.LONG_WORD for k in encoder.memo)
    text = text.replace("<|", "< |") + " It'S Ǆ ẞ"
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("null_share", [2, 1])
def test_mix_meets_its_targets_without_ids(spark, null_share):
    rows = [(None if k % null_share == 0 else k, " ".join(["w"] * (1 + k % 5) + [str(k)]), "ab"[k % 3 == 0]) for k in range(600)]
    rows += [(7, f"one id many texts {k}", "c") for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_sizes(frame).withColumn("key", F.col("source_size")).groupBy("key").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size")).collect()
    assert len(got) == 3 and all(abs(r["taken"] - r["target"]) <= r["size"] for r in got)
    total = mixing.mix(frame).agg(F.sum(word_count(F.col("text")))).first()[0]
    assert total == sum(r["taken"] for r in got)


def test_shards_of_rows_without_ids_are_the_same_again(spark):
    rows = [(None if k % 2 else k // 8, f"text {k}", "s") for k in range(300)]

    def shards(order):
        frame = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3).withColumn("crc", F.crc32(F.col("text").cast("binary")))
        return {(r["text"], r["shard"], r["slot"]) for r in hilbert.hilbert_shards(frame, ["source"], "doc_id", 5, ties=["crc"]).collect()}

    assert shards(rows) == shards(rows[::-1])
    assert zlib.crc32(b"text 1") == spark.sql("SELECT crc32('text 1')").first()[0]


def test_queries_that_share_an_id_have_a_list_each(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 5.0]), (4, [0.0, 4.0])]
    got = exact_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 100).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(100, 1, 1), (100, 1, 3), (100, 2, 2), (100, 2, 4)]


ORDINARY = [
    'tokenizer = "bert-base-uncased"', 'author: "Jean-Pierre2024Smith"', 'secretary: "Mary-Ann.Johnson2"', 'max_tokens_model = "gpt2-medium-large"', 'auth_url = "https://api.site.org/v1/x"',
    'pwd = "/home/user/projects/repo1"', 'token_file = "Config-Prod7.yaml.gz"', 'password_hint = "Maiden-Name-2x"', 'passwordField: "input#Login-Field9"', 'secret_name = "prod/Billing-db2"',
]
SECRET = [
    'dbpassword = "Zx9-Qw7!pL2"', 'clientSecret: "aB3$xY9#mN2@kk"', 'API-KEY => "q8Rt-77_zzKp1-Mw0"', 'auth_token := "f9D3k2LmQ8x7-Pp1"', 'config["password"] = "Tr0ub4dor&3x"', 'access_key_prod = "Kj8!mn2@Pq4%"',
    'PRIVATE_KEY = "mZ81-hhQ2!x0"', 'password2 = "correct-horse-battery-staple"', 'admin_pwd = "N0t/A/Path+x9Q"', 'url_token = "pQ9x!7Lm2@Zr55kd"',
]


def test_names_count_by_whole_words():
    assert [t for t in ORDINARY if any(k == "literal" for _, _, k in secret_scan.spans(t))] == []
    assert [t for t in SECRET if not secret_scan.spans(t)] == []


def plain_pairs(text):
    """``name = "literal"`` lines read by hand: a second, plain lexer for one-line assignments."""
    out = {}
    for line in text.split("\n"):
        at = next((k for k, c in enumerate(line) if c in "=:"), None)
        if at is None:
            continue
        name, value = line[:at].strip().strip("\"'"), line[at + 1 :].strip().rstrip(",")
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            out[name] = value[1:-1]
        elif value in out:
            out[name] = out[value]
    return out


def test_pairs_agree_with_a_plain_lexer():
    rng = np.random.default_rng(3)
    names = ["user", "client_pwd", "base", "api-key", "title", "x1", "signing.key"]
    for _ in range(300):
        lines = []
        for _ in range(int(rng.integers(1, 8))):
            name, other = rng.choice(names, 2)
            value = "".join(rng.choice(list("aB3$x Y9#m-"), int(rng.integers(0, 12))))
            lines.append(rng.choice([f'{name} = "{value}"', f"'{name}': '{value}',", f"{name} = {other}", "plain words", f'{name}="{value}"']))
        text = "\n".join(lines)
        known = {}
        for target, terms in secret_scan.pairs(text):
            found = [known[v] if kind == "bare" and v in known else (v if kind == "string" else None) for kind, _, _, v in terms]
            if found and found[0] is not None:
                known[target] = found[0]
        assert {k: known.get(k) for k in plain_pairs(text)} == plain_pairs(text), text
