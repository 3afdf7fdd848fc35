"""Secrets of any length and of any number of terms."""

import random
import time

from lodestone.llm import secret_scan


def key(n, seed=1):
    r = random.Random(seed)
    return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789/") for _ in range(n))


def literals(text):
    return [text[s:e] for s, e, k in secret_scan.spans(text) if k == "literal"]


def test_long_literals_are_whole():
    long = key(20_000)
    assert literals(f'private_key = "{long}"\n') == [long]
    assert literals(f"private_key = {long}\n") == [long]
    name = "v" + long.replace("/", "_")
    assert literals(f'x = "a1"\naccess_key = x + {name}\n') == ["a1", name]
    name = "private_key_" + "of_the_service_" * 20
    assert literals(f'{name} = "{key(40)}"\n') == [key(40)]


def test_every_term_of_a_joined_value():
    terms = [key(6, k) for k in range(200)]
    joined = " + ".join(f'"{x}"' for x in terms)
    assert literals(f"private_key = {joined}\n") == terms
    assert literals(f"base = {joined}\naccess_key = base\n") == terms
    assert literals("".join(f'p{k} = p{k - 1} + "{x}"\n' for k, x in enumerate(terms)) + "access_key = p199\n")[-200:] == terms


def test_long_texts_take_linear_time():
    began = time.process_time()
    doubled = f'p0 = "{key(12)}"\n' + "".join(f"p{k} = p{k - 1} + p{k - 1}\n" for k in range(1, 200)) + "access_key = p199\n"
    assert literals(doubled) == [key(12)]
    for text in ("private_key = '" + "<" * 300_000 + "'", "private_key = '" * 20_000, 'private_key="\\\\' * 20_000, "private_key" * 20_000, "secret " + "a=" * 100_000):
        secret_scan.spans(text)
    assert time.process_time() - began < 20
