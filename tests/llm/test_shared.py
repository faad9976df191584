"""Shared pieces: token ids, components, broadcast bounds, fresh names."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from jobsignal.llm import queries, shared, wordtokens
from jobsignal.plans import components
from tests.llm import brute

TOKENS = queries.tokenizer_path("word_bpe_49k.json")


@lru_cache(1)
def tokens():
    return wordtokens.word_tokens(TOKENS)


def same(text):
    return tokens().ids(text).tolist() == tokens().model.encode(text, add_special_tokens=False).ids


def test_ids_of_every_character():
    for c in map(chr, range(0x3100)):
        assert all(same(t) for t in (c, f"a{c}b", f"A{c} {c}'S 1{c}2 é{c}")), hex(ord(c))


def test_ids_of_random_texts():
    rng = random.Random(1)
    pools = [
        [chr(c) for c in range(0x20, 0x7F)], [chr(c) for c in range(0x250)], [chr(c) for c in range(0x300, 0x370)], [chr(c) for c in range(0x3100)],
        list("abcİΣςσKÅẞ \n\t\x1c\x85\xa0 'sS<|"), ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "'ll", "'S", " ", "\n"],
    ]
    for i in range(20_000):
        text = "".join(rng.choice(rng.choice(pools) if i % 2 else pools[(i // 2) % len(pools)]) for _ in range(rng.randrange(1, 30)))
        assert same(text), ascii(text)


@pytest.mark.parametrize("kind", ["chain", "mixed"])
def test_components(spark, monkeypatch, kind):
    rng = random.Random(2)
    if kind == "chain":  # a thousand versions, each linked with the one before
        links = [(i, i + 1) for i in range(1000)]
    else:  # stars around large ids, cycles, random links, repeated and reversed ones
        links = [(900, i) for i in range(300, 330)] + [(i, 400 + (i + 1) % 50) for i in range(400, 450)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(150)] + [(900, 300), (300, 900), (7, 7)]
    names = []
    monkeypatch.setattr(components, "stored", lambda df, name, f=components.stored: names.append(name) or f(df, name))
    got = {r.node: r.label for r in shared.components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert got == {i: c for i, c in brute.components({x for p in links for x in p}, links).items() if i in nodes}
    assert names.count("parents") <= 15


def test_broadcast_bounds(spark, monkeypatch):
    hints = lambda df: df._jdf.queryExecution().toString().count("strategy=broadcast")
    rows = spark.range(10).select("id", F.array_repeat("id", 100).alias("a"))
    assert hints(shared.small_or_merge(rows)) and shared.measured(rows)[0] == 10
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 1000)
    assert not hints(shared.small_or_merge(rows))


def test_fresh_names():
    assert shared.fresh(["a", "_N", "__n"], "_n", "b", "A") == ["___n", "b", "_A"]
