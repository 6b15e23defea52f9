import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brocal.llm.packing import packed, packing_report, plan
from brocal.llm.tokenizer import Encoder, encoded, load_vocabulary, token_lengths, vocabulary_path

ENCODER = Encoder(*load_vocabulary(vocabulary_path()), words=50, pairs=1000)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_merging(text):
    assert ENCODER.encode(text) == OTHER.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 500 + "x", "=-" * 2000, "世界" * 700, "<|endoftext|>", "\n\n\t ñandú's 12345"])
def test_long_and_special_texts(text):
    assert ENCODER.encode(text) == OTHER.encode_ordinary(text)


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hola mundo", "x"), (3, "hola mundo", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    rows = [(r["doc_id"], list(r["ids"])) for r in encoded(df, "doc_id", "text").collect()]
    expected = [(1, []), (2, []), (3, OTHER.encode_ordinary("hola mundo")), (3, OTHER.encode_ordinary("hola mundo")), (None, OTHER.encode_ordinary("a"))]
    assert sorted(rows, key=str) == sorted(expected, key=str)
    assert encoded(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r["tokens"] for r in token_lengths(df, "doc_id", "text").collect()) == sorted(len(x) for _, x in expected)


def check(rows, lengths, capacity):
    by: dict = {}
    pieces: Counter = Counter()
    for r in rows:
        pieces[r["k"]] += r["tokens"]
        assert r["inicio"] + r["tokens"] <= capacity
        if r["tokens"]:
            by.setdefault(r["contenedor"], []).append((r["inicio"], r["tokens"]))
    for places in by.values():
        places.sort()
        assert all(a[0] + a[1] <= b[0] for a, b in zip(places, places[1:]))
    assert pieces == Counter(lengths)
    return len(by)


def test_every_item_is_placed_once_and_none_is_split_needlessly(spark):
    r = random.Random(3)
    lengths = {i: min(9000, int(r.lognormvariate(5.5, 0.9))) for i in range(6000)} | {6000: 0, 6001: 2048, 6002: 4096, 6003: 20_001}
    df = spark.createDataFrame(list(lengths.items()), "k long, tokens long")
    out = packed(df, "k")
    rows = out.collect()
    boxes = check(rows, {k: v for k, v in lengths.items()}, 2048)
    least = -(-sum(lengths.values()) // 2048)
    assert boxes <= least * 1.01 + 1
    pieces = Counter(x["k"] for x in rows)
    assert all(pieces[k] == max(1, -(-v // 2048)) for k, v in lengths.items())
    assert packing_report(out).collect()[0]["mayor"] <= 2048


def test_nothing_or_only_empty_items(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "k long, tokens long")
    assert [(r["contenedor"], r["tokens"]) for r in packed(df, "k").collect()] == [(0, 0), (0, 0)]
    assert packed(df.limit(0), "k").count() == 0


def test_one_hot_length_and_plans_don_t_grow_with_counts():
    small, large = plan({700: 30, 648: 20, 10: 5}), plan({700: 3_000_000, 648: 2_000_000, 10: 500_000})
    assert len(large.patterns) <= len(small.patterns) + 5
    for p, counts in ((small, {700: 30, 648: 20, 10: 5}), (large, {700: 3_000_000, 648: 2_000_000, 10: 500_000})):
        used: Counter = Counter()
        for lengths, n in p.patterns:
            assert sum(lengths) <= p.capacity
            for x in lengths:
                used[x] += n
        assert used == Counter(counts)
    with pytest.raises(ValueError):
        plan({3000: 1})
