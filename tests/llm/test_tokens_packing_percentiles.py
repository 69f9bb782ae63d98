from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.packing import first_fit_decreasing, pack
from tessera.llm.percentiles import bisect, combine, daily_counts
from tessera.llm.tokens import decode, encode, token_counts

TEXTS = [None, "", " ", "hello world", "<|endoftext|> plain", "naïve 日本語 👩‍💻 ß", "a\r\nb\t\tc", "\u200b\ufeff", "x" * 5000, "hello world", "مرحبا"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_round_trip_and_defined_cases(docs):
    coded = encode(docs)
    assert sorted(coded.columns) == ["doc_id", "ids"]
    rows = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert rows[0] == rows[1] == [] and rows[3] == rows[9] == [31373, 995]
    assert 50256 not in rows[4]
    back = {r["doc_id"]: r["text"] for r in decode(coded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["tokens"] for r in token_counts(docs).collect()} == {i: len(x) for i, x in rows.items()}


def test_ids_agree_with_the_same_vocabulary_as_ranks(docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in encode(docs).collect():
        assert r["ids"] == other.encode_ordinary(TEXTS[r["doc_id"]] or "")


@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r\u00a0\u3000\u2028\u0085\x1c\x0b'slt aé1я中か한.,!?_-\U0001f600"), st.characters(codec="utf-8")), max_size=40), max_size=12))
@settings(max_examples=300, deadline=None)
def test_pieces_are_exact(texts):
    from tessera.llm.tokens import Pieces, _tokenizer

    tokenizer = _tokenizer("/opt/tokenizers/byte_bpe_50k.json")
    pieces = Pieces(tokenizer)
    pieces.KEPT = 5
    for _ in range(2):
        got = [np.frombuffer(r, dtype=np.int32).tolist() for r in pieces.encode(texts)]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_offsets_cover_characters(docs):
    for r in encode(docs, offsets=True).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        covered = set()
        for a, b in zip(r["starts"], r["ends"], strict=True):
            assert 0 <= a < b <= len(text)
            covered |= set(range(a, b))
        assert covered == set(range(len(text)))


def test_decoding_part_of_a_character(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 31373, 99_999_999])], "i int, ids array<int>")
    assert {r["i"]: r["text"] for r in decode(df).collect()} == {1: None, 2: "", 3: "hello"}
    ids = encode(spark.createDataFrame([(1, "👩")], "i int, text string")).first()["ids"]
    cut = decode(spark.createDataFrame([(1, ids[:1])], "i int, ids array<int>")).first()["text"]
    assert len(ids) > 1 and set(cut) == {"\ufffd"}


def test_tree_places_like_a_scan():
    rng = random.Random(3)
    for _ in range(200):
        cap = rng.randrange(1, 60)
        sizes = [rng.randrange(0, cap + 1) for _ in range(rng.randrange(0, 40))]
        bins, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, used in enumerate(bins) if used + sizes[i] <= cap), None)
            if at is None:
                bins.append(0)
                at = len(bins) - 1
            bins[at] += sizes[i]
            want[i] = at
        assert first_fit_decreasing(sizes, cap) == want


def test_packing_is_whole_and_fits(spark):
    rng = random.Random(5)
    items = [(i % 50, rng.choice([0, 1, 7, 30, 99, 100, 101, 350])) for i in range(600)] + [(1000, None), (1001, -4)]
    df = spark.createDataFrame([(a, b, "x") for a, b in items], "doc_id long, tokens long, spec_id string")
    specs = spark.createDataFrame([(1, 100), (2, 64), (3, None), (4, 0)], "spec_id long, capacity_tokens long")
    rows = pack(df, specs, group_items=200).collect()
    assert {r["spec_id"] for r in rows} == {1, 2}
    for spec, cap in ((1, 100), (2, 64)):
        mine = [r for r in rows if r["spec_id"] == spec]
        used: dict[int, int] = {}
        for r in mine:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["size"]
            assert 0 <= r["size"] <= cap and r["start"] == r["part"] * cap
        assert max(used.values()) <= cap
        assert sum(r["size"] for r in mine) == sum(max(b or 0, 0) for _, b in items)
        assert len(mine) == sum(max(1, math.ceil(max(b or 0, 0) / cap)) for _, b in items)
        together = 1 + max(first_fit_decreasing([r["size"] for r in mine], cap))
        assert len(used) <= 1.05 * together + 6
    assert pack(df.limit(0), specs).count() == 0


def test_an_item_of_any_size_fills_no_group(spark):
    items = spark.createDataFrame([(1, 1_000_003), (2, 5), (3, 10), (3, 10)], "doc_id long, tokens long")
    specs = spark.createDataFrame([(7, 10)], "spec_id long, capacity_tokens long")
    rows = pack(items, specs, group_items=1000).collect()
    assert sum(r["size"] for r in rows) == 1_000_028
    of_one = sorted((r["part"], r["start"], r["size"]) for r in rows if r["doc_id"] == 1)
    assert of_one == [*((i, 10 * i, 10) for i in range(100_000)), (100_000, 1_000_000, 3)]
    used: dict[int, int] = {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["size"]
    # 100,002 full containers, and one for the rest of 3 and the item of 5
    assert len(used) == 100_003 and max(used.values()) == 10


def test_percentiles_of_records(spark):
    rng = random.Random(9)
    rows = []
    for n in range(900):
        rows.append((rng.choice(["s", None]), 1, n, 86_400_000 * rng.randrange(5), rng.choice(["a", None]), rng.choice([None, 0, 5, 5, 5, 10**6, -3, rng.randrange(10**9), 2**62, -(2**63), 2**63 - 1])))
    rows += rows[:300]
    rows.append(("s", 1, 5000, None, "a", 7))
    df = spark.createDataFrame(rows, "session_id string, pid long, sequence long, at long, tool string, ms long").withColumnRenamed("at", "t")
    args = (["session_id", "pid", "sequence"], "t", ["tool"], ["ms"])
    whole = daily_counts(df, *args)
    parts = combine(*(daily_counts(df.where(f"t = {d * 86_400_000}"), *args) for d in range(5)))
    # the days' tables need not be added up: the same value may stand in many rows
    apart = daily_counts(df.where("t < 2 * 86400000L"), *args).unionByName(daily_counts(df.where("t >= 2 * 86400000L"), *args))
    for daily in (whole, parts, apart.drop("day")):
        for r in bisect(daily, ["tool"], [50, 95, 99, 0]).collect():
            mine = sorted(x[5] for x in set(rows) if x[4] == r["tool"] and x[5] is not None and x[3] is not None)
            exact = mine[max(1, math.ceil(len(mine) * r["percent"] / 100)) - 1]
            assert r["n"] == len(mine)
            assert (r["value"], r["error_bound"]) == (exact, 0)
    assert bisect(whole.limit(0), ["tool"], [50]).count() == 0
