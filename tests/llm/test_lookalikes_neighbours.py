from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tessera.llm.lookalikes import Speller, folded, same_looking_classes, same_looking_pairs
from tessera.llm.neighbours import similar_pairs

BASE = "The schema of a café cost 5 μm"
SAME = [
    BASE,
    BASE,
    "Тhe sсhemа оf а сafé соst 5 μm",  # Cyrillic
    "The schema of a cafe\u0301 cost\u00a05 \u00b5m",
    "Ｔｈｅ　ｓｃｈｅｍａ of a\u200b ca\u00adfé cost 5 μm\ufeff",
    "The ѕchema οf a ϲafé ⅽost 5 μⅿ",
]
OTHER = ["The schema of a cafe cost 5 μm", "the schema of a café cost 5 μm", "The schema of a café cost ⁵ μm", "The schema of a café cost ⑤ μm", "The schema  of a café cost 5 μm", "The sсhemes of a café cost 5 μm"]
NONE = [None, "", "  \n", "\u200b\u00ad", "\u00a0"]


def test_pairs_against_the_known_groups(spark):
    texts = SAME + OTHER + NONE + ["👩\u200d💻 ok", "👩💻 ok", "x" * 20_000 + "а", "x" * 20_000 + "a"]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    want = {(a, b) for a, b in itertools.combinations(range(len(SAME)), 2) if SAME[a] != SAME[b]} | {(len(texts) - 2, len(texts) - 1)}
    got = [tuple(r) for r in same_looking_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert same_looking_pairs(df.limit(0)).count() == 0
    classes = {r["doc_id"]: (r["class_id"], r["links"]) for r in same_looking_classes(df).collect()}
    assert classes == {i: (0 if i < len(SAME) else len(texts) - 2, sum(i in p for p in want)) for i in {x for p in want for x in p}} and same_looking_classes(df.limit(0)).count() == 0


def test_the_usual_spelling_of_the_corpus_is_chosen(spark):
    from tessera.llm.lookalikes import consistent_forms

    usual = ["The catalog of sources", "Каталог исходных текстов", "Ο κατάλογος των πηγών"]
    mixed = ["Тhе cаtаlоg оf ѕоurсеѕ", "Kaтaлoг иcxoдныx тeкcтoв", "Ｔｈｅ catalog of sources"]
    docs = [(i, t) for i, t in enumerate(usual * 20)] + [(100 + i, t) for i, t in enumerate(mixed)]
    got = {r["doc_id"]: r["form"] for r in consistent_forms(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True).collect()}
    # the letters most likely in the corpus, of one script a word, whichever were given
    assert [got[100], got[101], got[102]] == [usual[0], usual[1], usual[0]] and [got[i] for i in range(3)] == usual


def test_spelling_does_not_depend_on_the_letters_given():
    counts = {("c", "o"): 9, ("o", "d"): 9, ("d", "e"): 9, ("\0", "c"): 9, ("e", "\0"): 9, ("с", "о"): 1}
    speller = Speller(counts)
    forms = {speller.viterbi("".join(x)) for x in itertools.product("cсϲ", "oоο", "dԁⅾ", "eе")}
    assert forms == {"code"}
    assert folded("ⅷ ½ ①") == "viii ½ ①"


@pytest.mark.parametrize("copies", [1, 40])
def test_neighbours_against_brute_force(spark, copies):
    rng = np.random.default_rng(4)
    rows, dims = [], 96
    for c in range(25):
        centre = rng.normal(size=dims)
        for m in range(int(rng.integers(1, 14))):
            rows.append((f"c{c:02d}m{m:02d}", (centre + 0.25 * rng.normal(size=dims)).astype(np.float32).tolist()))
    rows += [(f"n{i:03d}", rng.normal(size=dims).astype(np.float32).tolist()) for i in range(60)]
    same = rows[3][1]
    rows += [(f"a{i:03d}", same) for i in range(copies)] + [(f"t{i}", [2 * x for x in same]) for i in range(3)]
    usable = {k: np.array(v, dtype=np.float64) for k, v in rows}
    bad = [("b0", None), ("b1", []), ("b2", [1.0] * 48), ("b3", [0.0] * dims), ("b4", [float("nan")] * dims), ("b5", [float("inf")] + [1.0] * 95), (None, same)]
    given = rows + rows[:30] + bad
    random.Random(1).shuffle(given)
    df = spark.createDataFrame([(k, v, "p") for k, v in given], "chunk_id string, vector array<float>, id string").repartition(3)
    ids = sorted(usable)
    x = np.array([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    cos = np.round(x @ x.T, 10)
    want = set()
    for a, row in enumerate(cos):
        near = sorted((-s, ids[b]) for b, s in enumerate(row) if b != a and s >= 0.8)[:5]
        want |= {tuple(sorted((ids[a], other))) for _, other in near}
    got = [tuple(r) for r in similar_pairs(df, leaf_rows=40, recall=1.0).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & want) >= 0.98 * len(want) and len(set(got) - want) <= 0.03 * len(want)
    assert similar_pairs(df.limit(0)).count() == 0


def test_a_dense_group_over_many_leaves_reaches_the_recall(spark):
    from tessera.llm.neighbours import FIRST_VISITS, search_quality, similar_vectors

    rng = np.random.default_rng(6)
    x = rng.normal(size=96) + 0.2 * rng.normal(size=(600, 96))
    rows = [(f"d{i:03d}", v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "chunk_id string, vector array<float>").repartition(3)
    assert len(rows) // 2 > 2 * FIRST_VISITS  # leaves
    u = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -1)
    want = {(rows[i][0], rows[j][0]) for i, row in enumerate(cos) for j in np.argsort(-row)[:5]}
    got = {(r["id"], r["other"]) for r in similar_vectors(df, leaf_rows=2).collect()}
    assert len(got & want) >= 0.985 * len(want)
    quality = search_quality(df, leaf_rows=2).first()
    assert quality["rows"] == 600 and quality["calibrated"] >= 0.985 and quality["held_out"] >= 0.95 and quality["visits"] >= FIRST_VISITS


def test_a_vector_on_a_third_of_all_rows(spark):
    from tessera.llm.neighbours import similar_vectors

    rng = np.random.default_rng(2)
    shared = rng.normal(size=96)
    rows = [(f"s{i:05d}", shared.astype(np.float32).tolist()) for i in range(2000)]
    rows += [(f"r{i:05d}", (rng.normal(size=96) if i % 2 else shared + 0.2 * rng.normal(size=96)).astype(np.float32).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "chunk_id string, vector array<float>").repartition(4)
    found: dict[str, list[str]] = {}
    for r in similar_vectors(df).collect():
        found.setdefault(r["id"], []).append(r["other"])
    # the smallest other ids of the same vector, whichever of its ids asks; those near it find the same five
    assert all(sorted(found[f"s{i:05d}"]) == [f"s{n:05d}" for n in range(6) if n != i][:5] for i in range(2000))
    near = [i for i in range(0, 4000, 2) if sorted(found.get(f"r{i:05d}", [])) == [f"s{n:05d}" for n in range(5)]]
    assert len(near) >= 1900


def test_sizes_of_settings():
    from tessera.llm.neighbours import _bytes

    assert [_bytes(x) for x in ("67108864b", "8m", "64MB", "1 g", "12")] == [67108864, 8 << 20, 64 << 20, 1 << 30, 12]
