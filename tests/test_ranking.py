from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking as K
from tessera.plans.ranking_queries import packed_batches
from tessera.queries import core_queries

SF = "/root/testdata/sf0.001"


def test_greedy_diversity_in_mixed_directories(spark):
    rng = random.Random(12)
    rows = [(q, 100 * q + i, f"/r/d{rng.randrange(4)}/f{i}", rng.choice(["tabular", "source", "text"]), round(rng.choice([0.02, 0.019, 0.5, 1.5]) + rng.random() / 100, 6)) for q in range(3) for i in range(30)]
    hits = spark.createDataFrame(rows, "query_id long, file_id long, path string, kind string, score double")
    got = sorted((r["query_id"], r["rank"], r["file_id"]) for r in K.diversify_progressively(hits, 12).collect())
    want = []
    for q in range(3):
        left = [r for r in rows if r[0] == q]
        step = max(0.1 * max(r[4] for r in left if r[4] < 0.5), 0.00125)
        taken: list[str] = []
        for n in range(12):
            cost = lambda r: step * taken.count(r[2][:5]) if r[3] == "tabular" else 0.00125 * min(1, taken.count(r[2][:5]))  # noqa: B023, E731
            pick = min(left, key=lambda r: (-(r[4] - cost(r)), r[2]))
            left.remove(pick)
            taken.append(pick[2][:5])
            want.append((q, n + 1, pick[1]))
    assert got == want


def test_previews_share_a_budget(spark):
    texts = ["a" * 900 + "needle" + "b" * 900, "short", "", "c" * 5000, "needle first" + "d" * 400]
    hits = spark.createDataFrame([(1, i + 1, i, "find the needle", t) for i, t in enumerate(texts)], "query_id long, rank long, file_id long, query string, preview string")
    got = {r["rank"]: r["preview"] for r in K.budgeted_previews(hits, 1000).collect()}
    # the floor is 128: the first may take 1000 - 4 * 128, from a third of that before the word
    assert got[1] == texts[0][900 - 488 // 3 :][:488] and got[2] == "short" and got[3] == ""
    assert got[4] == "c" * (1000 - 488 - 5 - 128) and got[5] == texts[4][:128] and sum(map(len, got.values())) == 1000
    assert K.budgeted_previews(hits.limit(0), 10).count() == 0


def test_copies_are_put_away_and_linked(spark):
    rows = [
        (1, 1, "/a/x.py", "h", 3.0, True), (1, 2, "/b/x.py", "h", 2.0, True), (1, 3, "/c/x.py", "g", 1.5, True), (1, 4, "/d/x.py", None, 1.0, True),
        (1, 5, "/e/y.py", "h", 1.0, True), (1, 6, "/f/x.py", "h", 9.0, False), (2, 1, "/a/x.py", "h", 3.0, True),
    ]
    hits = spark.createDataFrame(rows, "query_id long, file_id long, path string, content_hash string, score double, identified boolean")
    got = {(r["query_id"], r["file_id"]): [(x["path"], x["relationship"]) for x in r["alternatives"]] for r in K.collapse_identified(hits).collect()}
    assert got == {
        (1, 1): [("/b/x.py", "identical_content"), ("/c/x.py", "different_content"), ("/d/x.py", "content_unverified")],
        (1, 3): [("/a/x.py", "different_content"), ("/d/x.py", "content_unverified")],
        (1, 4): [("/a/x.py", "content_unverified"), ("/c/x.py", "content_unverified")],
        (1, 5): [], (1, 6): [], (2, 1): [],
    }


def test_every_reason_is_told(spark):
    asked = [
        ("anchor", "/ws/a/../b", "unresolved_path"), ("anchor", "/else/x.py", "outside_indexed_roots"), ("anchor", "x.py", "not_returned"), ("anchor", "/ws/a/.git/x", "excluded_by_policy"), ("anchor", "/ws/a/k.pem", "excluded_by_policy"),
        ("anchor", "/ws/a/link/x.py", "symlink_not_followed"), ("anchor", "/ws/a/in.py", "indexed_not_returned"), ("anchor", "/ws/a/build/o.py", "ignored"), ("anchor", "/ws/a/there.py", "present_not_indexed"), ("anchor", "/ws/a/gone.py", "not_returned"),
        ("context", "/ws/a", None), ("context", "/nowhere", "context_unavailable"), ("root", "/ws", None), ("root", "/gone", "root_unavailable"), ("root", "/other", "root_outside_indexed_roots"), ("none", None, "no_matching_evidence"),
    ]
    df = spark.createDataFrame([(i, w, p) for i, (w, p, _) in enumerate(asked)], "request_id long, what string, path string")
    of = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    found = K.diagnose(df, of("/ws/a", "/ws"), of("/ws/a/in.py"), of("/ws/a/in.py", "/ws/a/there.py", "/other/x"), of("/ws/a/link"), "^build/|/build/")
    got = {r["request_id"]: r["reason"] for r in found.collect()}
    assert got == {i: reason for i, (_, _, reason) in enumerate(asked) if reason} | {1: "outside_indexed_roots"}
    assert set(got.values()) == set(K.REASONS)


def test_note_boosts(spark):
    def boost(query, file="n.md", entry=None, about=None, layer="memory_note", owned=False, age=0.0, **more):
        lit = lambda v: F.lit(v).cast("string") if v is None else F.lit(v)
        return spark.range(1).select(K.memory_boost(F.lit(query), lit(file), lit(entry), lit(about), F.lit(layer), F.lit(owned), F.lit(age), **more).alias("b")).first()["b"]

    assert boost("what") == pytest.approx(0.01 + 0.004 + 0.005)
    assert boost("see deploy notes now", file="deploy_notes.md", owned=True, age=30.0) == pytest.approx(0.08 + 0.004 + 0.0025 + 0.25)
    assert boost("the deploy plan", entry="Deploy", about="a plan to deploy", layer="topic_summary") == pytest.approx(0.01 + 0.016 + 0.005 + 0.22 + 0.04 * 2 / 3)
    assert boost("parse_file", layer="project_summary") == pytest.approx(0.01 + 0.02 + 0.005 - 0.08)
    assert boost("deploy", about="deploy", all_kinds=True) == pytest.approx(0.1 * (0.01 + 0.004 + 0.005 + 0.04))


def test_own_checkout(spark):
    hits = spark.createDataFrame([(1, "/ws/a/x.py", "source", "path,exact_path", 1.0), (1, "/ws/ab/x.py", "source", "exact_path", 1.0), (1, "/ws/a/t.md", "text", "exact_path", 1.0), (1, "/ws/a/y.py", "source", "path", 1.0), (2, "/ws/a/x.py", "source", "exact_path", 1.0)], "query_id long, path string, kind string, lanes string, score double")
    contexts = spark.createDataFrame([(1, "/ws/a/src/q.py"), (2, "/else")], "query_id long, context string")
    got = {(r["query_id"], r["path"]): r["score"] for r in K.own_checkout_boost(hits, contexts, spark.createDataFrame([("/ws/a",), ("/ws",)], "root string").where("root <> '/ws'")).collect()}
    assert got == {(1, "/ws/a/x.py"): 1.15, (1, "/ws/ab/x.py"): 1.0, (1, "/ws/a/t.md"): 1.0, (1, "/ws/a/y.py"): 1.0, (2, "/ws/a/x.py"): 1.0}


def test_batches_are_bounded_and_in_order(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice([300, 60_000, 1 << 20, 3 << 20])) for i in range(400)]
    got = {r["file_id"]: r["batch"] for r in packed_batches(spark.createDataFrame(docs, "file_id long, bytes long")).collect()}
    size = dict(docs)
    runs: dict[int, list[int]] = {}
    for i in sorted(got):
        runs.setdefault(got[i], []).append(i)
    order = sorted(runs)
    assert [i for b in order for i in runs[b]] == list(range(400))
    assert all(len(r) <= 32 and (len(r) == 1 or sum(size[i] for i in r) <= 8 << 20) for r in runs.values())
    short = sum(len(runs[a]) < 32 and sum(size[i] for i in runs[a]) + size[runs[b][0]] <= 8 << 20 for a, b in zip(order, order[1:], strict=False))
    assert short <= 8  # only at the end of a range


def test_queries_without_a_twin(spark):
    run = lambda name, sf=SF: core_queries()[name](spark, sf)
    exact = {r["l_returnflag"]: r for r in spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)").alias("median")).collect()}
    near = {r["l_returnflag"]: r for r in run("sql_approx").collect()}
    assert near.keys() == exact.keys()
    for k, r in near.items():
        assert r["parts"] == pytest.approx(exact[k]["parts"], rel=0.15) and r["median"] == pytest.approx(exact[k]["median"], rel=0.02)
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert 0.05 * orders < run("sql_sample").agg(F.sum("n")).first()[0] < 0.15 * orders
    shown = [json.loads(r["row"]) for r in run("value_to_json").limit(50).collect()]
    assert all(isinstance(r["l_orderkey"], int) and isinstance(r["l_quantity"], float) and len(r["l_shipdate"]) == 10 for r in shown)
    ci = run("ab_bootstrap_ci", "/root/testdata/sf0.01").first()
    from tessera.plans.registry import Tables
    from tessera.plans.telemetry_queries import _pairs

    mean = _pairs(Tables(spark, "/root/testdata/sf0.01")).agg(F.avg(F.col("a_ms") - F.col("b_ms"))).first()[0]
    assert ci["low"] < mean < ci["high"]
    assert run("batch_pack").groupBy("batch").count().agg(F.max("count")).first()[0] <= 32
    kept = run("redact_value").select("arguments").distinct().collect()
    assert kept and all(r[0] is None or json.loads(r[0]) is not None for r in kept)
