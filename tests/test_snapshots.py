from __future__ import annotations

import random

import pytest

from tessera.operators.snapshots import snapshot_changes

SCHEMA = "publish_dir string, generation long, files array<struct<path: string, size_bytes: long, blake3: string>>, extra string"


def brute(rows):
    snaps = {}
    for owner, version, files, _ in rows:
        if files is None or version is None:
            continue
        entries = snaps.setdefault((owner, version), {})
        for f in files:
            if f is None or f[0] is None:
                continue
            mark = None if f[2] is None else f[2].lower()
            old = entries.get(f[0], mark)
            entries[f[0]] = mark if old is None else old if mark is None else min(old, mark)
    out = set()
    for owner in {o for o, _ in snaps}:
        versions = sorted(v for o, v in snaps if o == owner)
        for a, b in zip(versions, versions[1:], strict=False):
            old, new = snaps[owner, a], snaps[owner, b]
            for p in old.keys() | new.keys():
                if p not in old:
                    out.add((owner, b, p, "added"))
                elif p not in new:
                    out.add((owner, b, p, "removed"))
                elif old[p] != new[p]:
                    out.add((owner, b, p, "changed"))
    return out


def found(spark, rows, **options):
    df = snapshot_changes(spark.createDataFrame(rows, SCHEMA), **options)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_defined_cases(spark):
    rows = [
        ("a", 1, [("x", 1, "AB"), ("y", 1, None), ("z", 1, "c1"), ("z", 1, "c1"), (None, 1, "q")], "e"),
        ("a", 3, [("y", 2, None), ("x", 9, "ab"), ("w", 1, "d")], "e"),
        ("a", 3, [("w", 1, "D"), ("x", 9, "ab"), ("y", 2, None)], None),
        ("a", 2, None, "e"),
        ("a", 5, [], "e"),
        ("a", None, [("n", 1, "1")], "e"),
        (None, 1, [("x", 1, "1")], "e"),
        (None, 2, [("x", 1, None)], "e"),
    ]
    assert found(spark, rows) == brute(rows) == {
        ("a", 3, "z", "removed"), ("a", 3, "w", "added"), ("a", 5, "w", "removed"), ("a", 5, "x", "removed"), ("a", 5, "y", "removed"), (None, 2, "x", "changed"),
    }


def test_empty(spark):
    assert found(spark, []) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_with_small_chunks_and_batches(spark, seed):
    rng = random.Random(seed)
    rows = []
    for owner in ("hot", "b"):
        state = {f"p{i:04d}": str(rng.randrange(9)) for i in range(300 if owner == "hot" else 20)}
        for version in range(6):
            for p in rng.sample(sorted(state), 8):
                state[p] = rng.choice(["1", "A", "a", None, str(rng.randrange(99))])
            for p in rng.sample(sorted(state), 3):
                del state[p]
            state[f"q{version}{rng.randrange(999)}"] = "n"
            files = [(p, 1, m) for p, m in state.items()]
            rng.shuffle(files)
            rows.append((owner, version * 2, files + files[:5], None))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert found(spark, rows, chunk_rows=4) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
