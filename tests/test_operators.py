from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import retrieval as R
from tessera.operators.catalog import classify_changes, latest, upsert
from tessera.operators.content import current_content
from tessera.operators.extract import agent_metadata, chunk_lines, json_key_paths, redact_json, sql_sections, symbols_of
from tessera.operators.joins import asof_join, longest_prefix_owner, range_join
from tessera.sources.files import bounded_sql, scan_tolerant_jsonl


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_asof_keeps_every_left_row(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 1, "b"), ("k", 2, "c"), ("m", 9, "d"), (None, 3, "e"), ("k", None, "f")], "k string, t int, name string")
    right = spark.createDataFrame([("k", 2, 7), ("k", 4, 8), ("k", 4, 6), ("m", 10, 9), (None, 1, 1)], "k string, t int, v int")
    got = {r["name"]: r["v"] for r in asof_join(left, right, "k", "t", "v").collect()}
    assert got == {"a": 8, "b": None, "c": 7, "d": None, "e": None, "f": None}


def test_ranges_number_and_fill_a_hot_group(spark):
    import random

    from tessera.operators.ranges import filled, numbered

    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(5000)]), rng.choice([None, None, None, n])) for n in range(4000)]
    df = spark.createDataFrame([(k, t, v, i) for i, (k, t, v) in enumerate(rows)], "k string, t int, v int, i int")
    for k in ("hot", "a", "b", None):
        mine = sorted(((-1 if t is None else t, i, v) for i, (g, t, v) in enumerate(rows) if g == k))
        got = {r["i"]: (r["place"], r["size"]) for r in numbered(df, ["k"], ["t", "i"]).where(F.col("k").eqNullSafe(F.lit(k))).collect()}
        assert got == {i: (n, len(mine)) for n, (_, i, _) in enumerate(mine, 1)}
        last, want = None, {}
        for _, i, v in mine:
            last = last if v is None else v
            want[i] = last
        assert {r["i"]: r["last"] for r in filled(df, "k", ["t", "i"], "v").where(F.col("k").eqNullSafe(F.lit(k))).collect()} == want
    assert numbered(df.limit(0), ["k"], ["t"]).count() == 0 and filled(df.limit(0), "k", ["t"], "v").count() == 0


def test_range_join_is_the_nested_loop(spark):
    a = spark.createDataFrame([(i, i * 7 % 50) for i in range(30)], "i int, at int")
    b = spark.createDataFrame([(j, j * 11 % 50) for j in range(30)], "j int, bt int")
    got = {(r["i"], r["j"]) for r in range_join(a, b, "at", "bt", 4).collect()}
    assert got == {(i, j) for i in range(30) for j in range(30) if abs(i * 7 % 50 - j * 11 % 50) <= 4}


def test_longest_prefix_owner(spark):
    paths = spark.createDataFrame([("/a/b/c.py",), ("/a/bc/d",), ("/x",), ("/a/b",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b",)], "root string")
    assert {r["path"]: r["root"] for r in longest_prefix_owner(paths, roots).collect()} == {"/a/b/c.py": "/a/b", "/a/bc/d": "/a", "/x": None, "/a/b": "/a/b"}


def test_change_classes(spark):
    old = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 1, "h"), ("d", 1, None), ("e", 1, "h")], "path string, size int, hash string")
    new = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("c", 1, "g"), ("d", 1, None), ("f", 1, "h")], "path string, size int, hash string")
    got = {r["path"]: r["state"] for r in classify_changes(old, new, ["path"]).collect()}
    assert got == {"a": "unchanged_meta", "b": "unchanged_hash", "c": "modified", "d": "unchanged_meta", "e": "deleted", "f": "added"}
    assert {r["path"] for r in upsert(old, new, ["path"]).collect()} == set("abcdef")
    assert latest(old.unionByName(new), ["path"], ["size"]).where("path = 'b'").first()["size"] == 2


def test_anchors_and_terms(spark):
    assert one(spark, X.filename_anchors(F.lit("v1.5 https://h/x.py 0.95"))) == []
    assert one(spark, X.filename_anchors(F.lit("`src/main.rs` config.yaml"))) == ["src/main.rs", "config.yaml"]
    assert one(spark, X.query_symbol_terms(F.lit("where is parse_file used"))) == ["parse_file"]
    assert one(spark, X.query_symbol_terms(F.lit("render"))) == ["render"]
    assert one(spark, X.lexical_tokens(F.lit("Abc12-abc x9"))) == ["abc", "12", "x", "9"]
    assert one(spark, X.path_extension(F.lit("/a/.bashrc"))) is None
    assert one(spark, X.classify_kind(F.lit("/a/SKILL.md"))) == "agent_skill"
    assert one(spark, X.normalize_client(F.lit("Codex_CLI 0.9"))) == "codex"
    assert one(spark, X.normalize_client(F.lit("  My Tool! "))) == "my-tool"
    assert one(spark, X.redact_text(F.lit('password = "abc def", Bearer abcdefgh123'))) == "password = [REDACTED], Bearer [REDACTED]"


def test_directory_diversity(spark):
    hits = spark.createDataFrame([(1, "/a/first", 0.1, "h1"), (1, "/a/second", 0.096, "h2"), (1, "/b/third", 0.0955, "h3")], "query_id long, path string, score double, content_hash string")
    assert [r["path"] for r in R.diversify(hits, 2).orderBy("rank").collect()] == ["/a/first", "/b/third"]


def test_copies_collapse_by_name_and_content(spark):
    rows = [(1, "/a/x", "x", "h", 3.0), (1, "/b/x", "x", "h", 2.0), (1, "/c/x", "x", "g", 1.0), (1, "/d/x", "x", None, 1.0), (1, "/e/x", "x", None, 1.0)]
    hits = spark.createDataFrame(rows, "query_id long, path string, name string, content_hash string, score double")
    assert {(r["path"], r["copies"]) for r in R.collapse_copies(hits).collect()} == {("/a/x", 2), ("/c/x", 1), ("/d/x", 1), ("/e/x", 1)}


def test_bm25_handles_empty_and_null(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", None, "", "beta beta gamma", "delta", "x", "y", "z", "w", "v", "u"])], "file_id long, content string")
    queries = spark.createDataFrame([(1, "beta"), (2, None), (3, "")], "query_id long, query string")
    got = R.bm25_lane(docs, queries, F.col("content"), 5).orderBy("rank").collect()
    assert [(r["query_id"], r["file_id"]) for r in got] == [(1, 3), (1, 0)]


def test_current_content_takes_the_files_generation(spark):
    files = spark.createDataFrame([(1, 9, "PY", "source", "a.py", 2, False), (1, 9, "PY", "source", "a.py", 2, False), (2, 9, "md", "text", "b", 1, True)], "id long, root_id long, extension string, kind string, relative_path string, generation long, deleted boolean")
    at = dt.datetime(2026, 1, 1)
    docs = spark.createDataFrame([(1, 1, at, "old"), (1, 2, at, "new"), (1, 2, at, "new"), (2, 1, at, "gone")], "file_id long, generation long, indexed_at timestamp, content string")
    assert [tuple(r) for r in current_content(files, docs).select("file_id", "extension", "content").collect()] == [(1, "py", "new")]


def test_front_matter(spark):
    texts = ["---\nname: deploy\ndescription: \"how  to\"\n---\n# Head\nsee [x](b.md#y) and [y](https://z)", "", "# only ##", "---\nname: a\nodd line\n---\nx", "---\nname: never closed"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("path", F.lit("/p"))
    got = {r["doc_id"]: r for r in agent_metadata(docs, "doc_id", "path", "text").collect()}
    assert (got[0]["name"], got[0]["description"], got[0]["headings"], got[0]["links"]) == ("deploy", "how to", ["Head"], ["b.md"])
    assert [got[i]["status"] for i in range(5)] == ["parsed", "no_frontmatter", "no_frontmatter", "malformed", "no_frontmatter"]
    assert got[2]["headings"] == ["only"] and got[3]["name"] is None


def test_sql_sections_follow_statements_and_named_queries(spark):
    script = "WITH\na AS (\n  SELECT ';(' FROM t -- (\n),\nb AS (\nSELECT 1\n)\nSELECT * FROM a\nINSERT INTO x\nSELECT 2\nCREATE TABLE y"
    sql = spark.createDataFrame([(1, script), (2, None), (3, ""), (4, "  \n")], "file_id long, content string")
    got = [(r["file_id"], r["part"], r["body"]) for r in sql_sections(sql).orderBy("file_id", "part").collect()]
    assert got == [(1, 0, "WITH\na AS (\n  SELECT ';(' FROM t -- (\n),"), (1, 1, "b AS (\nSELECT 1\n)"), (1, 2, "SELECT * FROM a"), (1, 3, "INSERT INTO x\nSELECT 2"), (1, 4, "CREATE TABLE y")]


def test_chunks_are_runs_of_lines(spark):
    plain = [f"line {i} " + "x" * (i % 70) for i in range(300)]
    with_heads = [("def f" if i % 9 == 0 else "  y") + str(i) + "z" * 40 for i in range(200)]
    texts = ["\n".join(plain), "\r\n".join(with_heads) + "\n", "", "short", None, " \n\n", "w" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    got: dict[int, list[str]] = {}
    for r in chunk_lines(docs).orderBy("file_id", "part").collect():
        got.setdefault(r["file_id"], []).append(r["body"])
    assert set(got) == {0, 1, 3, 6} and got[3] == ["short"] and got[6] == ["w" * 9000, "w" * 9000]
    for n, lines in ((0, plain), (1, with_heads)):
        at = 0
        for k, body in enumerate(got[n]):
            part = body.split("\n")
            start = next(i for i in range(len(lines)) if lines[i].strip() == part[0].strip() and i >= at)
            assert [x.strip() for x in lines[start : start + len(part)]] == [x.strip() for x in part]
            stop = start + len(part)
            size = sum(len(x) + 1 for x in lines[start:stop])
            if stop < len(lines):
                # cut at twice the size, or before a structure once the size is reached
                assert size >= 3600 and size - len(lines[stop - 1]) - 1 < 3600 or size >= 1800 and lines[stop].startswith("def ")
            if k:
                assert start == at
            at = max(start, stop - 3)
        assert stop == len(lines)


def test_symbols_of_lines(spark):
    code = [
        (1, "py", "import os\nclass A:\n    def f(self):\n        pass\n\n    x = 1\ny = A()\n"),
        (2, "go", 'package p\nimport "fmt"\ntype T struct {\n}\nfunc (a *T) Run() {\n\tfmt.Println(go(1))\n}\n'),
        (3, "rs", "use std::fs;\n// fn no() {}\npub(crate) async fn go<T>(x: T) {\n    run(x);\n}\nstruct S;\n"),
        (4, "js", "function f() {}"),
        (5, "py", None),
    ]
    df = spark.createDataFrame(code, "file_id long, extension string, content string")
    got = {(r["file_id"], r["kind"], r["name"], r["line_start"], r["line_end"]) for r in symbols_of(df).collect()}
    assert got == {
        (1, "import", "os", 1, 1), (1, "class", "A", 2, 6), (1, "function", "f", 3, 4),
        (2, "import", '"fmt"', 2, 2), (2, "type", "T", 3, 4), (2, "method", "Run", 5, 7), (2, "call", "fmt.Println", 6, 6),
        (3, "import", "std::fs", 1, 1), (3, "function", "go", 3, 5), (3, "call", "run", 4, 4), (3, "struct", "S", 6, 6),
    }


def test_json_key_paths(spark):
    texts = ['{"a": {"b": {"c": {"d": {"e": 1}}}}, "l": [{"x": 1}, {"y": 2}]}', "no", None, "[]", json.dumps({f"k{i:03}": i for i in range(90)})]
    got: dict[int, set[str]] = {}
    for r in json_key_paths(spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")).collect():
        got.setdefault(r["file_id"], set()).add(r["key_path"])
    assert got == {0: {"a", "a.b", "a.b.c", "a.b.c.d", "l", "l[].x"}, 4: {f"k{i:03}" for i in range(80)}}


def test_redacted_json(spark):
    deep = {"a": {"b": {"c": {"d": {"e": 1, "client-secret": "s"}}}}}
    cases = [
        ({"query": "authorization: Bearer abcdefghijk token=top-secret sk-abcdefghijk"}, {"query": "authorization: [REDACTED] token=[REDACTED]"}),
        ({"note": 'password=hunter2xyz, api_key: "a b"'}, {"note": "password=[REDACTED], api_key: [REDACTED]"}),
        ({"API-Key": {"x": 1}, "my_token": 3, "tokens": 4}, {"API-Key": "[REDACTED]", "my_token": "[REDACTED]", "tokens": 4}),
        (deep, {"a": {"b": {"c": {"d": {"e": "[TRUNCATED:depth]", "client-secret": "[REDACTED]"}}}}}),
        (list(range(18)), [*range(16), {"omitted_items": 2}]),
        ({f"f{i:02}": i for i in range(34)}, {**{f"f{i:02}": i for i in range(32)}, "_omitted_fields": 2}),
        ({"t": "y" * 2050}, {"t": "y" * 2048 + "[TRUNCATED]"}),
        (None, None),
        ("Bearer abcdefghij", "Bearer [REDACTED]"),
    ]
    args = spark.createDataFrame([*((i, json.dumps(given)) for i, (given, _) in enumerate(cases)), (90, "oops"), (91, None), (92, "[" * 100_000)], "i int, j string")
    red = {r["i"]: r["j"] for r in redact_json(args, "j").collect()}
    assert [json.loads(red[i]) for i in range(len(cases))] == [want for _, want in cases]
    assert red[90] is None and red[91] is None and red[92] is None


def test_cut_at_bytes_keeps_characters(spark):
    for text in ("abc", "aé", "ab日本", "x👩y", ""):
        for most in range(4, 9):
            want = text.encode()[:most].decode(errors="ignore")
            assert one(spark, X.cut_bytes(F.lit(text), most)) == want, (text, most)


def test_folding_goes_on_after_a_restart(spark, tmp_path):
    from tessera.streaming.events import drained_batches, fold_queue

    schema = "key long, received timestamp, priority int"
    source = tmp_path / "in"
    at = dt.datetime(2026, 1, 1)
    for n, rows in enumerate([[(1, at, 0), (2, at, 1)], [(1, at, 2)]]):
        # a new query each time, which knows of the first only what is on disk
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        state = drained_batches(spark.readStream.schema(schema).parquet(str(source)), "queue", fold_queue, base=str(tmp_path / "fold"))
        got = {r["key"]: (r["revision"], r["priority"]) for r in state.collect()}
        assert got == [{1: (1, 0), 2: (1, 1)}, {1: (2, 2), 2: (1, 1)}][n]


def test_a_cluster_must_name_a_shared_folder(spark):
    from types import SimpleNamespace

    from tessera.session import shared_folder, work_folder

    no_folder = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: no_folder))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(_jsc=jsc, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(cluster)
    assert work_folder(spark) == work_folder(spark)


def test_bounded_sql(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "metrics.csv").write_text("model,score\na,0.5\nb,0.9\nc,0.7\n")
    (tmp_path / "out.csv").write_text("x\n1\n")
    inputs, roots = {"Metrics": str(tmp_path / "in" / "metrics.csv")}, [str(tmp_path / "in")]
    got = bounded_sql(spark, "SELECT model FROM metrics ORDER BY score DESC;", inputs, roots, max_rows=1)
    assert (got.rows, got.truncated) == ([("b",)], True)
    assert bounded_sql(spark, "SELECT model FROM metrics ORDER BY 1", inputs, roots, max_bytes=12).rows == [("a",), ("b",)]
    fine = [
        "WITH top AS (SELECT * FROM metrics WHERE score > 0.6), more AS (SELECT * FROM top) SELECT count(*) FROM more",
        "SELECT (SELECT count(*) FROM metrics WHERE score > 0.6) -- parquet.`/etc`",
        "SELECT count(*) FROM metrics WHERE model IN (SELECT model FROM metrics WHERE score > 0.6) AND EXISTS (SELECT 1 FROM `metrics`)",
        "VALUES (2)",
        "SELECT 'reflect(' || '' AS n, 2 FROM metrics LIMIT 1",
        "SELECT sum(n) FROM (SELECT 1 AS n UNION ALL SELECT 1)",
        "SELECT row_number() OVER (ORDER BY score) FROM metrics ORDER BY 1 LIMIT 1 OFFSET 1",
    ]
    for text in fine:
        assert bounded_sql(spark, text, inputs, roots).rows[0][-1] == 2, text
    bad = [
        "CREATE TABLE x AS SELECT 1",
        "INSERT INTO metrics SELECT 1",
        "SET spark.sql.ansi.enabled = false",
        "EXECUTE IMMEDIATE 'SELECT 1'",
        f"SELECT * FROM parquet.`{tmp_path}`",
        f"SELECT * FROM `csv` . `{tmp_path}/out.csv`",
        f"SELECT * FROM /* x */ `csv`/**/.`{tmp_path}/out.csv`",
        f"SELECT * FROM metrics WHERE score > (SELECT max(x) FROM csv.`{tmp_path}/out.csv`)",
        f"SELECT * FROM metrics WHERE EXISTS (SELECT 1 FROM csv.`{tmp_path}/out.csv`)",
        f"SELECT * FROM metrics WHERE model IN (SELECT _c0 FROM csv.`{tmp_path}/out.csv`)",
        f"WITH a AS (SELECT * FROM csv.`{tmp_path}/out.csv`) SELECT * FROM a",
        f"SELECT * FROM metrics, LATERAL (SELECT * FROM csv.`{tmp_path}/out.csv`)",
        "SELECT * FROM other",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
        "SELECT * FROM default.metrics",
        "SELECT * FROM IDENTIFIER('metrics')",
        "SELECT * FROM range(3)",
        "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
        "SELECT `try_reflect`('java.lang.System', 'getenv', 'HOME')",
        "SELECT JAVA_METHOD /* x */ ('java.lang.System', 'getenv', 'HOME') FROM metrics ORDER BY 1",
        "SELECT transform(array(1), x -> reflect('java.lang.System', 'getenv', 'HOME'))",
        "SELECT model FROM metrics GROUP BY model HAVING input_file_name() <> ''",
        "SELECT TRANSFORM(model) USING 'cat' FROM metrics",
        "SELECT 1; SELECT 2",
        "",
    ]
    for text in bad:
        with pytest.raises(ValueError, match="only SELECT|no query"):
            bounded_sql(spark, text, inputs, roots)
    with pytest.raises(ValueError, match="outside"):
        bounded_sql(spark, "SELECT 1", {"o": str(tmp_path / "out.csv")}, roots)
    with pytest.raises(ValueError, match="alias"):
        bounded_sql(spark, "SELECT 1", {"a-b": inputs["Metrics"]}, roots)
    with pytest.raises(ValueError, match="limits"):
        bounded_sql(spark, "SELECT 1", inputs, roots, max_rows=0)


def test_bounded_sql_is_stopped(spark, tmp_path):
    (tmp_path / "n.csv").write_text("n\n" + "\n".join(map(str, range(3000))))
    slow = "SELECT count(*) FROM n a, n b, n c WHERE (a.n * b.n * c.n) % 7 = 3"
    with pytest.raises(TimeoutError):
        bounded_sql(spark, slow, {"n": str(tmp_path / "n.csv")}, [str(tmp_path)], timeout_ms=1500)
    assert bounded_sql(spark, "SELECT count(*) FROM n", {"n": str(tmp_path / "n.csv")}, [str(tmp_path)]).rows == [(3000,)]


def test_malformed_lines_are_counted(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"tool": "a"}\n{oops\n{"tool": "b"}\n')
    good, bad = scan_tolerant_jsonl(spark, str(tmp_path / "log.jsonl"), "tool string")
    assert {r["tool"] for r in good.collect()} == {"a", "b"}
    assert [(r["malformed"], r["lines"]) for r in bad.collect()] == [(1, 3)]


def test_common_words_count_exactly(spark):
    import math
    import random

    rng = random.Random(4)
    words = ["the", "of", "a", *(f"w{i}" for i in range(40))]
    texts = [" ".join(rng.choices(words, [40, 30, 20, *[1] * 40], k=rng.randrange(1, 30))) for _ in range(300)]
    asked = ["the", "the of", "w1", "the w1 w2", "of a w3 w3", "the of a w4 w5 w6 w7", "none", "the none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    cut = [t.split() for t in texts]
    mean = sum(map(len, cut)) / len(cut)
    for depth in (3, 40):
        got = R.bm25_lane(docs, queries, F.col("content"), depth).collect()
        for n, query in enumerate(asked):
            scores = {}
            for i, t in enumerate(cut):
                total = 0.0
                for w in set(query.split()):
                    df = sum(w in x for x in cut)
                    total += math.log(1 + (len(cut) - df + 0.5) / (df + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
                if total > 0:
                    scores[i] = round(total, 6)
            want = sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:depth]
            mine = sorted((r["rank"], r["file_id"], r["score"]) for r in got if r["query_id"] == n)
            assert [(f, s) for _, f, s in mine] == [(f, pytest.approx(s, abs=2e-6)) for f, s in want], (query, depth)


def test_vector_lane_in_blocks(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.randrange(40), [rng.gauss(0, 1) for _ in range(4)]) for _ in range(300)] + [(77, None), (78, [0.0] * 4), (79, [1.0])]
    asked = [(100 + i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(25)] + [(200, None)]
    chunks = spark.createDataFrame(rows, "file_id long, vector array<double>")
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    whole = R.vector_lane(chunks, queries, 5, 4)
    blocks = R.vector_lane(chunks, queries, 5, 4, query_block=4, row_block=50)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect()))
    assert whole.count() == 125 and R.vector_lane(chunks, queries.limit(0), 5, 4).count() == 0


def test_vector_lane_with_many_rows_of_one_file(spark):
    # file 1 has more near rows in the batch than any multiple of the depth; the others come after it
    rows = [(1, [1.0, 0.001 * i]) for i in range(200)] + [(f, [1.0, 1.0 + f]) for f in range(2, 7)]
    chunks = spark.createDataFrame(rows, "file_id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    got = R.vector_lane(chunks, queries, 3, 2).orderBy("rank").collect()
    assert [(r["file_id"], r["rank"]) for r in got] == [(1, 1), (2, 2), (3, 3)]
