from __future__ import annotations

from tessera.engine import Workspace

SF = "/root/testdata/sf0.001"


def test_search_inspect_changes_status(spark):
    ws = Workspace(spark, SF)
    doc = ws.docs(kinds=["source"]).where("symbols <> ''").orderBy("file_id").first()
    hits = ws.search(f"{doc['name']} {doc['symbols'].split(' ')[0]}", limit=3).orderBy("rank").collect()
    assert hits[0]["path"] == doc["path"] and "exact_path" in hits[0]["lanes"] and "exact_symbol" in hits[0]["lanes"]
    root = "/".join(doc["path"].split("/")[:3])
    assert all(h["path"].startswith(root + "/") for h in ws.search("import", roots=[root]).collect())
    row = ws.inspect(doc["path"], start_line=2, max_lines=3).first()
    assert row["excerpt"].startswith("2: ") and row["excerpt"].count("\n") == 3 and row["outline"]
    listing = spark.createDataFrame([(doc["path"], 1, "other"), ("/new", 1, "h")], "path string, size long, hash string")
    states = {r["path"]: r["state"] for r in ws.changes(listing).where("state <> 'deleted'").collect()}
    assert states == {doc["path"]: "modified", "/new": "added"}
    assert ws.status().count() == 40


def test_notes_context_and_missing(spark):
    ws = Workspace(spark, SF)
    skill = ws.tables.documents.where("kind = 'agent_skill' AND path IS NOT NULL AND length(text) > 80").orderBy("doc_id").first()
    name = skill["path"].rsplit("/", 1)[1]
    free = {r["doc_id"]: r["score"] for r in ws.search_notes(name, limit=20).collect()}
    folder = skill["path"].rsplit("/", 1)[0]
    held = ws.search_notes(name, limit=20, context_path=f"{folder}/src/x.py").collect()
    assert free[skill["doc_id"]] < 1 < held[0]["score"] and held[0]["doc_id"] == skill["doc_id"]
    assert all(r["path"].rsplit("/", 1)[0] == folder for r in held if r["kind"] == "agent_skill")
    doc = ws.docs(kinds=["source"]).where("symbols <> ''").orderBy("file_id").first()
    plain = {r["file_id"]: r["score"] for r in ws.search(doc["name"], limit=20).collect()}
    own = {r["file_id"]: r["score"] for r in ws.search(doc["name"], limit=20, context_path=doc["path"]).collect()}
    assert abs(own[doc["file_id"]] - plain[doc["file_id"]] - 0.15) < 1e-6
    why = {r["path"]: r["reason"] for r in ws.missing([doc["path"], "/else/a.py", "/ws/../x", f"{doc['path']}.gone"]).collect()}
    assert why == {doc["path"]: "indexed_not_returned", "/else/a.py": "outside_indexed_roots", "/ws/../x": "unresolved_path", f"{doc['path']}.gone": "not_returned"}


def test_limit_is_checked(spark):
    import pytest

    with pytest.raises(ValueError):
        Workspace(spark, SF).search("x", limit=51)
