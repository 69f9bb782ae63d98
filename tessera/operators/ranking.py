"""What happens to ranked hits after fusion: boosts, copies, diversity, budgets, and why something is missing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .joins import ancestors, longest_prefix_owner

# What lifts a note, by scope, layer, age and what the query names.
PROJECT_NOTE, GLOBAL_NOTE, LAYER_STEP, RECENT = 0.08, 0.01, 0.004, 0.005
FILE_NAMED, ENTRY_NAMED, DESCRIBED, SUMMARY_PENALTY, NOTE_WEIGHT = 0.25, 0.22, 0.04, 0.08, 0.1
LAYERS = {"project_summary": 5, "topic_summary": 4, "user_profile": 3, "session_summary": 2, "memory_note": 1, "raw_history": 0}
# What lifts a source file of the asker's own checkout.
OWN_CHECKOUT = 0.15
# The bounds of previews and copies, and the least penalty of a directory.
PREVIEW_FLOOR, PREVIEW_MOST, COPIES, DIRECTORY, BOOSTED_FROM = 128, 1_000, 3, 0.00125, 0.5


def memory_boost(query: Column, file_name: Column, entry_name: Column, description: Column, layer: Column, owned: Column, age_days: Column, all_kinds: bool = False) -> Column:
    """What a note's own record adds to its score; a tenth of it where notes are only some of the kinds searched."""
    q = X.normalized_match_text(query)
    named = lambda name: F.coalesce((F.octet_length(name) >= 4) & X.contains_entity(q, name), F.lit(False))
    by_file, by_entry = named(X.normalized_match_text(F.regexp_replace(file_name, r"(.)\.[^.]*$", "$1"))), named(X.normalized_match_text(entry_name))
    words = F.array_distinct(F.filter(F.split(q, " "), lambda w: w != ""))
    shared = F.size(F.array_intersect(words, F.filter(F.split(X.normalized_match_text(F.coalesce(description, F.lit(""))), " "), lambda w: w != "")))
    described = F.when((shared >= 2) | (shared == 1) & (F.size(words) == 1), DESCRIBED * shared / F.size(words)).otherwise(0.0)
    steps = F.element_at(F.create_map(*(F.lit(x) for pair in LAYERS.items() for x in pair)), layer)
    summary = X.is_specific_query(query) & (layer == "project_summary") & ~by_file & ~by_entry
    boost = (
        F.when(owned, PROJECT_NOTE).otherwise(GLOBAL_NOTE)
        + steps * LAYER_STEP
        + RECENT / (1 + F.greatest(age_days, F.lit(0.0)) / 30)
        + F.when(by_file, FILE_NAMED).otherwise(0.0)
        + F.when(by_entry, ENTRY_NAMED).otherwise(0.0)
        + described
        - F.when(summary, SUMMARY_PENALTY).otherwise(0.0)
    )
    return boost * NOTE_WEIGHT if all_kinds else boost


def own_checkout_boost(hits: DataFrame, contexts: DataFrame, checkouts: DataFrame) -> DataFrame:
    """``hits`` with more score for source files that a query names (by symbol or path) in the asker's own checkout.

    ``contexts`` has (query_id, context): a path; its checkout is the longest of ``checkouts`` (root)
    that holds it. ``hits`` has (query_id, path, kind, lanes, score). Without a checkout nothing is added.
    """
    owned = longest_prefix_owner(contexts.select(F.col("context").alias("path")).distinct(), checkouts).select(F.col("path").alias("context"), F.col("root").alias("scope"))
    scopes = contexts.join(owned, "context").select("query_id", "scope").where("scope IS NOT NULL").distinct()
    inside = F.coalesce((F.col("path") == F.col("scope")) | F.startswith("path", F.concat("scope", F.lit("/"))), F.lit(False))
    named = F.col("lanes").contains("exact_symbol") | F.col("lanes").contains("exact_path")
    lifted = F.round(F.col("score") + F.when(inside & named & (F.col("kind") == "source"), OWN_CHECKOUT).otherwise(0.0), 6)
    return hits.join(scopes, "query_id", "left").withColumn("in_scope", inside).withColumn("score", lifted).drop("scope")


def collapse_identified(hits: DataFrame, most: int = COPIES) -> DataFrame:
    """Hits with equal copies put away, and with up to ``most`` ``alternatives`` (path, relationship) each.

    Only hits that a query identifies (``identified``) are compared, by base name. In order of score, a
    hit whose content a better one has is put away as its ``identical_content``; the others are linked to
    and from the first three of their name as ``different_content``, or ``content_unverified`` where a
    hash is missing. What a hit is linked to follows from the order alone, so nothing is looked up
    step by step; the hits of one query are bounded by the depth of its lanes.
    """
    name = X.base_name(F.col("path"))
    compared = hits.where("identified").withColumn("_name", name)
    group = Window.partitionBy("query_id", "_name")
    order = group.orderBy(F.col("score").desc(), "path")
    placed = compared.withColumn("_at", F.row_number().over(order))
    first = F.row_number().over(Window.partitionBy("query_id", "_name", "content_hash").orderBy("_at")) == 1
    placed = placed.withColumn("_kept", first | F.col("content_hash").isNull())
    placed = placed.withColumn("_nth", F.sum(F.col("_kept").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    seen = placed.groupBy("query_id", "_name").agg(F.sort_array(F.collect_list(F.struct("_at", "path", "content_hash", "_kept", "_nth"))).alias("_all"))
    kept = placed.where("_kept").join(seen, ["query_id", "_name"])
    relation = lambda x: F.when(x["content_hash"] == F.col("content_hash"), "identical_content").when(x["content_hash"].isNotNull() & F.col("content_hash").isNotNull(), "different_content").otherwise("content_unverified")
    before = F.filter("_all", lambda x: x["_kept"] & (x["_nth"] < F.least(F.lit(3), F.col("_nth"))))
    same = lambda x: F.coalesce(x["content_hash"] == F.col("content_hash"), F.lit(False))
    after = F.filter("_all", lambda x: (x["_at"] > F.col("_at")) & (same(x) | x["_kept"] & (F.col("_nth") < 3)))
    linked = F.transform(F.slice(F.concat(before, after), 1, most), lambda x: F.struct(x["path"].alias("path"), relation(x).alias("relationship")))
    none = F.array().cast("array<struct<path:string,relationship:string>>")
    columns = [c for c in hits.columns]
    return kept.select(*columns, linked.alias("alternatives")).unionByName(hits.where("NOT identified").withColumn("alternatives", none))


def diversify_progressively(hits: DataFrame, depth: int) -> DataFrame:
    """(query_id, file_id, score, rank): hits chosen greedily with a penalty for directories already chosen from.

    For data files the penalty grows with every file taken from the directory: a tenth of the best
    score that no boost lifted, at least the usual penalty; other files pay the usual penalty once. What is
    chosen next depends on all choices before, so a query's hits (bounded by the depth of its
    lanes) are gone through together.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "path"], ascending=[False, True], kind="stable")
        usual = rows.loc[rows["score"] < BOOSTED_FROM, "score"]
        step = max(0.1 * float(usual.max()) if len(usual) else 0.0, DIRECTORY)
        folders = rows["path"].str.replace(r"/[^/]*$", "", regex=True).to_numpy()
        data = rows["kind"].isin(["semi_structured", "tabular"]).to_numpy()
        scores, paths, taken = rows["score"].to_numpy(), rows["path"].to_numpy(), {}
        left, out = list(range(len(rows))), []
        while left and len(out) < depth:
            now = [(-(scores[i] - (step * taken.get(folders[i], 0) if data[i] else DIRECTORY * min(taken.get(folders[i], 0), 1))), paths[i], i) for i in left]
            away, _, i = min(now)
            left.remove(i)
            taken[folders[i]] = taken.get(folders[i], 0) + 1
            out.append((int(rows["query_id"].iloc[0]), int(rows["file_id"].iloc[i]), round(-away, 9), len(out) + 1))
        return pd.DataFrame(out, columns=["query_id", "file_id", "score", "rank"])

    return hits.select("query_id", "file_id", "path", "kind", "score").groupBy("query_id").applyInPandas(choose, "query_id long, file_id long, score double, rank int")


def budgeted_previews(hits: DataFrame, budget: int) -> DataFrame:
    """``hits`` (query_id, rank, file_id, query, preview) with previews cut to a query's budget of characters.

    In order of rank each preview gets what is left beyond a floor for every later one, 1,000 characters at most;
    a longer one is cut to a window that begins a third of that before the first word of the query in it.
    """
    terms = F.filter(F.split("query", r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) > 2)
    places = F.filter(F.transform(terms, lambda w: F.position(w, F.col("preview"))), lambda p: p > 0)
    known = hits.withColumn("match", F.coalesce(F.array_min(places) - 1, F.lit(0))).withColumn("size", F.length("preview"))
    listed = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "file_id", "size", "match", "preview"))).alias("all"))
    count = F.size("all")
    floor = F.least(F.lit(PREVIEW_FLOOR), F.floor(F.lit(budget) / count).cast("int"))
    part = "array<struct<rank:bigint,file_id:bigint,start:int,chars:int,preview:string>>"

    def step(held: Column, hit: Column) -> Column:
        later = (count - F.size(held["done"]) - 1) * floor
        allowed = F.least(F.greatest(held["left"] - later, F.lit(0)), F.lit(PREVIEW_MOST))
        start = F.when(hit["size"] > allowed, F.greatest(hit["match"] - F.floor(allowed / 3).cast("int"), F.lit(0))).otherwise(0)
        chars = F.least(allowed, hit["size"] - start)
        one = F.struct(hit["rank"].cast("long").alias("rank"), hit["file_id"].cast("long").alias("file_id"), start.alias("start"), chars.alias("chars"), hit["preview"].alias("preview"))
        return F.struct((held["left"] - chars).alias("left"), F.array_append(held["done"], one).alias("done"))

    cut = F.aggregate("all", F.struct(F.lit(budget).alias("left"), F.array().cast(part).alias("done")), step, lambda held: held["done"])
    return listed.select("query_id", F.explode(cut).alias("p")).select("query_id", "p.rank", "p.file_id", F.expr("substring(p.preview, p.start + 1, p.chars)").alias("preview"), (F.col("p.chars") < F.length("p.preview")).alias("cut"))


# Why something asked for is missing.
REASONS = [
    "context_unavailable", "root_unavailable", "root_outside_indexed_roots", "unresolved_path", "outside_indexed_roots", "excluded_by_policy", "symlink_not_followed", "indexed_not_returned", "ignored",
    "present_not_indexed", "not_returned", "no_matching_evidence",
]


def diagnose(anchors: DataFrame, roots: DataFrame, files: DataFrame, present: DataFrame, links: DataFrame | None = None, ignored: str | None = None) -> DataFrame:
    """(request_id, what, path, reason): why each thing of a request was not returned, the first reason that holds.

    ``anchors`` has (request_id, what, path): ``what`` is ``context``, ``root`` or ``anchor``, or ``none`` for a
    request that names nothing. ``files`` (path) is the catalog, ``present`` (path) all that exists,
    ``links`` (path) the symbolic links among it, ``ignored`` a pattern of ignored relative paths.
    Everything is told from tables; no file system is asked.
    """
    known = roots.select(F.col("path").alias("root")).distinct()
    asked = anchors.select("request_id", "what", "path")
    paths = asked.where("path IS NOT NULL").select("path").distinct()
    owner = longest_prefix_owner(paths, known)
    marks = owner.join(files.select("path").distinct().withColumn("indexed", F.lit(True)), "path", "left")
    below = present.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("exists", F.lit(True))
    marks = marks.join(below, "path", "left").join(present.select("path").distinct().withColumn("file", F.lit(True)), "path", "left")
    above = known.select(F.explode(ancestors(F.col("root"))).alias("path")).distinct().withColumn("above", F.lit(True))
    marks = marks.join(above, "path", "left")
    if links is not None:
        linked = paths.select("path", F.explode(ancestors(F.col("path"))).alias("part")).join(links.select(F.col("path").alias("part")).distinct(), "part", "left_semi").select("path").distinct()
        marks = marks.join(linked.withColumn("linked", F.lit(True)), "path", "left")
    else:
        marks = marks.withColumn("linked", F.lit(None).cast("boolean"))
    inner = F.expr("substring(path, length(root) + 2)")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.col("what") == "none", "no_matching_evidence")
        .when((F.col("what") == "context") & ~yes("exists"), "context_unavailable")
        .when((F.col("what") == "root") & ~yes("exists") & ~yes("above"), "root_unavailable")
        .when((F.col("what") == "root") & F.col("root").isNull() & ~yes("above"), "root_outside_indexed_roots")
        .when(F.col("what") != "anchor", None)
        .when(F.array_contains(F.split("path", "/"), ".."), "unresolved_path")
        .when(F.col("root").isNull(), F.when(F.startswith("path", F.lit("/")), "outside_indexed_roots").otherwise("not_returned"))
        .when(X.is_sensitive_name(F.col("path")) | X.is_excluded(inner), "excluded_by_policy")
        .when(yes("linked"), "symlink_not_followed")
        .when(yes("indexed"), "indexed_not_returned")
        .when(inner.rlike(ignored) if ignored else F.lit(False), "ignored")
        .when(yes("file"), "present_not_indexed")
        .otherwise("not_returned")
    )
    return asked.join(marks, "path", "left").select("request_id", "what", "path", reason.alias("reason")).where("reason IS NOT NULL")
