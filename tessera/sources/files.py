"""Reading and writing the formats the engine accepts, and bounded read-only SQL over them."""

from __future__ import annotations

import json
import os
import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = (".parquet", ".csv", ".tsv", ".json", ".jsonl", ".ndjson")


def scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a file or folder by its extension. Without a schema text formats infer one from their data.

    CSV and TSV have a header; ``.json`` is one document, ``.jsonl`` and ``.ndjson`` a document a line.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind not in FORMATS:
        raise ValueError(f"not a readable format: {path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == ".parquet":
        return reader.parquet(path)
    if kind in (".csv", ".tsv"):
        reader = reader.option("header", True).option("sep", "\t" if kind == ".tsv" else ",").option("quote", '"').option("escape", '"').option("multiLine", True)
        return (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
    return (reader.option("multiLine", True) if kind == ".json" else reader).json(path)


def scan_tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a log of JSON lines, and per file how many lines were malformed."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("source"), F.from_json("value", f"{schema}, _bad string", options).alias("r"))
    good = lines.where("r._bad IS NULL").select("r.*").drop("_bad")
    bad = lines.groupBy("source").agg(F.count_if(F.col("r._bad").isNotNull()).alias("malformed"), F.count("*").alias("lines"))
    return good, bad


def scan_tree(spark: SparkSession, root: str, excluded: list[str]) -> DataFrame:
    """(path, size, modified): a recursive listing without the contents and without excluded components."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))


@dataclass
class Bounded:
    """Rows of a bounded query, whether rows were left out, and the names of its columns."""

    columns: list[str]
    rows: list[tuple]
    truncated: bool


#: Kinds of plan nodes that a query may have; any other (commands, scripts, functions as tables, names made at run time) is turned away.
QUERY_NODES = {
    "Aggregate", "CTERelationDef", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "PipeOperator",
    "Project", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "Unpivot", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnpivotTransformer",
    "WithWindowDefinition",
}
#: Families of built-in functions that read nothing but their arguments.
FUNCTION_FAMILIES = {f"{x}_funcs" for x in ("agg", "array", "bitwise", "collection", "conditional", "conversion", "csv", "datetime", "generator", "hash", "json", "lambda", "map", "math", "predicate", "string", "struct", "url", "window")}


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_admission(session: SparkSession, text: str, aliases: set[str]) -> None:
    """Raise unless ``text`` is one query over the aliases and its own named queries, with plain functions.

    The text is parsed, not resolved, so nothing is opened before it is admitted: what counts is the
    tree, whatever the spelling (quotes, comments, subqueries).
    """
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:  # the parser's own exceptions come from the JVM
        raise ValueError(f"no query that can be read: {str(error).splitlines()[0][:200]}") from None
    known = session.sparkContext._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    plan_class = session.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", True, plan.getClass().getClassLoader())

    def check(node, names: set[str]) -> None:
        kind = node.getClass().getSimpleName()
        is_plan = plan_class.isInstance(node)
        if is_plan and kind not in QUERY_NODES:
            raise ValueError(f"only SELECT over the listed inputs is allowed, not {kind}")
        if kind == "UnresolvedRelation":
            parts = _each(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names:
                raise ValueError(f"only SELECT over the listed inputs is allowed, not over {'.'.join(parts)}")
        elif kind == "UnresolvedFunction":
            parts = _each(node.nameParts())
            identifier = session.sparkContext._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[-1].lower())
            found = known.lookupFunction(identifier)
            if len(parts) != 1 or found.isEmpty() or found.get().getGroup() not in FUNCTION_FAMILIES:
                raise ValueError(f"only SELECT over the listed inputs is allowed, not the function {'.'.join(parts)}")
        elif kind == "UnresolvedWith":
            # a named query sees those before it
            for pair in _each(node.cteRelations()):
                check(pair._2(), names)
                names = names | {pair._1().lower()}
        elif not is_plan and hasattr(node, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            check(node.plan(), names)
        elif not is_plan and "Subquery" in kind and kind != "InSubquery":
            raise ValueError(f"only SELECT over the listed inputs is allowed, not {kind}")
        elif kind == "InSubquery":
            check(node.query(), names)
        for inner in _each(node.children()):
            check(inner, names)
        if is_plan:
            for expression in _each(node.expressions()):
                check(expression, names)

    check(plan, aliases)


def bounded_sql(spark: SparkSession, text: str, inputs: dict[str, str], roots: list[str], max_rows: int = 100, max_bytes: int = 1 << 20, timeout_ms: int = 30_000) -> Bounded:
    """Run one query over listed files, with a limit on rows, bytes and time.

    Inputs must lie below a root, have a known format and a plain alias; the parsed query may name
    the aliases and its own named queries alone, with built-in functions that read nothing else.
    The views live in a session of their own. The row limit is part of the plan, so at most one row
    more than it reaches the driver; a query that runs longer than ``timeout_ms`` is stopped.
    """
    if not 1 <= max_rows <= 10_000 or not 1 <= max_bytes <= 8 << 20 or not 1 <= timeout_ms <= 600_000:
        raise ValueError("limits out of range")
    seen: dict[str, str] = {}
    for alias, path in inputs.items():
        real = os.path.realpath(path)
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", alias) or alias.lower() in seen:
            raise ValueError(f"not an alias: {alias}")
        if not any(real == r or real.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, roots)):
            raise ValueError(f"outside the allowed roots: {path}")
        seen[alias.lower()] = real
    text = text.strip().removesuffix(";")
    own = spark.newSession()
    _check_admission(own, text, set(seen))
    for alias, real in seen.items():
        scan(own, real).createOrReplaceTempView(alias)
    tag = f"bounded-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        own.interruptTag(tag)

    timer = threading.Timer(timeout_ms / 1000, stop)
    own.addTag(tag)
    timer.start()
    rows, size, truncated = [], 0, False
    try:
        # the limit is on the plan, so a sort before it stays a top-k
        found = own.sql(text).limit(max_rows + 1)
        for row in found.collect():
            size += len(json.dumps(list(row), default=str))
            if len(rows) == max_rows or size > max_bytes:
                truncated = True
                break
            rows.append(tuple(row))
    except Exception:
        if late.is_set():
            raise TimeoutError(f"the query ran longer than {timeout_ms} ms") from None
        raise
    finally:
        timer.cancel()
        own.removeTag(tag)
    return Bounded(found.columns, rows, truncated)
