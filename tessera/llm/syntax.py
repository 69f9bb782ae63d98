"""Source files that are not valid in the language of their extension.

A small lexer per language turns each file into rows: one row for each bracket, with the
classes of the tokens that follow it, one letter a token. On these rows Spark finds the files that
break a rule: pairs of neighbouring tokens that no production allows (an anti-join of the pairs
in the rows with the pairs of the grammar), brackets that do not nest (windows over running
depths), and groups whose content no production has (the rows of a group reduced to one string
of classes).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .grammars import BAD, CLOSES, END, OPENS, START, languages

#: Groups whose verdict a task keeps.
KEPT = 200_000


def lexed(current: DataFrame) -> DataFrame:
    """(file_id, lang, seq, step, codes, edge): a row for the start of each file and for each bracket.

    ``step`` is 1 for an opening bracket, -1 for a closing one, 0 for the start. ``codes`` are the
    classes from a bracket (it included) up to the next bracket, which is included too if it
    opens; ``edge`` is the bracket that closes behind them, or the end of the file. A text that is
    no token has a class of its own, which no pair permits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = languages()
        for batch in batches:
            ids, langs, seqs, steps, codes, edges = [], [], [], [], [], []
            for file_id, lang, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                classes = list(known[lang].lex(content))
                begin = len(steps)
                at, step, lead = 0, 0, ""
                for n, c in enumerate(classes):
                    if c in CLOSES or c in OPENS:
                        opens = c in CLOSES
                        steps.append(step)
                        codes.append(lead + "".join(classes[at:n]) + (c if opens else ""))
                        edges.append("" if opens else c)
                        step, lead, at = (1 if opens else -1), c, n + 1
                steps.append(step)
                codes.append(lead + "".join(classes[at:]))
                edges.append(END)
                count = len(steps) - begin
                ids += [file_id] * count
                langs += [lang] * count
                seqs += range(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(seqs, pa.int32()), pa.array(steps, pa.int8()), pa.array(codes, pa.string()), pa.array(edges, pa.string())],
                names=["file_id", "lang", "seq", "step", "codes", "edge"],
            )

    return current.select("file_id", "extension", "content").mapInArrow(run, "file_id long, lang string, seq int, step byte, codes string, edge string")


def with_forbidden_pairs(rows: DataFrame) -> DataFrame:
    """Files with a pair of neighbouring tokens that no production of their language allows.

    Rows alike in language and classes are one before their pairs are cut, so what is
    anti-joined grows with the different rows of the corpus, not with its tokens.
    """
    allowed = rows.sparkSession.createDataFrame([(lang, pair) for lang, known in languages().items() for pair in sorted(known.pairs())], "lang string, pair string")
    text = F.concat(F.when(F.col("seq") == 0, START).otherwise(""), "codes", "edge").alias("text")
    runs = rows.select("lang", text).distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, F.lit(2)))
    cut = runs.where(F.length("text") > 1).select("lang", "text", F.explode(F.array_distinct(pairs)).alias("pair"))
    # the table of pairs is fixed: some 20,000 short rows whatever the data
    bad = cut.join(F.broadcast(allowed), ["lang", "pair"], "left_anti").select("lang", "text").distinct()
    return rows.select("file_id", "lang", text).join(bad, ["lang", "text"], "left_semi").select("file_id")


def with_bad_groups(rows: DataFrame) -> DataFrame:
    """Files whose brackets do not nest or in which a group's content fits no production."""
    in_file = Window.partitionBy("file_id").orderBy("seq")
    depth = rows.select("file_id", "lang", "seq", "step", "codes").withColumn("depth", F.sum("step").over(in_file))
    at_depth = Window.partitionBy("file_id", "depth").orderBy("seq")
    placed = depth.withColumn("grp", F.sum((F.col("step") == 1).cast("int")).over(at_depth))
    groups = (
        placed.groupBy("file_id", "lang", "depth", "grp")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "codes"))).alias("parts"))
        .select("file_id", "lang", "depth", F.array_join(F.col("parts.codes"), "").alias("content"))
    )
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = languages()
        verdicts: dict[tuple[str, int, str], bool] = {}
        for batch in batches:
            bad = []
            for file_id, lang, level, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                key = (lang, min(level, 1), content)
                good = verdicts.get(key)
                if good is None:
                    # a group within others begins with the mark that opened it
                    kind, inner = (content[0], content[1:]) if level > 0 else ("", content)
                    good = level >= 0 and kind in known[lang].inside and known[lang].fits(kind, inner)
                    if len(verdicts) >= KEPT:
                        verdicts.clear()
                    verdicts[key] = good
                if not good:
                    bad.append(file_id)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["file_id"])

    return groups.select("file_id", "lang", "depth", "content").mapInArrow(run, "file_id long")


def with_open_groups(rows: DataFrame) -> DataFrame:
    """Files that end before all their brackets are closed, or close more than they open."""
    return rows.groupBy("file_id").agg(F.sum("step").alias("left")).where("left <> 0").select("file_id")


def invalid_files(current: DataFrame) -> DataFrame:
    """(file_id): files of kind ``source`` that are not valid in the language of their extension.

    Defined cases: an extension of no known language has no rows; empty files and files of
    comments are valid; only syntax counts; line ends may be ``\\r\\n``; null contents are left out
    before; a file is one row however often it fails; very long files are read whole.
    """
    known = current.where((F.col("kind") == "source") & F.col("extension").isin(sorted(languages())))
    rows = written(lexed(known), "lexed-source")
    return with_forbidden_pairs(rows).unionByName(with_open_groups(rows)).unionByName(with_bad_groups(rows)).distinct()


# The language of an extension, in its usual name.
LANGUAGE_NAMES = {"py": "python", "pyi": "python", "rs": "rust", "go": "go", "js": "javascript", "java": "java", "c": "c", "sh": "shell"}


def invalid_rates(current: DataFrame) -> DataFrame:
    """(root_id, language, files, invalid, rate): rates per repository and language of all files checked."""
    known = current.where((F.col("kind") == "source") & F.col("extension").isin(sorted(languages())))
    bad = invalid_files(current).withColumn("bad", F.lit(1))
    named = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return (
        known.select("file_id", "root_id", F.element_at(named, F.col("extension")).alias("language"))
        .join(bad, "file_id", "left")
        .groupBy("root_id", "language")
        .agg(F.count("*").alias("files"), F.count("bad").alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
