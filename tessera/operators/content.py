"""The current content of catalogued files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_content(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(file_id, root_id, extension, kind, relative_path, content): the indexed text of each file that is not deleted.

    It is the row with the file's id and generation. Defined cases: repeats of a file or a text
    in full are one; were two texts given for one generation, the one indexed last holds; a file
    without such a row, or with null id or generation, is left out; a null content is left out.
    """
    slim = files.where(~F.coalesce("deleted", F.lit(False))).select(F.col("id").alias("file_id"), "generation", "root_id", F.lower("extension").alias("extension"), "kind", "relative_path").distinct()
    texts = docs.where(F.col("content").isNotNull()).select("file_id", "generation", "indexed_at", "content")
    return (
        texts.join(slim, ["file_id", "generation"])
        .groupBy("file_id", "generation")
        .agg(
            F.min("root_id").alias("root_id"),
            F.min("extension").alias("extension"),
            F.min("kind").alias("kind"),
            F.min("relative_path").alias("relative_path"),
            F.max_by("content", F.struct(F.col("indexed_at").isNotNull(), "indexed_at", F.length("content"))).alias("content"),
        )
        .drop("generation")
    )
