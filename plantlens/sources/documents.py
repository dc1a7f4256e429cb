"""Document folders and document tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions.text import DOCUMENT_SUFFIX, chunk_lines, is_blank

# Chunk ids are doc_id * LINE_SLOTS + line; a row cannot hold more lines than this.
LINE_SLOTS = 1 << 31


def list_documents(spark: SparkSession, folders: Sequence[str], ordered: bool = False) -> DataFrame:
    """Document files of the folders: ``path, source, folder_rank``; file contents are not read."""
    found = []
    for rank, folder in enumerate(folders):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{DOCUMENT_SUFFIX}")
        try:
            files = reader.load(folder).select("path")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            files = spark.createDataFrame([], "path string")
        name = F.element_at(F.split("path", "/"), -1)
        found.append(files.select("path", name.alias("source"), F.lit(rank).alias("folder_rank")))
    listed = reduce(DataFrame.unionByName, found)
    return listed.orderBy("folder_rank", "source") if ordered else listed


def document_chunks(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", page: str = "page") -> DataFrame:
    """``chunk_id, source, chunk`` of every non-blank document row.

    With a ``page`` column a row is one page: its lines are numbered on from the earlier
    pages' last line, as if the pages were joined (a missing text is one empty line). A page that is repeated with the same text counts once;
    different texts under one page number are joined in the order of their hashes. Ids are unique and in
    reading order; only line counts are gathered per document, never its text.
    """
    keep = [doc_id, source]
    if page in docs.columns:
        docs = docs.withColumn("h__", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).dropDuplicates([doc_id, page, "h__"])
        counts = docs.select(F.col(doc_id).alias("d__"), F.col(page).alias("p__"), F.col("h__").alias("g__"), F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("n__"))
        before = Window.partitionBy("d__").orderBy("p__", "g__").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.withColumn("start__", F.coalesce(F.sum("n__").over(before), F.lit(0))).drop("n__")
        docs = docs.join(starts, (F.col(doc_id) == F.col("d__")) & F.col(page).eqNullSafe(F.col("p__")) & (F.col("h__") == F.col("g__")))
        keep.append("start__")
    lines = chunk_lines(docs.where(~is_blank(F.col(text))), text, keep)
    line = F.col("line") + F.col("start__") if page in docs.columns else F.col("line")
    slot = F.when(line < LINE_SLOTS, line).otherwise(F.raise_error(F.lit("a document has more than 2^31 lines")))
    return lines.select((F.col(doc_id) * F.lit(LINE_SLOTS) + slot).alias("chunk_id"), F.col(source).alias("source"), "chunk")
