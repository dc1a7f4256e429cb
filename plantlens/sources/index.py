"""The chunk table behind document search: parquet, appended in batches that one last row publishes.

A table of documents stands beside the chunks, so that a document without any chunk is known too. Both are written under a new batch
number; readers see a batch once a row of the table ``commits`` names it, and this row is a single file that the last step of a
job moves into place. What a broken upload has left stays unseen (``orphan_batches``), its number is not used again,
and the same upload can be repeated. Commits are of three kinds: ``add``; ``reset``, which hides all earlier batches (a new build, a compaction); and
``remove``, which hides a document's earlier batches. One writer at a time is assumed; readers need no care.

Rows are range-partitioned by (source, chunk_id): a large document spreads over many files,
and a search restricted to a few documents skips the other files by their value ranges.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators.embed import Embedder, embed_column
from plantlens.session import cut
from plantlens.sources.documents import document_chunks

# Chunks in one file of the index.
CHUNKS_PER_FILE = 50_000

COMMIT_SCHEMA = "batch int, kind string, source string"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _commit(spark: SparkSession, path: str, batch: int, kind: str, source: str | None = None) -> None:
    """The last step of every change; all it writes is one file of one row."""
    spark.createDataFrame([(batch, kind, source)], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def index_exists(spark: SparkSession, path: str) -> bool:
    return _read(spark, f"{path}/commits") is not None


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """Current chunks (``chunk_id, source, chunk, vec``), ``None`` when nothing was built or stored."""
    chunks = _current(spark, path, "chunks")
    return None if chunks is None else chunks.select("chunk_id", "source", "chunk", "vec")


def _current(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """Rows of published batches that no later removal hides, ``None`` when nothing was published."""
    rows, commits = _read(spark, f"{path}/{table}"), _read(spark, f"{path}/commits")
    if rows is None or commits is None:
        return None
    first = commits.where("kind = 'reset'").agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
    live = commits.where(F.col("kind").isin("add", "reset") & (F.col("batch") >= first)).select("batch").distinct()
    removed = commits.where("kind = 'remove'").groupBy(F.col("source").alias("gone")).agg(F.max("batch").alias("before_batch"))
    rows = rows.where(F.col("batch") >= first).join(live, "batch", "left_semi")
    return rows.join(removed, (F.col("source") == F.col("gone")) & (F.col("batch") < F.col("before_batch")), "left_anti")


def read_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """Current documents (``source, doc_id``), with or without chunks."""
    rows = _current(spark, path, "documents")
    return None if rows is None else rows.select("source", "doc_id")


def _batches(spark: SparkSession, path: str, names: tuple[str, ...]) -> set[int]:
    tables = [t for t in (_read(spark, f"{path}/{name}") for name in names) if t is not None]
    # One number per upload: the partition values of the two tables and the commits' rows.
    return {int(r[0]) for t in tables for r in t.select("batch").distinct().collect()}


def _next_batch(spark: SparkSession, path: str) -> int:
    return 1 + max(_batches(spark, path, ("chunks", "documents", "commits")), default=-1)


def orphan_batches(spark: SparkSession, path: str) -> list[int]:
    """Batches that an upload has written but never published."""
    commits = _read(spark, f"{path}/commits")
    known = set() if commits is None else {int(r[0]) for r in commits.where("kind <> 'remove'").select("batch").distinct().collect()}
    return sorted(_batches(spark, path, ("chunks", "documents")) - known)


def compact(spark: SparkSession, path: str) -> None:
    """Write the current rows as one batch, publish it, then delete what it replaces (orphans too).

    A stop at any point leaves the index readable with the same rows.
    """
    chunks, documents = _current(spark, path, "chunks"), _current(spark, path, "documents")
    if chunks is None and documents is None:
        return
    batch = _next_batch(spark, path)
    for name, rows, keys in (("chunks", chunks, ("source", "chunk_id")), ("documents", documents, ("source", "doc_id"))):
        if rows is not None:
            rows = rows.drop("batch")
            files = max(1, -(-rows.count() // CHUNKS_PER_FILE))
            rows = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).withColumn("batch", F.lit(batch))
            rows.write.mode("append").partitionBy("batch").parquet(f"{path}/{name}")
    _commit(spark, path, batch, "reset")
    jvm = spark.sparkContext._jvm
    for name in ("chunks", "documents"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for old in _batches(spark, path, (name,)) - {batch}:
            system.delete(jvm.org.apache.hadoop.fs.Path(folder, f"batch={old}"), True)


def _record(docs: DataFrame, path: str, batch: int) -> None:
    named = docs.select("source", "doc_id").where("source is not null and doc_id is not null").distinct()
    named.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/documents")


def _write(docs: DataFrame, path: str, embedder: Embedder, batch: int) -> bool:
    # Chunked once and written; counting and range sampling read the written rows.
    chunks = cut(document_chunks(docs))
    n = chunks.count()
    if not n:
        return False
    placed = chunks.repartitionByRange(-(-n // CHUNKS_PER_FILE), "source", "chunk_id").sortWithinPartitions("source", "chunk_id")
    vectors = embed_column(placed, "chunk", embedder).withColumn("batch", F.lit(batch))
    vectors.write.mode("append").partitionBy("batch").parquet(f"{path}/chunks")
    return True


def build_index(docs: DataFrame, path: str, embedder: Embedder) -> bool:
    """Chunk, embed and store ``docs`` (doc_id, source, text); False when there is nothing to store.

    An existing index is replaced by the commit alone, once everything new is written.
    """
    batch, chunked = write_batch(docs, path, embedder)
    if chunked:
        _commit(docs.sparkSession, path, batch, "reset")
    return chunked


def write_batch(docs: DataFrame, path: str, embedder: Embedder) -> tuple[int, bool]:
    """Store documents under a new batch number that no commit names yet; the number, and whether there was any chunk."""
    batch = _next_batch(docs.sparkSession, path)
    chunked = _write(docs, path, embedder, batch)
    _record(docs, path, batch)
    return batch, chunked


def ingest(docs: DataFrame, path: str, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """Add documents whose name is new; returns the saved and the skipped (source, doc_id) rows.

    Within one upload the smallest doc_id of a name is saved with all of its rows (pages), other documents of that name are
    skipped, and so is every row without a name or an id. A saved document is known by name from then on, even if no line of it is long enough for a chunk.
    """
    spark = docs.sparkSession
    saved, skipped = split_new(docs, read_documents(spark, path))
    saved, skipped = cut(saved), cut(skipped)
    batch, _ = write_batch(docs.join(saved, ["source", "doc_id"], "left_semi"), path, embedder)
    _commit(spark, path, batch, "add")
    return saved, skipped


def split_new(docs: DataFrame, existing: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Documents to save and to skip, one row each, decided by name. Names are aggregated before any join.

    A row without a name or an id cannot be found again; it is skipped.
    """
    names = docs.where("source is not null and doc_id is not null").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    if existing is not None:
        names = names.join(existing.select("source").distinct(), "source", "left_anti")
    skipped = docs.select("source", "doc_id").distinct().join(names, ["source", "doc_id"], "left_anti")
    return names, skipped


def remove_document(spark: SparkSession, path: str, source: str) -> None:
    """Hide a document's chunks; the name may be ingested again later."""
    _commit(spark, path, _next_batch(spark, path), "remove", source)
