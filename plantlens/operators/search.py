"""Exact cosine top-k over a chunk table, optionally restricted to mentioned documents.

Questions travel to the chunks in blocks of bounded size; each task multiplies its Arrow
batches with the block, keeps what can still enter a question's best k, and only those rows
are shuffled. Chunks are never paired with questions as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.text import document_stem
from plantlens.session import cut, settle

# Hits per question, smallest score, smallest name similarity in percent.
TOP_K = 5
THRESHOLD = 0.45
MENTION_RATIO = 80

STATUS_OK, STATUS_NO_INDEX, STATUS_NO_RELEVANT = "OK", "NO_INDEX", "NO_RELEVANT"

# Questions, and bytes of question vectors, that one pass over the chunks carries.
BLOCK_QUERIES = 4_096
BLOCK_BYTES = 64 * 1024 * 1024
SCORE_UNIT = 1e6
# Document names that are pushed into the chunk scan as a filter; more are joined.
PUSHED_NAMES = 1_000
# Documents with their question lists that may be broadcast; more are joined by shuffle.
LISTED_DOCUMENTS = 2_000
# Pieces of names, and their bytes, that may be broadcast; more are joined by shuffle.
PIECE_ROWS = 100_000
PIECE_BYTES = 32 * 1024 * 1024
# Least characters of a text that one tile of it is searched for.
TILE = 64


def _scan(query_ids: np.ndarray, matrix: np.ndarray, restricted: np.ndarray, k: int, threshold: float):
    """Arrow batches of (chunk_id, source, chunk, vec[, asked]) to candidate hits.

    ``asked`` lists the restricted questions whose documents include the chunk's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst = np.full(len(query_ids), -np.inf)
        worst_id = np.full(len(query_ids), np.iinfo("int64").max)
        best: list[list[tuple[float, int]]] = [[] for _ in query_ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(batch.num_rows, -1).astype(float)
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            scores = np.floor(vectors @ matrix.T * SCORE_UNIT + 0.5) / SCORE_UNIT
            may = scores >= threshold
            if restricted.any():
                open_to = np.tile(~restricted, (batch.num_rows, 1))
                asked = batch.column("asked")
                listed = asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                named = np.searchsorted(query_ids, asked.flatten().to_numpy(zero_copy_only=False))
                open_to[np.repeat(np.arange(batch.num_rows), listed), named] = True
                may &= open_to
            may &= (scores > worst) | ((scores == worst) & (ids[:, None] < worst_id))
            took_rows: list[np.ndarray] = []
            took_queries: list[np.ndarray] = []
            for q in np.flatnonzero(may.any(axis=0)):
                rows = np.flatnonzero(may[:, q])
                rows = rows[np.lexsort((ids[rows], -scores[rows, q]))][:k]
                merged = sorted([*best[q], *[(-scores[r, q], int(ids[r])) for r in rows]])[:k]
                best[q] = merged
                if len(merged) == k:
                    worst[q], worst_id[q] = -merged[-1][0], merged[-1][1]
                took_rows.append(rows)
                took_queries.append(np.full(len(rows), q))
            if took_rows:
                rows, asked = np.concatenate(took_rows), np.concatenate(took_queries)
                hits = batch.select(["chunk_id", "source", "chunk"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[asked]), *hits.columns, pa.array(scores[rows, asked])],
                    names=["query_id", "chunk_id", "source", "paragraph", "score"],
                )

    return run


HIT_SCHEMA = "query_id bigint, chunk_id bigint, source string, paragraph string, score double"


def top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    threshold: float = THRESHOLD,
    mentions: DataFrame | None = None,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Best ``k`` chunks per question with a score of at least ``threshold``.

    ``chunks``: chunk_id bigint (unique), source, chunk, vec (unit). ``queries``: query_id,
    vec (unit). ``mentions``: (query_id, source) pairs; a question that has any is answered
    from those documents only. Ties go to the smaller chunk_id. A question or a chunk without a vector has no hits.
    """
    asked = cut(queries.where(F.col("vec").isNotNull()).select(F.col("query_id").cast("bigint").alias("query_id"), "vec"))
    named = cut(mentions.select(F.col("query_id").cast("bigint").alias("query_id"), "source").distinct()) if mentions is not None else None
    widest = asked.agg(F.max(F.size("vec")), F.count("*")).first()
    dim, total = int(widest[0] or 1), int(widest[1])
    per_block = max(1, min(block_queries, BLOCK_BYTES // (8 * dim)))
    blocks = max(1, -(-total // per_block))
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    table = chunks.where(F.col("vec").isNotNull()).select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "source", "chunk", "vec")
    found = []
    for b in range(blocks):
        rows = asked.where(block_of == b).orderBy("query_id").collect()
        if not rows:
            continue
        query_ids = np.array([r["query_id"] for r in rows], dtype="int64")
        matrix = np.array([r["vec"] for r in rows], dtype=float)
        restricted = np.zeros(len(rows), dtype=bool)
        scanned = table
        if named is not None:
            restricted, scanned = _restrict(table, named.where(block_of == b), query_ids)
        found.append(scanned.mapInArrow(_scan(query_ids, matrix, restricted, k, threshold), HIT_SCHEMA))
    if not found:
        return chunks.sparkSession.createDataFrame([], f"{HIT_SCHEMA}, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    hits = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return hits.where(F.col("rank") <= k)


def _restrict(table: DataFrame, pairs: DataFrame, query_ids: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """Flags of the block's restricted questions, and chunks with the questions their document answers.

    A document's list is bounded by the block's questions. When every question is restricted,
    other documents are not scanned; a few names are pushed into the scan.
    """
    limited = [r[0] for r in pairs.select("query_id").distinct().collect()]
    restricted = np.isin(query_ids, np.array(limited, dtype="int64"))
    if not restricted.any():
        return restricted, table
    by_source, rows = settle(pairs.groupBy("source").agg(F.collect_set("query_id").alias("asked")), LISTED_DOCUMENTS)
    if restricted.all() and rows is not None and len(rows) <= PUSHED_NAMES:
        table = table.where(F.col("source").isin([r["source"] for r in rows]))
    return restricted, table.join(by_source, "source", "inner" if restricted.all() else "left")


def _meet(rows: DataFrame, others: DataFrame, on: str) -> DataFrame:
    """Join with ``others``, broadcast only after their rows were counted, else by shuffle.

    Spark's own choice goes by the size of the files read, which rows that were listed or unpacked from them outgrow.
    """
    few, listed = settle(others)
    return rows.join(few if listed is not None else few.hint("merge"), on)


def named_documents(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source) where the lower-cased question contains the document's stem.

    An equality join: each question lists its substrings of the lengths that stems have.
    """
    stems = sources.select("source").distinct().withColumn("stem", document_stem(F.col("source")))
    lengths = [r[0] for r in stems.select(F.length("stem")).distinct().collect()]
    if not lengths:
        return queries.select("query_id", F.lit(None).cast("string").alias("source")).limit(0)
    lowered = queries.select("query_id", F.lower("text").alias("q"))
    size = F.length("q")

    def substrings(n: int) -> Column:
        starts = F.sequence(F.lit(1), size - n + 1)
        cut_out = F.transform(starts, lambda i: F.substring(F.col("q"), i, F.lit(n)))
        return F.when(size >= n, cut_out).otherwise(F.array().cast("array<string>"))

    parts = F.array_distinct(F.flatten(F.array(*[substrings(n) for n in sorted(lengths)])))
    return lowered.select("query_id", F.explode(parts).alias("stem")).transform(_meet, stems, "stem").select("query_id", "source")


def _longest_common(bits: dict[str, int], length: int, text: str) -> int:
    """Length of the longest common subsequence, one machine word per step (Hyyrö's bit vectors)."""
    full = (1 << length) - 1
    row = full
    for char in text:
        hit = row & bits.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def partial_similarity(a: str, b: str, needed: int = 0) -> int:
    """Best similarity, in rounded percent, of the shorter text with any equally long or clipped window of the longer.

    Similarity is 2 * common subsequence / total length; of two equally long texts each is
    slid along the other. Windows whose characters alone rule out more than ``needed`` are
    passed over.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100 if not long else 0
    best = _best_window(short, long, needed)
    if len(a) == len(b):
        best = max(best, _best_window(long, short, needed))
    return round(best)


def _best_window(short: str, long: str, needed: int, lo: int = 0, n: int | None = None, ends: range | None = None) -> float:
    """Best similarity of ``short`` with the windows that end at ``ends``; ``long`` holds a text of ``n`` characters from ``lo`` on."""
    m, n = len(short), len(long) if n is None else n
    bits: dict[str, int] = {}
    for i, char in enumerate(short):
        bits[char] = bits.get(char, 0) | (1 << i)
    shared = np.concatenate([[0], np.cumsum([c in bits for c in long])])
    best = 0.0
    for end in range(1, n + m) if ends is None else ends:
        start, stop = max(0, end - m) - lo, min(end, n) - lo
        total = m + stop - start
        bound = 200.0 * min(int(shared[stop] - shared[start]), m) / total
        if bound > best and round(bound) > needed:
            best = max(best, 200.0 * _longest_common(bits, m, long[start:stop]) / total)
    return best


def _pieces(shorts: DataFrame, ratio: int) -> DataFrame:
    """(short_id, short, m, pairs, needed, piece): each short text cut into one piece more than it may have edits.

    A similarity above ``ratio`` leaves at most m * (199 - 2 ratio) / 100 characters unmatched in text and window together, and
    each spoils one piece, so one piece stands unchanged in the window. An unmatched character of the text
    spoils two of its character pairs, one of the window spoils one; at least ``needed`` pairs stand in the window.
    """
    m, top = F.col("m"), 2 * ratio + 1
    count = (F.floor(m * (199 - 2 * ratio) / 100.0) + 1).cast("int")
    lost = F.greatest(F.floor(m * (4 * (200 - top)) / float(400 - top)), F.floor(m * (3 * (200 - top)) / 200.0))

    def piece(i: Column) -> Column:
        at, stop = F.floor(i * m / F.col("p")).cast("int"), F.floor((i + 1) * m / F.col("p")).cast("int")
        return F.substring(F.col("short"), at + 1, stop - at)

    pairs = F.transform(F.sequence(F.lit(1), m - 1), lambda i: F.substring(F.col("short"), i, F.lit(2)))
    sized = shorts.withColumn("p", count).withColumn("pairs", F.when(m > 1, pairs).otherwise(F.array().cast("array<string>")))
    cut_up = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("p") - 1), piece))
    return sized.select("short_id", "short", "m", "pairs", (m - 1 - lost).alias("needed"), F.explode(cut_up).alias("piece"))


def _reaching(ratio: int):
    """Candidates whose piece lies in a window more similar than ``ratio``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            keep = [
                round(_best_window(short, region, ratio, lo, n, range(x + size, x + len(short) + 1))) > ratio
                for short, region, lo, n, x, size in zip(*(rows[c] for c in ["short", "region", "lo", "n", "x", "size"]))
            ]
            yield batch.select(["short_id", "long_id"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar_within(shorts: DataFrame, longs: DataFrame, ratio: int) -> DataFrame | None:
    """(short_id, long_id) of texts where a window of the long one, at least as long as the short one, is similar to it.

    ``shorts``: short_id, short; ``longs``: long_id, long; both distinct. Pieces of the short texts meet all substrings of
    their sizes by an equality join; the pairs of characters around each meeting are counted, and what is left is aligned.
    Long texts are cut into overlapping tiles, so no row holds more than three times the longest short text.
    """
    reach = longs.agg(F.max(F.length("long"))).first()[0] or 0
    fitting = shorts.withColumn("m", F.length("short")).where((F.col("m") > 0) & (F.col("m") <= reach))
    least, most = fitting.agg(F.min("m"), F.max("m")).first()
    if most is None:
        return None
    pieces = _pieces(fitting, ratio)
    sizes = sorted(r[0] for r in pieces.select(F.length("piece")).distinct().collect())
    # Of a piece's row its text's character pairs are the most, 16 bytes each.
    count, width = pieces.agg(F.count("*"), F.sum(16 * F.col("m") + F.octet_length("short") + 160)).first()
    pieces = F.broadcast(pieces) if count <= PIECE_ROWS and width <= PIECE_BYTES else pieces.hint("merge")
    step = max(TILE, most)
    n, core = F.length("long"), F.col("j") * step
    tiles = (
        longs.where(n >= least)
        .select("long_id", "long", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int"))).alias("j"))
        .withColumn("lo", F.greatest(F.lit(0), core - most))
        .select("long_id", "n", "j", "lo", F.substring(F.col("long"), F.col("lo") + 1, core + step + most - F.col("lo")).alias("part"))
    )
    spots = tiles.select("long_id", "n", "lo", "part", F.explode(F.sequence(core, F.least(core + step, F.col("n")) - 1)).alias("x"))
    strings = F.array_distinct(F.array(*[F.substring(F.col("part"), F.col("x") - F.col("lo") + 1, F.lit(s)) for s in sizes]))
    met = spots.withColumn("piece", F.explode(strings)).join(pieces, "piece").where(F.col("m") <= F.col("n"))
    size, m, x = F.length("piece"), F.col("m"), F.col("x")
    first, last = F.greatest(F.lit(0), x + size - m), F.least(F.col("n"), x + m)
    near = met.select(
        "short_id", "long_id", "short", "pairs", "needed", "n", "x", size.alias("size"), first.alias("lo"),
        F.substring(F.col("part"), first - F.col("lo") + 1, last - first).alias("region"),
    )
    kept = near.where(F.size(F.filter("pairs", lambda g: F.contains(F.col("region"), g))) >= F.col("needed"))
    kept = kept.select("short_id", "long_id", "short", "region", "lo", "n", "x", "size")
    return kept.mapInArrow(_reaching(ratio), "short_id bigint, long_id bigint").distinct()


def similar_documents(queries: DataFrame, sources: DataFrame, ratio: int = MENTION_RATIO) -> DataFrame:
    """(query_id, source) where the stem's partial similarity with the question exceeds ``ratio`` (50 to 99).

    Whichever text is shorter is looked for in the other, so both are indexed once as the short and once as the long side.
    A NULL name or question is similar to nothing, an empty one only to an empty one. No text passes through the driver.
    """
    if not 50 <= ratio < 100:
        raise ValueError("ratio must lie between 50 and 99")
    stems = sources.select("source").distinct().withColumn("stem", document_stem(F.col("source")))
    lowered = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.lower("text").alias("q"))

    def numbered(texts: DataFrame, name: str) -> DataFrame:
        # Written once, so a number stays with its text.
        return cut(texts.select(name).where(F.col(name).isNotNull()).distinct().withColumn(f"{name}_id", F.monotonically_increasing_id()))

    names, asked = numbered(stems, "stem"), numbered(lowered, "q")

    def as_side(texts: DataFrame, name: str, side: str) -> DataFrame:
        return texts.select(F.col(f"{name}_id").alias(f"{side}_id"), F.col(name).alias(side))

    ids = []
    for short, long in [("stem", "q"), ("q", "stem")]:
        tables = {"stem": names, "q": asked}
        found = _similar_within(as_side(tables[short], short, "short"), as_side(tables[long], long, "long"), ratio)
        if found is not None:
            ids.append(found.select(F.col("short_id").alias(f"{short}_id"), F.col("long_id").alias(f"{long}_id")).select("stem_id", "q_id"))
    pairs = names.where("stem = ''").crossJoin(asked.where("q = ''")).select("stem_id", "q_id")
    pairs = reduce(DataFrame.unionByName, ids, pairs).distinct()
    by_id = cut(pairs).transform(_meet, names, "stem_id").select("stem", "q_id").transform(_meet, asked, "q_id")
    found = by_id.select("stem", "q").transform(_meet, stems, "stem").select("q", "source")
    return _meet(lowered, found, "q").select("query_id", "source")


def mentioned_documents(queries: DataFrame, sources: DataFrame, ratio: int | None = MENTION_RATIO) -> DataFrame:
    """Documents a question names, by containment or (unless ``ratio`` is None) by similar spelling."""
    pairs = named_documents(queries, sources).select(F.col("query_id").cast("bigint").alias("query_id"), "source")
    if ratio is not None:
        pairs = pairs.unionByName(similar_documents(queries, sources, ratio))
    return pairs.distinct()


def search_status(queries: DataFrame, hits: DataFrame | None) -> DataFrame:
    """One row per question: OK with its number of hits, NO_RELEVANT, or NO_INDEX without a chunk table."""
    if hits is None:
        return queries.select("query_id", F.lit(STATUS_NO_INDEX).alias("status"), F.lit(0).cast("bigint").alias("n_hits"))
    counted = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    status = F.when(n > 0, STATUS_OK).otherwise(STATUS_NO_RELEVANT)
    return queries.select("query_id").join(counted, "query_id", "left").select("query_id", status.alias("status"), n.alias("n_hits"))


def answerable(chunks: DataFrame | None) -> bool:
    return chunks is not None and bool(chunks.limit(1).count())


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and distinct documents; per-document counts first, so a large document costs one row."""
    per_document = chunks.groupBy("source").agg(F.count("*").alias("n"))
    return per_document.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_chunks"), F.count("*").alias("n_documents")
    )
