"""Registered queries: documents, chunk index, vector search, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import query, r4, s4, table
from plantlens.functions import text as txt
from plantlens.functions.vectors import dot, l2_normalise
from plantlens.operators import search
from plantlens.operators.embed import embed_column, hashing_embedder
from plantlens.session import scratch_path
from plantlens.sources.documents import document_chunks
from plantlens.sources import index as stored
from plantlens.sources.index import build_index, compact, ingest, read_documents, read_index, remove_document, split_new

WS = txt.WHITE_SPACE
DIM = 256

# ---------------------------------------------------------------- documents


def _named_docs(spark, sf):
    """Documents under file names; several rows share a name, as repeated uploads would."""
    name = F.concat(F.col("source"), F.lit("_"), F.col("lang"), F.lit(".pdf"))
    return table(spark, sf, "documents").select("doc_id", name.alias("source"), "text")


NAMED = "(SELECT doc_id, source || '_' || lang || '.pdf' AS source, text FROM documents)"
KINDS = ["Policy_", "safety-", "Annual Report ", "manual_", "notes_", "GOV "]
KIND_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][doc_id % 6 + 1]"


def _lines(rows: str, keep: str) -> str:
    split = "string_split(text, chr(10))"
    return f"""(SELECT {keep}, line, trim(raw, '{WS}') AS chunk FROM (SELECT {keep}, generate_subscripts({split}, 1) - 1 AS line,
        unnest({split}) AS raw FROM {rows}) WHERE length(trim(raw, '{WS}')) >= 40)"""


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(n, 'policy|regulation|gov') THEN 'Government Policy'
    WHEN regexp_matches(n, 'safety|compliance') THEN 'Safety & Standards' WHEN contains(n, 'report') THEN 'Technical Report'
    WHEN contains(n, 'manual') THEN 'User Manual' ELSE 'General Document' END AS category
    FROM (SELECT doc_id, lower({KIND_SQL} || source || '.pdf') AS n FROM documents)"""
)
def doc_category(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.concat(kind, F.col("source"), F.lit(".pdf"))
    return table(spark, sf, "documents").select("doc_id", txt.document_category(name).alias("category"))


@query(f"SELECT doc_id, line::INT AS line, chunk FROM {_lines('documents', 'doc_id')}")
def chunk_docs(spark, sf):
    return txt.chunk_lines(table(spark, sf, "documents"), "text", ["doc_id"])


@query(
    f"""SELECT conv_id, chunk FROM {_lines("(SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)", 'conv_id')}"""
)
def page_chunks(spark, sf):
    """Turns as pages: chunking page by page equals chunking the joined text."""
    return txt.chunk_lines(table(spark, sf, "conversations"), "text", ["conv_id"]).drop("line")


@query(f"SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''), '{WS}')) > 0")
def nonblank_documents(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(~txt.is_blank(F.col("text"))).select("doc_id")


@query(
    f"""WITH d AS (SELECT * FROM {NAMED}), e AS (SELECT DISTINCT d.source FROM d JOIN labels USING (doc_id) WHERE toxic = 1),
    n AS (SELECT source, min(doc_id) AS doc_id FROM d WHERE source NOT IN (SELECT source FROM e) GROUP BY 1)
    SELECT d.source, d.doc_id, CASE WHEN n.doc_id IS NULL THEN 'skipped' ELSE 'saved' END AS outcome
    FROM d LEFT JOIN n ON d.source = n.source AND d.doc_id = n.doc_id"""
)
def ingest_dedup(spark, sf):
    docs = _named_docs(spark, sf)
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    saved, skipped = split_new(docs, docs.join(toxic, "doc_id", "left_semi"))
    return saved.withColumn("outcome", F.lit("saved")).unionByName(skipped.withColumn("outcome", F.lit("skipped")))


# ---------------------------------------------------------------- the stored index


def _index(spark, sf) -> str:
    path = scratch_path(spark, "index")
    if not build_index(_named_docs(spark, sf), path, hashing_embedder(DIM)):
        raise AssertionError("documents hold text")
    return path


@query(f"SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_documents FROM {_lines(NAMED, 'source')}")
def index_stats(spark, sf):
    return search.index_stats(read_index(spark, _index(spark, sf)))


@query(f"SELECT source, count(*) AS n FROM {_lines(NAMED, 'source')} WHERE source <> 'src3_en.pdf' GROUP BY 1")
def index_without_document(spark, sf):
    path = _index(spark, sf)
    remove_document(spark, path, "src3_en.pdf")
    return read_index(spark, path).groupBy("source").agg(F.count("*").alias("n"))


@query(
    f"""WITH d AS (SELECT * FROM {NAMED}), one AS (SELECT source, min(doc_id) AS doc_id FROM d WHERE doc_id % 3 = 0 GROUP BY 1),
    two AS (SELECT source, min(doc_id) AS doc_id FROM d WHERE source NOT IN (SELECT source FROM one) GROUP BY 1),
    kept AS (SELECT * FROM one WHERE source <> 'src3_en.pdf' UNION ALL SELECT * FROM two WHERE source <> 'src3_en.pdf'
      UNION ALL SELECT 'src3_en.pdf', min(doc_id) FROM d WHERE source = 'src3_en.pdf')
    SELECT k.source, k.doc_id, count(l.chunk) AS n FROM kept k LEFT JOIN {_lines(NAMED, 'doc_id, source')} l ON l.doc_id = k.doc_id AND l.source = k.source GROUP BY 1, 2"""
)
def ingest_batches(spark, sf):
    """The real ingest: an upload of some documents, one of all, then a removal and a new upload of the removed name."""
    docs, path = _named_docs(spark, sf), scratch_path(spark, "ingested")
    ingest(docs.where("doc_id % 3 = 0"), path, hashing_embedder(DIM))
    ingest(docs, path, hashing_embedder(DIM))
    remove_document(spark, path, "src3_en.pdf")
    ingest(docs.where("source = 'src3_en.pdf'"), path, hashing_embedder(DIM))
    chunks = read_index(spark, path).groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    known = read_documents(spark, path)
    return known.join(chunks, F.col("source") == F.col("s"), "left").select("source", "doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""SELECT conv_id * 2147483648 + line AS chunk_id, 'conversation ' || conv_id AS source, chunk FROM {_lines(
        "(SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)", 'conv_id')}"""
)
def paged_chunk_ids(spark, sf):
    """Turns as pages of a document: ids and order are those of the joined text."""
    pages = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("conversation "), F.col("conv_id")).alias("source"), F.col("turn").alias("page"), "text"
    )
    return document_chunks(pages)


@query(
    f"""SELECT conv_id * 2147483648 + line AS chunk_id, 'conversation ' || conv_id AS source, chunk FROM {_lines(
        "(SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)", 'conv_id')}"""
)
def repeated_page_ids(spark, sf):
    """Every page uploaded twice: ids and chunks stay those of the pages once."""
    pages = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("conversation "), F.col("conv_id")).alias("source"), F.col("turn").alias("page"), "text"
    )
    return document_chunks(pages.unionByName(pages))


@query(
    f"""WITH d AS (SELECT doc_id, CASE WHEN quality = 0 THEN NULL ELSE source END AS source, text FROM {NAMED} LEFT JOIN labels USING (doc_id)),
    n AS (SELECT source, min(doc_id) AS doc_id FROM d WHERE source IS NOT NULL GROUP BY 1), o AS (
      SELECT 'saved' AS outcome, source, doc_id FROM n UNION ALL
      SELECT 'skipped', source, doc_id FROM d WHERE source IS NULL OR (source, doc_id) NOT IN (SELECT (source, doc_id) FROM n) UNION ALL
      SELECT 'second upload', source, doc_id FROM d)
    SELECT outcome, source, doc_id, CASE WHEN outcome = 'saved' THEN (SELECT count(*) FROM {_lines('documents', 'doc_id')} l WHERE l.doc_id = o.doc_id) ELSE 0 END AS n FROM o"""
)
def ingest_after_failure(spark, sf):
    """An upload that stops before its commit, the same upload again, and once more: rows without a name are skipped each time."""
    docs, path = _named_docs(spark, sf), scratch_path(spark, "broken")
    marks = table(spark, sf, "labels").select("doc_id", "quality")
    docs = docs.join(marks, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 0, None).otherwise(F.col("source")).alias("source"), "text")
    stored.write_batch(docs.where("source is not null"), path, hashing_embedder(DIM))
    saved, skipped = ingest(docs, path, hashing_embedder(DIM))
    again = ingest(docs, path, hashing_embedder(DIM))
    compact(spark, path)
    sizes = read_index(spark, path).groupBy(F.shiftright("chunk_id", 31).alias("d")).agg(F.count("*").alias("n"))
    known = read_documents(spark, path).join(sizes, F.col("doc_id") == F.col("d"), "left").select("source", "doc_id", "n")
    outcomes = [(known, "saved"), (skipped, "skipped"), (again[0], "saved twice"), (again[1], "second upload")]
    rows = [t.select(F.lit(o).alias("outcome"), "source", "doc_id", F.col("n") if "n" in t.columns else F.lit(0).alias("n")) for t, o in outcomes]
    return reduce(DataFrame.unionByName, rows).withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


@query("SELECT item_id AS query_id, 'NO_INDEX' AS status, 0::BIGINT AS n_hits FROM benchmark")
def search_without_index(spark, sf):
    """Questions against a folder that holds no index."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunks = read_index(spark, scratch_path(spark, "none"))
    return search.search_status(asked, None if chunks is None else search.top_k(chunks, embed_column(asked, "text", hashing_embedder(DIM))))


WORDS = """(SELECT {key}, ('0x' || substr(md5(word), 1, 6))::BIGINT % {dim} AS bucket, count(*)::DOUBLE AS tf
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS word FROM {rows}) GROUP BY 1, 2)"""


def _unit(rows: str, key: str, text: str) -> str:
    """Sparse unit vectors, rounded to single precision as stored."""
    words = WORDS.format(key=key, text=text, rows=rows, dim=DIM)
    return f"""(SELECT {key}, bucket, (tf / sqrt(sum(tf * tf) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x FROM {words})"""


CHUNKS_SQL = f"(SELECT doc_id * 2147483648 + line AS chunk_id, source, chunk FROM {_lines(NAMED, 'doc_id, source')})"
SIX = "floor((sum(c.x * q.x)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


@query(
    f"""WITH k AS (SELECT * FROM {CHUNKS_SQL}), c AS (SELECT * FROM {_unit('k', 'chunk_id', 'chunk')}),
    q AS (SELECT * FROM {_unit('benchmark', 'item_id', 'text')}),
    s AS (SELECT item_id AS query_id, chunk_id, {SIX} AS score FROM c JOIN q USING (bucket) GROUP BY 1, 2)
    SELECT query_id, chunk_id, source, chunk AS paragraph, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank
    FROM s JOIN k USING (chunk_id) WHERE score >= 0.45
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5"""
)
def knowledge_search(spark, sf):
    """Benchmark items as questions against the documents' chunk index."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = embed_column(asked, "text", hashing_embedder(DIM))
    return search.top_k(read_index(spark, _index(spark, sf)), vectors)


# ---------------------------------------------------------------- vector search on the embedding table

UNIT_SQL = """(SELECT vec_id, label, pos, (x::DOUBLE / CASE WHEN norm = 0 THEN 1.0::DOUBLE ELSE norm END)::FLOAT AS x FROM
    (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x,
       sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS norm FROM embeddings))"""
CENTRE_SQL = f"""(SELECT label, pos, (m / sqrt(sum(m * m) OVER (PARTITION BY label)))::FLOAT AS x FROM
    (SELECT label, pos, avg(x::DOUBLE) AS m FROM {UNIT_SQL} GROUP BY 1, 2))"""


def _chunks(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("Class_"), F.col("label"), F.lit(".pdf")).alias("source"),
        F.concat(F.lit("passage "), F.col("vec_id")).alias("chunk"),
        l2_normalise(F.col("embedding")).alias("vec"),
        "label",
    )


def _centres(spark, sf):
    """One question per label: the mean direction of its vectors."""
    cells = _chunks(spark, sf).select("label", F.posexplode("vec").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    by_label = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("cells"))
    vec = l2_normalise(F.transform("cells", lambda c: c["m"]))
    text = F.when(F.col("label") < 5, F.concat(F.lit("What does class_"), F.col("label"), F.lit(" require?"))).otherwise("Which rules apply?")
    return by_label.select(F.col("label").cast("bigint").alias("query_id"), vec.alias("vec"), text.alias("text"))


QUESTION_SQL = "(SELECT DISTINCT label::BIGINT AS query_id, CASE WHEN label < 5 THEN 'What does class_' || label || ' require?' ELSE 'Which rules apply?' END AS text FROM embeddings)"
SCORES_SQL = f"""(SELECT q.label::BIGINT AS query_id, c.vec_id AS chunk_id, c.label AS label,
    floor(sum(c.x::DOUBLE * q.x::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score
    FROM {UNIT_SQL} c JOIN {CENTRE_SQL} q USING (pos) GROUP BY 1, 2, 3)"""
MENTION_SQL = f"""(SELECT query_id, source FROM {QUESTION_SQL}, (SELECT DISTINCT 'Class_' || label || '.pdf' AS source FROM embeddings)
    WHERE contains(lower(text), replace(lower(source), '.pdf', '')))"""


def _hits_sql(threshold: float, where: str = "true") -> str:
    return f"""(SELECT query_id, chunk_id, 'Class_' || label || '.pdf' AS source, 'passage ' || chunk_id AS paragraph, score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {SCORES_SQL}
      WHERE score >= {threshold} AND {where} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5)"""


# Over the columns of SCORES_SQL.
RESTRICTED = f"""(query_id NOT IN (SELECT m.query_id FROM {MENTION_SQL} m) OR
    (query_id, 'Class_' || label || '.pdf') IN (SELECT (m.query_id, m.source) FROM {MENTION_SQL} m))"""


@query(f"SELECT vec_id, (pos - 1)::INT AS pos, {s4('x::DOUBLE', 6)} AS x FROM {UNIT_SQL}")
def unit_vectors(spark, sf):
    cells = _chunks(spark, sf).select(F.col("chunk_id").alias("vec_id"), F.posexplode("vec").alias("pos", "x"))
    return cells.select("vec_id", "pos", r4(F.col("x").cast("double"), "x", 6))


@query(
    f"""SELECT c.vec_id, {s4('sum(c.x::DOUBLE * q.x::DOUBLE)', 6)} AS score FROM {UNIT_SQL} c JOIN {CENTRE_SQL} q
    ON c.pos = q.pos AND c.label = q.label GROUP BY 1"""
)
def pairwise_dot(spark, sf):
    centres = _centres(spark, sf).select(F.col("query_id").alias("label"), F.col("vec").alias("centre"))
    both = _chunks(spark, sf).join(centres, "label")
    return both.select(F.col("chunk_id").alias("vec_id"), r4(dot(F.col("vec"), F.col("centre")), "score", 6))


@query(f"SELECT * FROM {_hits_sql(0.2)}")
def vector_topk(spark, sf):
    return search.top_k(_chunks(spark, sf), _centres(spark, sf), threshold=0.2)


@query(f"SELECT * FROM {_hits_sql(0.2, RESTRICTED)}")
def vector_topk_filtered(spark, sf):
    chunks, asked = _chunks(spark, sf), _centres(spark, sf)
    named = search.mentioned_documents(asked, chunks.select("source"), ratio=None)
    return search.top_k(chunks, asked, threshold=0.2, mentions=named)


@query(f"SELECT query_id, source FROM {MENTION_SQL}")
def named_documents(spark, sf):
    return search.mentioned_documents(_centres(spark, sf), _chunks(spark, sf).select("source"), ratio=None)


def _similar_sql(asked: str, names: str, ratio: int) -> str:
    """Every distinct name with every distinct question: common subsequences of all windows by bit vectors (names of up to 120 characters)."""
    one = "1::UHUGEINT"
    masks = f"""list_transform(range(1, len(long) + 1), lambda j: list_reduce(list_transform(range(1, len(short) + 1), lambda i:
        CASE WHEN substr(short, i, 1) = substr(long, j, 1) THEN {one} << (i - 1)::UHUGEINT ELSE 0::UHUGEINT END), lambda a, b: a | b))"""
    step = "((v + (v & h)) | (v - (v & h))) & ones"
    return f"""WITH d AS (SELECT DISTINCT source, replace(lower(source), '.pdf', '') AS stem FROM {names}), a AS (SELECT query_id, lower(text) AS q FROM {asked}),
      s AS (SELECT DISTINCT stem FROM d), t AS (SELECT DISTINCT q FROM a),
      r AS (SELECT stem, q, stem AS short, q AS long FROM s, t WHERE len(stem) <= len(q) UNION ALL SELECT stem, q, q, stem FROM s, t WHERE len(q) <= len(stem)),
      b AS (SELECT stem, q, len(short) AS m, len(long) AS n, {masks} AS hit, ({one} << len(short)::UHUGEINT) - {one} AS ones FROM r),
      w AS (SELECT stem, q, m, ones, hit[greatest(0, e - m) + 1 : least(e, n)] AS part FROM (SELECT *, unnest(range(1, n + m)) AS e FROM b)),
      l AS (SELECT stem, q, 200.0::DOUBLE * (m - bit_count(list_reduce(part, lambda v, h: {step}, ones)::BIT)) / (m + len(part)) AS likeness FROM w),
      p AS (SELECT stem, q FROM l GROUP BY 1, 2 HAVING round_even(max(likeness), 0) > {ratio})
      SELECT query_id, source FROM p JOIN a USING (q) JOIN d USING (stem)"""


MISSPELT_SQL = "(SELECT p_partkey AS query_id, 'where is the manual of the ' || replace(p_name, 'e', '') AS text FROM part)"


@query(_similar_sql(MISSPELT_SQL, "(SELECT p_name || '.pdf' AS source FROM part)", search.MENTION_RATIO))
def similar_documents(spark, sf):
    """Misspelt part names in questions against documents named after the parts."""
    part = table(spark, sf, "part")
    asked = part.select(
        F.col("p_partkey").alias("query_id"), F.concat(F.lit("where is the manual of the "), F.regexp_replace("p_name", "e", "")).alias("text")
    )
    documents = part.select(F.concat(F.col("p_name"), F.lit(".pdf")).alias("source"))
    return search.mentioned_documents(asked, documents)


@query(
    f"""SELECT query_id, CASE WHEN count(chunk_id) > 0 THEN 'OK' ELSE 'NO_RELEVANT' END AS status, count(chunk_id) AS n_hits
    FROM {QUESTION_SQL} LEFT JOIN {_hits_sql(0.45)} USING (query_id) GROUP BY 1"""
)
def search_status(spark, sf):
    asked = _centres(spark, sf)
    return search.search_status(asked, search.top_k(_chunks(spark, sf), asked))


@query(
    f"""SELECT query_id, string_agg('[SOURCE: ' || source || ' | SCORE: ' || printf('%.2f', score) || ']' || chr(10) || paragraph,
      chr(10) || chr(10) ORDER BY rank) AS context FROM {_hits_sql(0.2)} GROUP BY 1"""
)
def context_build(spark, sf):
    return txt.context_by_query(txt.complete_hits(search.top_k(_chunks(spark, sf), _centres(spark, sf), threshold=0.2)))


_LEFT, _REST = txt.PROMPT_TEMPLATE.split("{context}")
_MIDDLE, _RIGHT = _REST.split("{question}")


@query(
    f"""SELECT query_id, $a${_LEFT}$a$ || context || $a${_MIDDLE}$a$ || text || $a${_RIGHT}$a$ AS prompt FROM {QUESTION_SQL} JOIN
    (SELECT query_id, string_agg('[SOURCE: ' || source || ' | SCORE: ' || printf('%.2f', score) || ']' || chr(10) || paragraph,
      chr(10) || chr(10) ORDER BY rank) AS context FROM {_hits_sql(0.2)} GROUP BY 1) USING (query_id)"""
)
def prompt_build(spark, sf):
    asked = _centres(spark, sf)
    context = txt.context_by_query(txt.complete_hits(search.top_k(_chunks(spark, sf), asked, threshold=0.2)))
    both = asked.join(context, "query_id")
    return both.select("query_id", txt.answer_prompt(F.col("context"), F.col("text")).alias("prompt"))


@query(
    """SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN source END, 'Unknown.pdf') AS source, coalesce(text, '') AS paragraph,
      coalesce(toxic::DOUBLE, 0.0::DOUBLE) AS score FROM documents LEFT JOIN labels USING (doc_id)"""
)
def hit_defaults(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    raw = docs.select("doc_id", F.when(F.col("quality") == 1, F.col("source")).alias("source"), "text", F.col("toxic").alias("score"))
    return txt.complete_hits(raw).select("doc_id", "source", "paragraph", "score")
