import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.functions import text as txt
from plantlens.functions.vectors import dot, l2_norm, l2_normalise
from plantlens.operators import search
from plantlens.operators.embed import embed_column, hashing_embedder
from plantlens.sources.documents import document_chunks, list_documents
from plantlens.sources import index as stored
from plantlens.sources.index import build_index, compact, index_exists, ingest, orphan_batches, read_documents, read_index, remove_document


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    v = unit(rng.normal(size=(300, 8))).astype("float32")
    # A third of the chunks are copies of one vector.
    v[:100] = v[0]
    sources = rng.choice(["Safety Manual.pdf", "policy.pdf", "notes.pdf"], 300, p=[0.7, 0.2, 0.1])
    return v, sources, unit(rng.normal(size=(12, 8))).astype("float32")


def frames(spark, corpus):
    v, sources, q = corpus
    chunks = spark.createDataFrame([(i, s, f"c{i}", x.tolist()) for i, (s, x) in enumerate(zip(sources, v))], "chunk_id bigint, source string, chunk string, vec array<float>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id bigint, vec array<float>")
    return chunks.repartition(6), queries


def brute(corpus, k, threshold, allowed=None):
    v, sources, q = corpus
    scores = np.floor(v.astype(float) @ q.astype(float).T * 1e6 + 0.5) / 1e6
    out = {}
    for j in range(len(q)):
        rows = [i for i in range(len(v)) if scores[i, j] >= threshold and (not allowed or j not in allowed or sources[i] in allowed[j])]
        out[j] = sorted(rows, key=lambda i: (-scores[i, j], i))[:k]
    return {j: r for j, r in out.items() if r}


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


@pytest.mark.parametrize("block", [4096, 5])
def test_top_k_is_exact(spark, corpus, block):
    chunks, queries = frames(spark, corpus)
    assert found(search.top_k(chunks, queries, 7, 0.2, block_queries=block)) == brute(corpus, 7, 0.2)


def test_restricted_to_mentions_without_fallback(spark, corpus):
    chunks, queries = frames(spark, corpus)
    allowed = {0: {"policy.pdf"}, 1: {"policy.pdf", "notes.pdf"}, 2: {"absent.pdf"}}
    pairs = spark.createDataFrame([(q, s) for q, names in allowed.items() for s in names], "query_id bigint, source string")
    hits = search.top_k(chunks, queries, 5, 0.2, pairs)
    assert found(hits) == brute(corpus, 5, 0.2, allowed)
    status = {r["query_id"]: r["status"] for r in search.search_status(queries, hits).collect()}
    assert status[2] == "NO_RELEVANT" and len(status) == 12
    only = queries.where("query_id < 3")
    assert found(search.top_k(chunks, only, 5, 0.2, pairs)) == {j: r for j, r in brute(corpus, 5, 0.2, allowed).items() if j < 3}
    assert {r["status"] for r in search.search_status(queries, None).collect()} == {"NO_INDEX"}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_similarity(a, b):
    if len(a) == len(b):
        return max(brute_windows(a, b), brute_windows(b, a))
    return brute_windows(*sorted((a, b), key=len))


def brute_windows(short, long):
    m, best = len(short), 0.0
    for end in range(1, len(long) + m):
        window = long[max(0, end - m) : end]
        best = max(best, 200.0 * lcs(short, window) / (m + len(window)))
    return round(best)


def test_partial_similarity_by_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a = "".join(rng.choice(list("abcd "), rng.integers(1, 9)))
        b = "".join(rng.choice(list("abcd "), rng.integers(1, 25)))
        want = brute_similarity(a, b)
        assert search.partial_similarity(a, b) == want == search.partial_similarity(b, a)
        assert (search.partial_similarity(a, b, 80) > 80) == (want > 80)


def test_mentions(spark):
    queries = spark.createDataFrame([(1, "What does the SAFETY MANUAL say?"), (2, "see safty manual"), (3, "hello"), (4, None)], "query_id bigint, text string")
    sources = spark.createDataFrame([("Safety Manual.pdf",), ("Safety Manual.pdf",), ("Budget 2020.pdf",)], "source string")
    exact = search.mentioned_documents(queries, sources, None).collect()
    assert [tuple(r) for r in exact] == [(1, "Safety Manual.pdf")]
    near = sorted(tuple(r) for r in search.mentioned_documents(queries, sources).collect())
    want = [
        (r["query_id"], s)
        for r in queries.collect()
        for s in ["Budget 2020.pdf", "Safety Manual.pdf"]
        if r["text"] and brute_similarity(s.lower().replace(".pdf", ""), r["text"].lower()) > 80
    ]
    assert near == sorted(want) and (2, "Safety Manual.pdf") in near


@pytest.mark.parametrize("ratio", [80, 61, 95])
def test_similar_names_by_brute_force(spark, ratio, monkeypatch):
    rng = np.random.default_rng(ratio)

    def word(least, most):
        return "".join(rng.choice(list("abcdefgh "), rng.integers(least, most)))

    stems = sorted({word(1, 30) for _ in range(14)} | {"x", "", "q" * 17, "né" * 9})

    def worn(text):
        return "".join(c for c in text if rng.random() > 0.12)

    texts = [word(0, 60) for _ in range(6)] + [word(0, 40) + worn(s) + word(0, 200) for s in stems] + [worn(s)[:-2] for s in stems] + [*stems[:9], None, "", "Né" * 9]
    want = sorted((i, s + ".pdf") for i, t in enumerate(texts) if t is not None for s in stems if search.partial_similarity(s, t.lower(), ratio) > ratio)
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    sources = spark.createDataFrame([(s + ".pdf",) for s in [*stems, *stems[:5]]] + [(None,)], "source string")
    for rows in [search.PIECE_ROWS, 0]:
        monkeypatch.setattr(search, "PIECE_ROWS", rows)
        assert sorted(tuple(r) for r in search.similar_documents(queries, sources, ratio).collect()) == want
    assert len(want) > 15
    assert search.similar_documents(queries.limit(0), sources).count() == 0 == search.similar_documents(queries, sources.limit(0)).count()
    with pytest.raises(ValueError, match="ratio"):
        search.similar_documents(queries, sources, 20)


def test_chunking_like_python(spark):
    texts = ["　 " + "a" * 40 + "\t\x1c\n" + "b" * 39 + "\nc" + "é" * 40, "   \n\t", None, "", "x" * 41 + "\r\n" + " " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [(r["doc_id"], r["line"], r["chunk"]) for r in txt.chunk_lines(df, "text", ["doc_id"]).collect()]
    want = [(i, j, p.strip()) for i, t in enumerate(texts) if t for j, p in enumerate(t.split("\n")) if len(p.strip()) >= 40]
    assert sorted(got) == sorted(want) and len(want) == 3
    blanks = [r["doc_id"] for r in df.where(txt.is_blank(F.col("text"))).collect()]
    assert blanks == [1, 2, 3]


def test_every_space_python_strips(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert set(spaces) == set(txt.WHITE_SPACE)


def test_categories(spark):
    names = ["GOV policy safety.pdf", "Compliance report.pdf", "Report manual.pdf", "user MANUAL.pdf", "menu.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(txt.document_category(F.col("n"))).collect()] == [
        "Government Policy", "Safety & Standards", "Technical Report", "User Manual", "General Document"
    ]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    rows = df.select(l2_normalise(F.col("v")), l2_norm(F.col("v")), dot(F.col("v"), F.col("v"))).collect()
    assert rows[0][0] == pytest.approx([0.6, 0.8]) and rows[1][0] == [0.0, 0.0]
    assert (rows[0][1], rows[0][2]) == (5.0, 25.0)


def test_embedding_batches_do_not_matter(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} pump valve {i}") for i in range(200)] + [(200, None)], "id int, t string")
    a = embed_column(df, "t", hashing_embedder(32)).orderBy("id").collect()
    b = embed_column(df.repartition(7), "t", hashing_embedder(32), batch=3).orderBy("id").collect()
    assert [r["vec"] for r in a] == [r["vec"] for r in b]
    assert np.linalg.norm(a[0]["vec"]) == pytest.approx(1, abs=1e-6) and sum(a[200]["vec"]) == 0


def test_context_and_defaults(spark):
    hits = spark.createDataFrame([(1, 2, None, "b", 0.5), (1, 1, "s.pdf", None, None)], "query_id int, rank int, source string, text string, score double")
    full = txt.complete_hits(hits)
    context = txt.context_by_query(full).first()["context"]
    assert context == "[SOURCE: s.pdf | SCORE: 0.00]\n\n\n[SOURCE: Unknown.pdf | SCORE: 0.50]\nb"
    prompt = spark.range(1).select(txt.answer_prompt(F.lit("CTX {question}"), F.lit("Why?"))).first()[0]
    assert prompt == txt.PROMPT_TEMPLATE.replace("{question}", "Why?").replace("{context}", "CTX {question}")


def test_document_listing(spark, tmp_path):
    for folder, names in {"laws": ["b.pdf", "a.pdf", "x.txt", "Z.PDF"], "user": ["c.pdf"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x")
    rows = list_documents(spark, [str(tmp_path / "laws"), str(tmp_path / "none"), str(tmp_path / "user")], ordered=True).collect()
    assert [(r["folder_rank"], r["source"]) for r in rows] == [(0, "a.pdf"), (0, "b.pdf"), (2, "c.pdf")]


def test_index_life_cycle(spark, tmp_path):
    path, embed = str(tmp_path / "kb"), hashing_embedder(16)
    line = "the valve must be inspected every second week "
    docs = pd.DataFrame({"doc_id": [1, 2, 3], "source": ["a.pdf", "b.pdf", "c.pdf"], "text": [f"{line}\n{line}", line, "short"]})
    frame = spark.createDataFrame(docs)
    assert not index_exists(spark, path) and read_index(spark, path) is None
    assert not build_index(frame.where("doc_id = 3"), path, embed) and not index_exists(spark, path)
    assert build_index(frame, path, embed)
    assert search.index_stats(read_index(spark, path)).first().asDict() == {"n_chunks": 3, "n_documents": 2}
    more = spark.createDataFrame([(4, "a.pdf", line), (5, "d.pdf", line), (6, "d.pdf", line + line)], "doc_id bigint, source string, text string")
    saved, skipped = ingest(more, path, embed)
    assert [tuple(r) for r in saved.collect()] == [("d.pdf", 5)]
    assert sorted(tuple(r) for r in skipped.collect()) == [("a.pdf", 4), ("d.pdf", 6)]
    remove_document(spark, path, "a.pdf")
    assert {r["source"] for r in read_index(spark, path).collect()} == {"b.pdf", "d.pdf"}
    ingest(spark.createDataFrame([(9, "a.pdf", line)], "doc_id bigint, source string, text string"), path, embed)
    counts = {r["source"]: r["count"] for r in read_index(spark, path).groupBy("source").count().collect()}
    assert counts == {"a.pdf": 1, "b.pdf": 1, "d.pdf": 1}
    assert search.answerable(read_index(spark, path)) and not search.answerable(None)
    ids = [r[0] for r in document_chunks(frame).select("chunk_id").collect()]
    assert len(ids) == len(set(ids)) == 3


def test_pages_and_chunkless_documents(spark, tmp_path):
    path, line = str(tmp_path / "kb"), "a line that is long enough to become a chunk of its own"
    embed = hashing_embedder(16)
    pages = spark.createDataFrame(
        [(1, "a.pdf", 0, f"{line} one\nshort"), (1, "a.pdf", 1, None), (1, "a.pdf", 2, f"\n{line} two"), (2, "b.pdf", 0, "short")],
        "doc_id bigint, source string, page int, text string",
    )
    saved, skipped = ingest(pages, path, embed)
    assert sorted(tuple(r) for r in saved.collect()) == [("a.pdf", 1), ("b.pdf", 2)] and skipped.count() == 0
    chunks = {r["chunk"]: r["chunk_id"] - (1 << 31) for r in read_index(spark, path).collect()}
    assert chunks == {f"{line} one": 0, f"{line} two": 4}
    saved, skipped = ingest(pages, path, embed)
    assert saved.count() == 0 and sorted(tuple(r) for r in skipped.collect()) == [("a.pdf", 1), ("b.pdf", 2)]


@pytest.mark.parametrize("broken", ["_record", "_commit"])
def test_upload_that_stops_between_its_writes(spark, tmp_path, monkeypatch, broken):
    path, embed = str(tmp_path / "kb"), hashing_embedder(16)
    line = "the valve must be inspected every second week "
    frame = spark.createDataFrame([(i, f"{i}.pdf", f"{line}{i}\n{line}again {i}") for i in range(5)], "doc_id bigint, source string, text string")
    ingest(frame.where("doc_id < 2"), path, embed)
    with monkeypatch.context() as patch:
        patch.setattr(stored, broken, lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            ingest(frame, path, embed)
    assert orphan_batches(spark, path) == [1] and read_index(spark, path).count() == 4
    saved, skipped = ingest(frame, path, embed)
    assert (saved.count(), skipped.count()) == (3, 2)
    for turn in range(2):
        ids = [r["chunk_id"] for r in read_index(spark, path).collect()]
        assert len(ids) == len(set(ids)) == 10 and read_documents(spark, path).count() == 5
        if turn == 0:
            remove_document(spark, path, "4.pdf")
            ingest(frame.where("doc_id = 4"), path, embed)
            compact(spark, path)
    assert orphan_batches(spark, path) == [] and len(list((tmp_path / "kb" / "chunks").glob("batch=*"))) == 1
    assert not build_index(frame.limit(0), path, embed) and read_index(spark, path).count() == 10


def test_missing_names_ids_and_vectors(spark, tmp_path):
    path, embed = str(tmp_path / "kb"), hashing_embedder(16)
    line = "the valve must be inspected every second week "
    frame = spark.createDataFrame([(1, None, line), (None, "x.pdf", line), (2, "a.pdf", line), (None, None, None)], "doc_id bigint, source string, text string")
    for turn in range(2):
        saved, skipped = ingest(frame, path, embed)
        assert [tuple(r) for r in saved.collect()] == ([("a.pdf", 2)] if turn == 0 else [])
        assert skipped.count() == 3 + turn and read_index(spark, path).count() == 1
    chunks = read_index(spark, path)
    asked = embed_column(spark.createDataFrame([(1, line)], "query_id int, t string"), "t", embed).unionByName(spark.createDataFrame([(2, "t", None)], "query_id int, t string, vec array<float>"))
    holes = chunks.unionByName(spark.createDataFrame([(77, "n.pdf", "c", None)], "chunk_id bigint, source string, chunk string, vec array<float>"))
    assert [(r["query_id"], r["source"]) for r in search.top_k(holes, asked).collect()] == [(1, "a.pdf")]


def test_repeated_pages_count_once(spark):
    line = "a line that is long enough to become a chunk of its own"
    rows = [(1, "a.pdf", 0, f"{line} 1"), (1, "a.pdf", 0, f"{line} 1"), (1, "a.pdf", 0, f"{line} other"), (1, "a.pdf", None, f"{line} 0"), (1, "a.pdf", 1, None), (1, "a.pdf", 1, None), (1, "a.pdf", 2, f"{line} 2")]
    got = document_chunks(spark.createDataFrame(rows, "doc_id bigint, source string, page int, text string")).collect()
    assert sorted(r["chunk_id"] - (1 << 31) for r in got) == [0, 1, 2, 4] and {r["chunk"][-1] for r in got} == {"0", "1", "r", "2"}


def test_listed_substrings_are_not_broadcast(spark, tmp_path):
    """A small file of questions lists many substrings; only names that were counted are broadcast, more are joined by shuffle."""
    spark.range(3000).select(F.col("id").alias("query_id"), F.lit("where is the manual of the large ring").alias("text"), F.lit("large ring.pdf").alias("source")).write.parquet(f"{tmp_path}/asked")
    asked = spark.read.parquet(f"{tmp_path}/asked")
    named = search.named_documents(asked.select("query_id", "text"), asked.select("source"))
    assert "BuildLeft" not in named._jdf.queryExecution().sparkPlan().toString()
    assert named.count() == 3000
    many = spark.range(30_000).select(F.col("id").cast("string").alias("stem"))
    listed = spark.range(10).select(F.col("id").cast("string").alias("stem"))
    plan = search._meet(listed, many, "stem")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and search._meet(listed, many, "stem").count() == 10
