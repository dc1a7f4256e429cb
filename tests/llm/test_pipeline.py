import random

import sentencepiece

import corpus_pipeline
from plantlens.llm import decontaminate, piece_codec
from tests.llm.fixtures import documents, syllables
from tests.llm.test_classifiers import corpus
from tests.llm.test_ngram_join import brute


def folder(spark, path, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    items = [(k, syllables(rng, 40)) for k in range(3)]
    made = corpus(500, seed=4)
    texts = {i: t for i, t, *_ in made}
    toxic, good = {i for i, _, t, _ in made if t}, {i for i, _, _, q in made if q}
    clean = sorted(good - toxic)
    for n, i in enumerate(clean[:9]):
        texts[i] += " " + items[n % 3][1].upper()
    for n, i in enumerate(clean[10:20]):
        texts[1000 + n] = texts[i] + " end."
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    sf = folder(spark, tmp_path, rows, [(i, q, t) for i, _, t, q in made], items)

    docs, after = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
        after[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == before.columns
        if name == "near_copies":
            rows_in = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert after[name] == {least for _, _, least in brute(rows_in)}
        if name == "benchmark":
            rows_in = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert after[name] == {i for i, t in rows_in if not any(decontaminate.plain(x) in decontaminate.plain(t) for _, x in items)}
    assert len(toxic & after["toxicity"]) < 0.25 * len(toxic) and len((good - toxic) & after["toxicity"]) > 0.95 * len(good - toxic)
    assert len((set(range(500)) - good) & after["quality"]) < 0.2 * len(set(range(500)) - good & after["toxicity"])
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    last = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in last} == after["tokens"] == after["benchmark"]
    assert all(r["ids"] == [*library.encode(texts[r["doc_id"]]), 2] for r in last)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    odd = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [tuple(r) for r in odd] + [(None, None, None, None, None), (None, odd[0]["text"], None, None, None), (3, "another text under a known id", None, None, None)]
    sf = folder(spark, tmp_path, rows, [(1, 1, 0), (2, 0, 1)], [(1, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, sf))
        out.count()
        stage(spark, docs.limit(0), sf).count()
        docs = out if "text" in out.columns else docs


def test_near_copies_of_repeated_ids(spark):
    text = syllables(random.Random(2), 40)
    rows = [(1, text), (1, text), (1, "other words than those stand in here"), (None, text), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted([r["text"] for r in kept], key=str) == sorted(["", None, "other words than those stand in here", text], key=str)
