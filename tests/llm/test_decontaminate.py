import random

import numpy as np

from plantlens.llm import decontaminate as d
from tests.llm.fixtures import documents, empty, syllables


def within(pattern: str, text: str, budget: int) -> bool:
    """Whether some substring of ``text`` is at most ``budget`` edits from ``pattern``: the whole table of distances."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) <= budget


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[p] = "q"
        elif kind == 1:
            del out[p]
        else:
            out.insert(p, "z")
    return "".join(out)


def test_found_segments_equal_full_alignment():
    rng = random.Random(4)
    items = [(i, d.plain(syllables(rng, rng.randint(8, 60)))) for i in range(8)]
    probes = d.Probes(items, d.Search())
    texts = []
    for k in range(60):
        _, item = rng.choice(items)
        texts.append(syllables(rng, 20) + " " + edited(rng, item, rng.randint(0, 14)).upper() + "\n" + syllables(rng, 10))
    got = {(t, s) for t, s, *_ in d.matches(texts, probes, limit=3000)}
    for t, text in enumerate(texts):
        for s, segment in enumerate(probes.texts):
            assert ((t, s) in got) == within(segment, d.plain(text), int(probes.edits[s]))


def test_hashes_are_of_the_substring_alone():
    for q in (1, 2, 3, 5, 8, 12, 13):
        a, b = d.qgram_hashes(d.points("x" + "abcdefghijklmnop"), q), d.qgram_hashes(d.points("abcdefghijklmnop"), q)
        assert len(b) == 16 - q + 1 and (a[1:] == b).all() and len(np.unique(b)) == len(b)
    assert len(d.qgram_hashes(d.points("abc"), 12)) == 0


def test_repetitive_texts_stay_bounded():
    probes = d.Probes([(1, "a" * 170)], d.Search())
    assert {s for _, s, *_ in d.matches(["a" * 3000, "b" * 3000], probes)} == {0}


def test_many_texts_and_segments_in_one_run():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    items = [(i, d.plain("".join(rng.choices(letters, k=40)))) for i in range(70_000)]
    probes = d.Probes(items, d.Search())
    texts = ["nothing of note stands here"] * 2200
    texts[2100] = f"some words {probes.texts[5]} and more"
    texts[2199] = f"some words {probes.texts[69_000]} and more"
    assert len(texts) * len(probes.items) > 1 << 27
    assert [m[:3] for m in d.matches(texts, probes)] == [(2100, 5, 0), (2199, 69_000, 0)]


def test_short_items_are_found_without_edits():
    items = ["what is a monad?", "为什么天空是蓝色的", "今天北京的天气怎么样我们应该带伞吗", "2+2=?", "cat", "cat", "why?", "a", ""]
    probes = d.Probes(list(enumerate(items)), d.Search())
    texts = ["He asked: What  is a\nMonad? Nobody knew.", "他问为什么天空是蓝色的，没有人知道", "今天北京的天气怎么样我们应该带伞吗", "so 2+2=? of course", "concatenate cats", "the CAT", "say w", "hy? then", "what is a nomad?", "cat", "xwhat is a monad?", ""]
    got = {(t, probes.items[s]): (edits, end) for t, s, edits, end in d.matches(texts, probes)}
    assert set(got) == {(0, 0), (0, 7), (1, 1), (2, 2), (3, 3), (5, 4), (5, 5), (8, 7), (9, 4), (9, 5), (10, 0), (10, 7)}
    assert all(edits == 0 for edits, _ in got.values()) and got[5, 4][1] == 7 and got[1, 1][1] == 11
    assert set(probes.items) == set(range(8))
    again = {(t, probes.items[s]) for t, s, *_ in d.matches(texts, probes, limit=1)}
    assert again == set(got)


def test_tables(spark):
    docs = documents(spark)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    items = [(1, text[0]), (1, text[0]), (2, None), (3, ""), (4, "too short"), (None, text[1]), (5, text[3]), (6, text[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for search in (d.Search(), d.Search(block_chars=1)):
        rows = d.leaks(docs, bench, search).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(i, k) for i in (0, 18, 19) for k in (1, 6)} | {(3, 5)}
        assert len(rows) == 8 and all(r["edits"] == 0 for r in rows)  # row 3 stands twice
        kept = d.without_leaks(docs, bench, search)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    assert d.leaks(empty(spark), bench).count() == 0 and d.leaks(docs, bench.limit(0)).count() == 0
    assert d.without_leaks(docs, bench.limit(0)).count() == docs.count()
