import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plantlens.llm import source_audit as a
from tests.llm.fixtures import documents, empty, syllables

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=3, most=200):
    """Dense sums over all kept terms."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        table = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        table[None] = {t: sum(table[s][t] for s in sources) for t in kept}
        share = {s: {t: 1 + a.UNIT * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in table.items()}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            parts = {
                "pair": [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in sources if o != s],
                "term": [(t, f(share[s][t], share[None][t])) for t in kept if table[s][t] and share[s][t] > share[None][t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(items) if part == "pair" or i < most]
    return sorted(out)


def answer(docs, **options):
    return sorted(tuple(r) for r in a.audit_sources(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_dense_sums_on_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.select("text", "lang", "source").collect()]
    assert answer(docs) == brute(rows) and answer(docs, least_docs=1, most_terms=7) == brute(rows, 1, 7)
    assert answer(empty(spark)) == []
    assert all(v == 0 for *_, part, _, v, _ in answer(docs, least_docs=1000) if part == "pair")


def test_many_sources_hot_source_and_ties(spark):
    rng = random.Random(4)
    rows = [(syllables(rng, rng.randint(0, 60)), rng.choice(["en", "de", None]), f"s{min(rng.randrange(20), 12)}") for _ in range(300)]
    rows += [("Ärger ärger ÄRGER naïve 中文 中文", "en", "é"), ("中文 中文, Ärger; naïve", "en", "é"), ("naïve Ärger 中文", "en", "s1"), (None, "xx", None), ("", "xx", "only")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(5)
    assert answer(docs) == brute(rows)


def test_tree_computes_shared_paths_once(spark):
    """Rows with equal starts are closed once, also when the batches end in the middle of a path."""
    import pyarrow as pa

    rows = sorted([((1, 2, 3), (2, 5, 1), (3, 7, 2)), ((1, 2, 3), (2, 5, 1)), ((1, 2, 3), (2, 6, 1), (4, 9, 5)), ((2, 5, 1),), ((1, 4, 3), (3, 8, 2))])
    times = [3, 4, 1, 6, 2]
    shape = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.struct([("place", pa.int64()), ("p", pa.int64()), ("z", pa.int64())]))), ("times", pa.int64())])
    make = lambda s: pa.RecordBatch.from_pylist([{"lang": "en", "path": [dict(zip(("place", "p", "z"), x, strict=True)) for x in r], "times": m} for r, m in zip(rows[s], times[s], strict=True)], schema=shape)
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for row, m in zip(rows, times, strict=True):
        for g, p, zg in row:
            for h, q, zh in row:
                if g != h:
                    want[g, h] += m * (f(p, q) - f(p, zh) - f(zg, q) + f(zg, zh))
    for cut_at in range(1, 5):
        got = Counter()
        for batch in a.walk_tree(iter([make(slice(0, cut_at)), make(slice(cut_at, 5))])):
            for r in batch.to_pylist():
                got[r["g"], r["h"]] += r["value"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    tree = a.Corrections()
    tree.add(a.np.array([[1, 2, 3], [2, 5, 7], [3, 1, 2]]), 1, a.np.array([9, 9, 3]))
    assert sum(p[0].shape[1] for p in tree.parts) == 3  # two new nodes: one ancestor and two


def test_counts_beyond_64_bits_when_scaled(spark):
    n = 40_000_000_000
    got = spark.range(1).select(a.share(F.lit(n), F.lit(2 * n), F.lit(5)).alias("p"), a.share(F.lit(0), F.lit(0), F.lit(0)).alias("z")).first()
    assert got["p"] == 1 + a.UNIT * (n + 1) // (2 * n + 5) and got["z"] is None


def test_long_text_is_read_in_runs():
    rng = random.Random(1)
    text = " ".join(rng.choice(["Ab", "c-d", "é", "x1y"]) for _ in range(5000)).encode()
    assert [t for run in a.term_runs(text, 100) for t in run] == [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]
