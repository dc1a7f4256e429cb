import hashlib
import random
import zlib

import numpy as np
import pytest

from plantlens.llm import periodic_runs as r
from plantlens.llm.common import QUERIES
from tests.llm.fixtures import documents, empty, syllables


def brute(words, least=12):
    """All stretches of words equal to those q later, for every q; of equal stretches the least period counts."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    return [w for i, w in enumerate(words) if i not in gone]


def word_lists(rng):
    thue, fib = "a", ("a", "ab")
    for _ in range(8):
        thue = thue + thue.translate(str.maketrans("ab", "ba"))
        fib = fib[1], fib[1] + fib[0]
    out = [[], ["x"], ["x"] * 11, ["x"] * 12, ["x"] * 13, ["x"] * 500, list("ab" * 90), list(thue[:256]), list(fib[1][:300]), list("abcabcabcabc"), list("abcabcabcabx"), list("abcdefabcdef"), list("abcdefgabcdefg")]
    for _ in range(60):
        n, k = rng.randint(0, 220), rng.choice([1, 2, 2, 3, 5, 50])
        words = [f"w{rng.randrange(k)}" for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            part = [f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 60))]
            at = rng.randint(0, len(words))
            words[at:at] = (part * 5)[: rng.randint(len(part), 5 * len(part))]
        out.append(words)
    return out


def test_runs_equal_brute_force(spark):
    lists = word_lists(random.Random(7))
    texts = [" ".join(w).encode() for w in lists]
    for least in (10, 12, 20):
        for words, (runs, n, text) in zip(lists, r.find_runs(texts, least), strict=True):
            assert n == len(words) and [tuple(x) for x in runs.tolist()] == brute(words, least), words
            assert text == " ".join(collapsed(words, runs.tolist())).encode()
    with pytest.raises(ValueError, match="10 or more"):
        r.periodic_runs(empty(spark), 5)


def test_blocks_beyond_the_longest_transform(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(r, "LONGEST", 8)
    monkeypatch.setattr(r, "SLAB", 64)
    part = [f"w{rng.randrange(400)}" for _ in range(500)]
    words = [*part[:77], *part, *part, *part[:123], "end"] + ["z", "y"] * 90
    ((runs, _, _),) = r.find_runs([" ".join(words).encode()], 12)
    assert [tuple(x) for x in runs.tolist()] == brute(words)


def test_transform_is_an_exact_convolution():
    rng = np.random.default_rng(3)
    for size in (8, 32, 2048):
        a, b = rng.integers(0, r.PRIME, (2, size, 3))
        a[size // 2 :] = 0
        got = r.backward(r.fold(r.fold(r.forward(a) * r.forward(b)))) % r.PRIME
        i = 1
        want = sum(int(a[j, i]) * int(b[(5 - j) % size, i]) for j in range(size)) * size % r.PRIME
        assert got[5, i] == want


def test_one_huge_text_of_one_word():
    ((runs, n, text),) = r.find_runs([b"word " * 400_000], 12)
    assert n == 400_000 and runs.tolist() == [[0, 400_000, 1]] and text == b"word"


def shown(text, doc_id):
    """The row of the query by brute force."""
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(((a - b, a, q) for a, b, q in runs), default=None)
    figures = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
    return (doc_id, len(runs), *figures, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)), sha(" ".join(collapsed(words, runs))))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, syllables(rng, rng.randint(1, 90)) if i % 7 else " ".join(rng.choice(["ä", "b"]) for _ in range(i % 50))) for i in range(150)]
    rows += [(200, None), (210, ""), (220, " \n"), (230, "\x1c \x1d\x1c  x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents(spark).select("doc_id", "text").where("length(text) < 5000 or text is null"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(x) for x in QUERIES["op11_runs"](spark, str(tmp_path)).collect()]
    want = [shown(x["text"], x["doc_id"]) for x in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in want)


def test_odd_rows(spark):
    docs = documents(spark)
    rows = r.periodic_runs(docs).collect()
    assert len(rows) == docs.count() and all(x["collapsed"] is not None and x["runs"] is not None for x in rows)
    assert r.periodic_runs(empty(spark)).count() == 0
