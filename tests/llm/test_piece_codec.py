import hashlib
import random
import tracemalloc

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plantlens.llm import piece_codec
from tests.llm.fixtures import documents, empty

PATH = piece_codec.default_model()


@pytest.fixture(scope="module")
def codec():
    return piece_codec.load_pieces(PATH).codec()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


PARTS = st.sampled_from(["a", "b", " ", "  ", "    ", "\n", "▁", "é", "😀", "the", "ing", "\x00", "日本", "<s>", "</s>", "<0x0A>", "==", "....", "​", "İ", "22", "\r\n", "er", "tion"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=40), st.lists(PARTS, max_size=14).map("".join)))
def test_ids_and_text_equal_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode([*ids, 2]) == library.decode([*ids, 2])


def test_any_ids_decode_as_in_the_library(codec, library):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 6))]
        assert codec.decode(ids) == library.decode(ids)


def test_long_texts_take_linear_time(codec, library):
    text = " " * 50_000 + "ab" * 40_000 + "\n" * 1000
    assert codec.encode(text) == library.encode(text)


def test_digests_and_columns(spark, library):
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    rows = piece_codec.digests(docs, PATH, with_ids=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = [*library.encode(texts[r["doc_id"]]), 2]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    both = piece_codec.decode_column(piece_codec.encode_column(docs, PATH), PATH).collect()
    assert all(r["decoded"] == library.decode(library.encode(r["text"] or "")) and r["node"] == "clash" for r in both)
    assert piece_codec.digests(empty(spark), PATH).count() == 0


def test_what_a_worker_remembers_is_small():
    """Full memories of units and pairs, by what a part of them takes, stay within 320 MB of a Python worker."""
    codec = piece_codec.load_pieces(piece_codec.default_model()).codec()
    rng = random.Random(1)
    tracemalloc.start()
    for _ in range(20_000):
        codec.unit_ids("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 10))))
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken * max(piece_codec.UNIT_LIMIT / len(codec.units), piece_codec.PAIR_LIMIT / len(codec.pairs)) < 320e6
