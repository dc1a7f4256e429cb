from collections import Counter

import duckdb

from plantlens.llm import line_rules as r
from tests.llm.fixtures import SHAPE, documents, empty

ODD_LINES = [
    "\x1c", "\x1c\x1d \x1e\x1f", "\x85", "\xa0 \xa0", "a\x1cb c", "今天天气很好，我们去公园散步。", "这是一个很长的句子没有标点但是有很多字在里面", "标题", "これは日本語の文章です。",
    "ภาษาไทยไม่มีช่องว่างระหว่างคำและไม่มีจุดจบประโยค", "यह हिंदी का एक वाक्य है।", "هل هذه جملة باللغة العربية؟", "版权所有 2020", "ይህ ዓረፍተ ነገር ነው።", "one | two | three", "wow!!! no### yes***",
]


def odd_documents(spark):
    rows = [(i, line, "en", "s", 1) for i, line in enumerate(ODD_LINES)]
    rows += [(100 + i, "\n".join(ODD_LINES[: i + 1]), "en", "s", 1) for i in range(len(ODD_LINES))] + [(200, "word " * 30_000, "en", "s", 1), (201, "字" * 9000, "en", "s", 1)]
    return documents(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, SHAPE))


def test_sql_equals_operator_on_odd_lines(spark, tmp_path):
    docs = odd_documents(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    result = con.execute(r._sql(r.LineRules()))
    names = [c[0] for c in result.description]
    want = sorted(repr(dict(zip(names, x, strict=True))) for x in result.fetchall())
    got = sorted(repr({n: x[n] for n in names}) for x in r.clean_documents(docs, with_text=False).collect())
    assert got == want


def test_sentences_of_other_scripts_stay():
    rules = r.LineRules()
    for line in ODD_LINES[5:7] + ODD_LINES[8:12] + ODD_LINES[13:14]:
        assert r.line_fault(line, rules) is None, line
    assert r.line_fault("标题", rules) == r.line_fault("\x1c", rules) == "punctuation" and r.line_fault("版权所有 2020。", rules) == "boilerplate"


def repeat_words(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            inside |= set(range(i, i + 5))
    return len(inside)


def test_figures_equal_brute_force(spark):
    docs = documents(spark)
    texts = {x["doc_id"]: x["text"] or "" for x in docs.select("doc_id", "text").collect()}
    rows = r.clean_documents(docs).collect()
    assert len(rows) == docs.count()
    for row in rows:
        text = texts[row["doc_id"]]
        words = [w.decode() for w in text.encode().split()]
        lines = [line for line in text.split("\n") if line.encode().split()]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == repeat_words(words)
        assert row["base_failed"] == (len(words) < 10 or 100 * row["n_repeat_words"] > 20 * len(words))
        assert not (row["kept"] and row["base_failed"])
    assert r.clean_documents(empty(spark)).count() == 0


def test_rules_judge_lines():
    rules = r.LineRules()
    good = "A plain sentence of many words that ends as it should."
    assert r.line_fault(good, rules) is None
    assert r.line_fault("home | news | sport | weather", rules) == "navigation"
    assert r.line_fault("words*** with### signs$$$ at%%% their&&& ends***", rules) == "punctuation"
    assert r.line_fault("Short head", rules) == "punctuation"
    assert r.line_fault("Copyright 2020. All Rights Reserved.", rules) == "boilerplate"
    assert r.clean(f"{good}\nhome | news | sport\n\n{good}", rules)[0] == f"{good}\n\n{good}"


def test_documents_that_lose_too_much_go(spark):
    good = "The first of several plain sentences of a text says enough words. "
    rows = [(1, good * 1 + "Another one follows here and says more.\nhome | news"), (2, "menu | home | news | sport | weather | travel | food | more | login | help\n" + good)]
    got = {x["doc_id"]: x["kept"] for x in r.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}
