import hashlib
import re
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantlens.llm import chat_format, license_scan, revisits
from tests.llm.fixtures import documents, empty


# ---------------------------------------------------------------- licences


def grams(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return {" ".join(p) for p in zip(w, w[1:])}


def test_licences_equal_brute_force(spark):
    notice = license_scan.TEMPLATES[3][1]
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text."),
        (1, "released   under THE mit license"),
        (2, "intro\n\n" + notice.replace(", ", ",\n") + "\n\nend"),
        (3, "This work is licenced under the GNU General Public License, version 3."),
        (4, None), (5, ""), (6, "All rights reserved. " * 3), (7, "word"), (None, "Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(3))
    want = []
    for key, text in rows:
        units = [("line", i, x) for i, x in enumerate((text or "").split("\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(re.split(r"\n[ \t\r]*\n", text or "")) if "\n" in x]
        for unit, place, part in units:
            for k, (name, template) in enumerate(license_scan.TEMPLATES):
                a, b = grams(part), grams(template)
                dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if dice >= license_scan.THRESHOLD:
                    want.append((key, unit, place, name, k, round(dice, 9)))
    got = [(r["doc_id"], r["unit"], r["place"], r["license_id"], r["template"], round(r["dice"], 9)) for r in license_scan.license_matches(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) >= 6
    assert license_scan.license_matches(empty(spark)).count() == 0
    assert license_scan.license_matches(documents(spark)).count() == 0


def test_a_repeated_notice_of_any_length_is_found(spark):
    many = "All rights reserved. " * 700
    other = " ".join(f"word{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, many), (2, many.replace(". ", ".\n")), (3, other), (4, other + " All rights reserved.")], "doc_id long, text string")
    got = {(r["doc_id"], r["unit"], r["license_id"]) for r in license_scan.license_matches(docs).where("unit = 'paragraph' or doc_id != 2").collect()}
    assert got == {(1, "line", "All-Rights-Reserved"), (2, "paragraph", "All-Rights-Reserved")}


def test_size_bounds_lose_no_template():
    for n in range(1, 40):
        sizes = license_scan.size_range(n, 0.7)
        for m in range(1, 120):
            assert (2 * min(n, m) / (n + m) >= 0.7 - 1e-12) == (m in sizes)


# ---------------------------------------------------------------- revisits


def test_urls(spark):
    cases = {
        "HTTP://WWW.Example.org:80/a/B/?b=2&utm_source=x&a=1#top": "example.org/a/B?a=1&b=2",
        "https://example.org": "example.org", "example.org/?ref=z": "example.org", "": "",
    }
    df = spark.createDataFrame([(u, k) for u, k in cases.items()], "url string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", revisits.canonical_url(F.col("url"))).collect())


def test_revisits_equal_a_scan_in_order(spark):
    import random

    rng = random.Random(8)
    rows = []
    for i in range(400):
        kind = "response" if rng.random() < 0.3 else "revisit"
        heads = {}
        if rng.random() < 0.7:
            heads["ETag" if rng.random() < 0.5 else "etag"] = rng.choice(['"a"', 'W/"a"', '"b"'])
        if rng.random() < 0.5:
            heads["Last-Modified"] = rng.choice(["x", "y"])
        heads["Date"], heads["X-Own"] = str(i), kind
        url = None if i % 50 == 0 else "" if i % 51 == 0 else f"http://h{0 if rng.random() < 0.5 else rng.randrange(5)}.org/"
        rows.append((i, url, None if i % 40 == 0 else rng.randrange(60), kind, None if i % 45 == 0 else heads, rng.choice([None, "p", "q"])))
    rows.append(rows[7])
    df = spark.createDataFrame(rows, "capture_id long, url string, ts long, kind string, headers map<string,string>, digest string").withColumn("slice", F.lit(1)).repartition(4)
    want, last = [], {}
    for cid, url, ts, kind, heads, digest in sorted(rows, key=lambda r: (-(1 << 62) if r[2] is None else r[2], r[0])):
        key = (url or "").removeprefix("http://").rstrip("/") if url is not None else None
        own = {k.lower(): v for k, v in (heads or {}).items()}
        if kind == "response":
            if key:
                last[key] = (cid, own, digest)
            continue
        found = last.get(key)
        if found is None:
            want.append((cid, key, None, "no_response", own))
            continue
        rid, there, d = found
        tag, other = (h.get("etag", "").removeprefix("W/") or None for h in (own, there))
        pairs = [(tag, other), (own.get("last-modified"), there.get("last-modified")), (digest, d)]
        same = next((a == b for a, b in pairs if a is not None and b is not None), None)
        outcome = "unverified" if same is None else "resolved" if same else "mismatch"
        merged = there | {k: v for k, v in own.items() if k in revisits.PERMITTED}
        want.append((cid, key, rid, outcome, own if outcome == "mismatch" else merged))
    for length in (10_000, 7):
        got = [(r["capture_id"], r["url_key"], r["response_id"], r["outcome"], r["headers"]) for r in revisits.resolve_revisits(df, length).collect()]
        assert sorted(map(str, got)) != [] and sorted(got, key=lambda r: (r[0], str(r))) == sorted(want, key=lambda r: (r[0], str(r))) or _differences(got, want) == []


def _differences(got, want):
    plain = lambda rows: sorted((a, str(b), str(c), d, tuple(sorted(e.items()))) for a, b, c, d, e in rows)
    return [(g, w) for g, w in zip(plain(got), plain(want), strict=True) if g != w]


def test_no_captures(spark):
    df = spark.createDataFrame([], "capture_id long, url string, ts long, kind string, headers map<string,string>, digest string")
    assert revisits.resolve_revisits(df).count() == 0


# ---------------------------------------------------------------- chat


CHAT = st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "<", "[", "/", "|", "ok", "\n", "<|end|>", "é", "s>", "INST]"]), max_size=12).map("".join)


@given(CHAT)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    out = chat_format.escape(text)
    assert chat_format.unescape(out) == text and not any(c in out for c in chat_format.CONTROLS)
    piece, start, length = chat_format.render("user", text, chat_format.Template())
    assert chat_format.parse(piece, chat_format.Template()) == ("user", text) and chat_format.unescape(piece[start : start + length]) == text


def test_events_fold_in_sequence(spark):
    events = [
        (1, 0, 3, "delta", None, "lo"), (1, 0, 1, "open", "user", None), (1, 0, 2, "delta", None, "hel"), (1, 0, 2, "delta", None, "hel"),
        (1, 1, 5, "open", "assistant", None), (1, 1, 6, "delta", None, "bad"), (1, 1, 7, "regenerate", None, None), (1, 1, 8, "delta", None, "good"),
        (1, 0, 9, "edit", None, "hi"), (1, 2, 10, "open", "user", None), (1, 2, 11, "remove", None, None), (1, 3, 12, "delta", None, "no role"),
        (None, 0, 1, "open", "assistant", None), (None, 0, 2, "delta", None, None), (2, None, 1, "open", "a\nb<c", None),
    ]
    df = spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, role string, text string").withColumn("part", F.lit("x")).repartition(5)
    pieces = chat_format.format_conversations(df)
    got = {(r["conv_id"], r["message"]): (*chat_format.parse(r["formatted"], chat_format.Template()), r["loss_start"] is not None) for r in pieces.collect()}
    assert got == {(1, 0): ("user", "hi", False), (1, 1): ("assistant", "good", True), (1, 3): ("", "no role", False), (None, 0): ("assistant", "", True), (2, None): ("a\nb<c", "", False)}
    assert chat_format.format_conversations(df.limit(0)).count() == 0 and chat_format.read_back(pieces.limit(0)).count() == 0


def test_digests_of_a_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"[INST] {t} \\ </s>" if t % 7 else None) for t in range(700)] + [(2, 0, "user", "x"), (2, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0)).repartition(6)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(chat_format.events_of(turns))).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((role, text or ""))
    for c, own in by.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
