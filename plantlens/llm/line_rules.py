"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import WordHashes, join_hash, query, record_batch, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript",
    "lorem ipsum", "click here", "subscribe to our", "sign up for our", "log in to", "skip to content", "back to top", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "tous droits réservés", "politique de confidentialité", "todos los derechos reservados",
    "política de privacidad", "все права защищены", "политика конфиденциальности", "جميع الحقوق محفوظة", "سياسة الخصوصية", "सर्वाधिकार सुरक्षित",
    "版权所有", "隐私政策", "版權所有", "プライバシーポリシー", "無断転載", "สงวนลิขสิทธิ์", "นโยบายความเป็นส่วนตัว",
)
#: RE2 understands these as well, so SQL uses the same patterns.
JUNK_WORD = r"[#*$%&|<>!]{2,}$"
SEPARATOR_WORD = r"^[|<>»•·/]+$"
TERMINAL = r"[.!?…:;,\"'”’»)\]。！？；：，、．｡」』）】》〉।॥؟؛،۔።៕។။๚๛]$"
#: Characters of scripts that put no spaces between words: Thai and Lao, Burmese, Khmer, kana, Han (with its extensions).
UNSPACED = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))) + "]"
WORD = re.compile(f"[^{SPACE}]+")
UNSPACED_CHAR = re.compile(UNSPACED)
SUSPECT = re.compile("[#*$%&|<>!»•·/]")


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules.

    ``max_junk``: share of a line's words that may end in two or more symbols or exclamation marks (punctuation rule).
    ``short_words``: a line of fewer words must end in closing punctuation (punctuation rule).
    ``max_separators``: share of words that may be separators such as ``|`` (navigation rule).
    ``chars_per_word``: so many characters of a script without spaces count as one more word in the two rules about a line's width.
    ``boilerplate``: a line of at most ``boilerplate_words`` words must not hold such a phrase (A-Z in lower case).
    ``max_lost``: share of a document's word characters that may go with its failing lines.
    """

    max_junk: float = 0.3
    short_words: int = 6
    chars_per_word: int = 3
    max_separators: float = 0.2
    boilerplate: tuple[str, ...] = BOILERPLATE
    boilerplate_words: int = 40
    max_lost: float = 0.3
    min_words: int = 10
    max_repeat_percent: int = 20


def line_fault(line: str, rules: LineRules) -> str | None:
    """The rule that a line with words fails, if any."""
    # str.split() also splits at control characters and at spaces beyond ASCII, which are parts of words here.
    plain = line.isascii()
    words = line.split() if plain and line.isprintable() else WORD.findall(line)
    width = len(words) if plain else len(words) + len(UNSPACED_CHAR.findall(line)) // rules.chars_per_word
    if SUSPECT.search(line):
        separators = sum(1 for w in words if re.search(SEPARATOR_WORD, w))
        if separators > rules.max_separators * len(words):
            return "navigation"
        if sum(1 for w in words if re.search(JUNK_WORD, w)) > rules.max_junk * len(words):
            return "punctuation"
    if width < rules.short_words and not re.search(TERMINAL, words[-1]):
        return "punctuation"
    if width <= rules.boilerplate_words:
        low = lower(line)
        if any(phrase in low for phrase in rules.boilerplate):
            return "boilerplate"
    return None


UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(UPPER)


def word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in SPACE)


def clean(text: str, rules: LineRules) -> tuple[str, int, int]:
    """The text without failing lines, the number of such lines and the word characters that went with them."""
    kept, faults, lost = [], 0, 0
    for line in text.split("\n"):
        chars = word_chars(line)
        if chars and line_fault(line, rules) is not None:
            faults += 1
            lost += chars
        else:
            kept.append(line)
    return "\n".join(kept), faults, lost


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, first occurrences included."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    window = hashes[:n]
    for k in range(1, width):
        window = join_hash(window, hashes[k : k + n])
    _, back, times = np.unique(window, return_inverse=True, return_counts=True)
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    starts = np.flatnonzero(times[back] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            n += line in seen
            seen.add(line)
    return n


SHAPE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, lost_chars long, cleaned string"


def measure(rules: LineRules, with_text: bool):
    schema = pa.schema(
        [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
         ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_bad_lines", pa.int64()), ("lost_chars", pa.int64()), ("cleaned", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                words = text.encode("utf-8", "surrogatepass").split()
                chars = word_chars(text)
                repeat = repeated_words(known.of(words))
                failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
                cleaned, faults, lost = clean(text, rules)
                kept = not failed and lost <= rules.max_lost * chars
                rows.append((key, len(words), chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), repeat, failed, kept, faults, lost, cleaned if with_text else None))
            if rows:
                yield record_batch(schema, [*map(list, zip(*rows, strict=True))])

    return run


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), id_column: str = "doc_id", text_column: str = "text", with_text: bool = True) -> DataFrame:
    """Figures, verdict and cleaned text of every row; a projection without any shuffle.

    A line of control characters is a line with a word. NULL text counts as empty, and a text without words fails the base rule. Repeated rows give repeated results, an empty table
    gives none; no column but id and text is read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    out = rows.mapInArrow(measure(rules, with_text), SHAPE)
    return out if with_text else out.drop("cleaned")


def _sql(rules: LineRules) -> str:
    ws = r"[\x20\x09-\x0D]+"
    phrases = " OR ".join(f"contains(low, '{p}')" for p in rules.boilerplate)
    terminal, junk, separator = (p.replace("'", "''") for p in (TERMINAL, JUNK_WORD, SEPARATOR_WORD))
    lower_az = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
      w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{ws}'), lambda x: x <> '') AS words FROM d),
      g AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
      c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
      rep AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM c WHERE n > 1) GROUP BY r),
      l AS (SELECT r, line, k, {lower_az} AS low, list_filter(regexp_split_to_array(line, '{ws}'), lambda x: x <> '') AS words
            FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d)),
      j AS (SELECT *, len(words) AS n, len(words) + len(regexp_replace(line, '{UNSPACED.replace('[', '[^', 1)}', '', 'g')) // {rules.chars_per_word} AS width, len(array_to_string(words, '')) AS chars,
            len(list_filter(words, lambda x: regexp_matches(x, '{separator}'))) AS seps, len(list_filter(words, lambda x: regexp_matches(x, '{junk}'))) AS junk,
            row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth FROM l WHERE len(words) > 0),
      f AS (SELECT *, seps > {rules.max_separators}::DOUBLE * n OR junk > {rules.max_junk}::DOUBLE * n
              OR width < {rules.short_words} AND NOT regexp_matches(words[-1], '{terminal}') OR width <= {rules.boilerplate_words} AND ({phrases}) AS bad FROM j),
      a AS (SELECT r, sum(chars) AS word_chars, count(*) FILTER (nth > 1) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines,
            coalesce(sum(chars) FILTER (bad), 0) AS lost_chars FROM f GROUP BY r),
      o AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
            (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines, coalesce(lost_chars, 0)::BIGINT AS lost_chars
            FROM w LEFT JOIN rep USING (r) LEFT JOIN a USING (r)),
      b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM o)
    SELECT *, NOT base_failed AND lost_chars <= {rules.max_lost}::DOUBLE * word_chars AS kept FROM b"""


@query(_sql(LineRules()))
def op2_line_rules(spark, sf):
    return clean_documents(table(spark, sf, "documents"), with_text=False)
