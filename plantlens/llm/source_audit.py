"""Divergence between sources: how far the term shares of each source lie from those of the other sources of its language.

Every kept term (found in at least ``least_docs`` documents of its language) gets in a group a share p = 1 + floor(UNIT * (count + 1) / (N + V))
with N the group's count of kept terms and V their number; two shares differ by f(p, q) = floor((p - q)^2 / q). A pair of sources
is the sum of f over all kept terms. Most terms lie in few sources, so with z the share of an absent term

    sum f(p, q) = V f(zg, zh) + sum over g's terms [f(p, zh) - f(zg, zh)] + sum over h's terms [f(zg, q) - f(zg, zh)]
                + sum over common terms [f(p, q) - f(p, zh) - f(zg, q) + f(zg, zh)]

and only the last sum needs terms of two sources. Each term is a row of its sources with nonzero counts, in an order of the sources
by their number of terms; rows with equal starts share a path of a frequent-pattern tree. A node carries the number of rows below it, so the
last sum's part of a node and one of its ancestors is computed once, whatever the number of terms that share both.
Rows are sorted in ranges, so a task holds one path of the tree at a time; a node cut by a border of two ranges is two nodes whose
numbers add up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import query, table
from plantlens.session import cut

UNIT = 1_000_000_000
#: Letters of a term: ASCII letters, A-Z in lower case, and all bytes of characters beyond ASCII.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms that a counting task holds before it hands on what it has.
HELD_TERMS = 300_000
#: Node-ancestor combinations that are computed at a time.
COMBINATIONS = 1 << 19

COUNT_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PAIR_SCHEMA = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("value", pa.int64())])


def term_runs(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a text in runs of about ``size`` bytes, so that one long text is never a list of all its terms."""
    data = data.translate(TERM_BYTES)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + size)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document counts of terms per (lang, source), added up within the task; a row with a NULL term names each group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    seen: set[tuple] = set()

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms = list(times)
            for a in range(0, len(terms), 50_000):
                part = terms[a : a + 50_000]
                columns = [[lang] * len(part), [source] * len(part), pa.array(part, pa.binary()).cast(pa.string()), [times[t] for t in part], [docs[t] for t in part]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, COUNT_SCHEMA, strict=True)], schema=COUNT_SCHEMA)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            key = lang, source
            if key not in seen:
                seen.add(key)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((lang, source, None, 0, 0), COUNT_SCHEMA, strict=True)], schema=COUNT_SCHEMA)
            if key not in held:
                held[key] = Counter(), Counter()
            times, docs = held[key]
            mine: set[bytes] = set()
            for terms in term_runs(text.as_py()):
                times.update(terms)
                mine.update(terms)
            docs.update(mine)
        if sum(len(t) for t, _ in held.values()) > HELD_TERMS:
            yield from emit()
    yield from emit()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), exact beyond 64 bits; NULL without terms."""
    whole = F.nullif((total + terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), whole)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


@lru_cache(maxsize=4096)
def combinations(shared: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ancestor, node) places of the nodes beyond ``shared`` on a path of ``length`` nodes."""
    nodes = np.arange(shared, length)
    return np.concatenate([np.zeros(0, np.int64), *[np.arange(d) for d in nodes]]), np.repeat(nodes, nodes)


class Corrections:
    """Sums per ordered pair of sources over the node-ancestor combinations of one language."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0
        self.sums: dict[int, int] = {}

    def add(self, path: np.ndarray, shared: int, times: np.ndarray) -> None:
        """Close the nodes of ``path`` (rows: source, share, absent share) beyond ``shared``; ``times`` are their numbers of rows."""
        above, node = combinations(shared, path.shape[1])
        if len(node):
            self.parts.append((path[:, above], path[:, node], times[node]))
            self.waiting += len(node)
            if self.waiting > COMBINATIONS:
                self.compute()

    def compute(self) -> None:
        if not self.parts:
            return
        (o1, p1, z1), (o2, p2, z2) = (np.concatenate([part[i] for part in self.parts], axis=1) for i in (0, 1))
        times = np.concatenate([part[2] for part in self.parts])
        self.parts, self.waiting = [], 0
        for (og, p, zg), (oh, q, zh) in (((o1, p1, z1), (o2, p2, z2)), ((o2, p2, z2), (o1, p1, z1))):
            values = times * (distances(p, q) - distances(p, zh) - distances(zg, q) + distances(zg, zh))
            keys, back = np.unique(og << 32 | oh, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, back, values)
            for key, value in zip(keys.tolist(), sums.tolist(), strict=True):
                self.sums[key] = self.sums.get(key, 0) + value

    def batch(self, lang: str) -> pa.RecordBatch:
        self.compute()
        keys = list(self.sums)
        columns = [[lang] * len(keys), [k >> 32 for k in keys], [k & 0xFFFFFFFF for k in keys], list(self.sums.values())]
        self.sums = {}
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIR_SCHEMA, strict=True)], schema=PAIR_SCHEMA)


def walk_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insert sorted rows (lang, path, times) into the tree and close each node when the rows have left it."""
    lang, path, times, found = None, np.zeros((3, 0), np.int64), np.zeros(0, np.int64), Corrections()

    def close(shared: int) -> None:
        # A node's number of rows is that of all rows below it.
        below = np.cumsum(times[::-1])[::-1]
        found.add(path, shared, below)
        if 0 < shared <= len(below) - 1:
            times[shared - 1] += below[shared]

    for batch in batches:
        lists = batch.column(1)
        edges = lists.offsets.to_numpy()
        flat = np.stack([lists.values.field(i).to_numpy() for i in range(3)])
        for i, (name, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            new = flat[:, edges[i] : edges[i + 1]]
            shared = 0
            if name == lang:
                n = min(new.shape[1], path.shape[1])
                other = np.flatnonzero((new[:2, :n] != path[:2, :n]).any(axis=0))
                shared = int(other[0]) if len(other) else n
            close(shared)
            if name != lang or len(found.sums) > HELD_TERMS:
                if lang is not None:
                    yield found.batch(lang)
                lang = name
            times = np.concatenate([times[:shared], np.zeros(new.shape[1] - shared, np.int64)])
            path = new
            times[-1] += m
    close(0)
    if lang is not None:
        yield found.batch(lang)


def audit_sources(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence (part ``pair``), own terms beyond the language's share (``term``).

    NULL text, language and source count as ''. Each row is a document, repeated rows as well. Every group that occurs is compared with
    all other sources of its language, also without kept terms (value 0 if the language has none); an empty table gives no rows.
    Ties are ranked by item, in the order of UTF-8. No other column is read.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(lang_column), F.lit("")).alias("lang"), F.coalesce(F.col(source_column), F.lit("")).alias("source"), text.alias("text"))
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counted = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")
    kept = counted.where("term is not null").withColumns({"all_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
    kept = cut(kept.where(F.col("all_docs") >= least_docs).select("lang", "term", "source", "n", "lang_n"))

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    langs = sizes.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    langs = langs.join(kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v")), "lang")
    groups = counted.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("terms"), "source")).cast("long")
    groups = cut(groups.withColumns({"place": order, "z": share(F.lit(0), F.col("total"), F.col("v"))}))

    found = kept.join(groups.drop("terms"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    paths = found.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p", "z"))).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count("*").alias("times"))
    walked = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(walk_tree, "lang string, g long, h long, value long")

    one = groups.select("lang", F.col("place").alias("g"), F.col("z").alias("zg"), "v")
    two = groups.select("lang", F.col("place").alias("h"), F.col("z").alias("zh"))
    absent = distance(F.col("zg"), F.col("zh"))
    base = one.join(two, "lang").where("g <> h").select("lang", "g", "h", F.coalesce(F.col("v") * absent, F.lit(0)).alias("value"))
    shares = found.groupBy("lang", F.col("place").alias("g"), F.col("z").alias("zg"), "p").agg(F.count("*").alias("times"))
    single = shares.join(two, "lang").where("g <> h").select("lang", "g", "h", "times", "p", "zg", "zh")
    mine = single.select("lang", "g", "h", (F.col("times") * (distance(F.col("p"), F.col("zh")) - absent)).alias("value"))
    theirs = single.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), (F.col("times") * (distance(F.col("zh"), F.col("p")) - distance(F.col("zh"), F.col("zg")))).alias("value"))
    pairs = base.unionByName(mine).unionByName(theirs).unionByName(walked).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "place", "source")
    pairs = pairs.join(names.withColumnRenamed("place", "g"), ["lang", "g"]).join(names.select("lang", F.col("place").alias("h"), F.col("source").alias("item")), ["lang", "h"])

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = found.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [pairs.withColumns({"part": F.lit("pair"), "rank": rank}), terms.withColumns({"part": F.lit("term"), "rank": rank}).where(F.col("rank") <= most_terms)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select("lang", "source", "part", "item", "value", "rank")


def _sql(least_docs: int = 3, most_terms: int = 200) -> str:
    p = f"1 + {UNIT}::HUGEINT * ({{n}} + 1) // ({{total}} + v)"
    f = "(p - q) * (p - q) // q"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
      t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
      k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
      l AS (SELECT lang, count(*) AS v, sum(n) AS lang_total FROM k GROUP BY lang),
      g AS (SELECT DISTINCT lang, source FROM d),
      c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
      s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
      a AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, {p.format(n='coalesce(c.n, 0)', total='total')} AS p, {p.format(n='k.n', total='lang_total')} AS q
            FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
      x AS (SELECT one.lang, one.source, two.source AS item, sum({f.replace('p', 'one.p').replace('q', 'two.p')}) AS value
            FROM a AS one JOIN a AS two ON one.lang = two.lang AND one.term = two.term AND one.source <> two.source GROUP BY ALL),
      y AS (SELECT one.lang, one.source, two.source AS item, coalesce(value, 0) AS value FROM g AS one JOIN g AS two ON one.lang = two.lang AND one.source <> two.source
            LEFT JOIN x ON x.lang = one.lang AND x.source = one.source AND x.item = two.source),
      z AS (SELECT 'pair' AS part, * FROM y UNION ALL SELECT 'term', lang, source, term, {f} FROM a WHERE n > 0 AND p > q),
      o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= {most_terms}"""


@query(_sql())
def op13_source_audit(spark, sf):
    return audit_sources(table(spark, sf, "documents"))
