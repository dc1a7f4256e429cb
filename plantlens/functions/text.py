"""Text columns: chunking, categories, context and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shortest chunk kept, document suffix, category rules in order, answer template.
MIN_CHUNK = 40
DOCUMENT_SUFFIX = ".pdf"
CATEGORY_RULES = [
    ("Government Policy", ["policy", "regulation", "gov"]),
    ("Safety & Standards", ["safety", "compliance"]),
    ("Technical Report", ["report"]),
    ("User Manual", ["manual"]),
]
DEFAULT_CATEGORY = "General Document"
UNKNOWN_SOURCE = "Unknown.pdf"

PROMPT_TEMPLATE = """
You are an automotive compliance assistant.

You must answer STRICTLY based on the context snippets below.
If the context does NOT contain the answer, reply:
"❗ The knowledge base does not contain information about this."

Each snippet is prefixed with its source. DO NOT use outside knowledge.

---------------- CONTEXT SNIPPETS ----------------
{context}
--------------------------------------------------

User Question: {question}

Provide:
1. A precise answer using only the snippets.
2. Cite the snippet sources you used.
"""

# Fixed value: every character that counts as white space at the ends of a line.
WHITE_SPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def chunk_lines(df: DataFrame, text: str, keep: list[str], min_len: int = MIN_CHUNK) -> DataFrame:
    """Stripped lines of at least ``min_len`` characters, with their line number.

    Works on whole texts and on single pages alike: pages joined by a newline split into the
    same lines, so a document's pages need not be gathered into one row first.
    """
    lines = df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("line", "raw"))
    return (
        lines.withColumn("chunk", strip(F.col("raw"))).where(F.length("chunk") >= min_len).select(*keep, "line", "chunk")
    )


def document_category(name: Column) -> Column:
    """First rule with a keyword in the lower-cased name."""
    lowered = F.lower(name)
    chain = None
    for category, words in CATEGORY_RULES:
        hit = lowered.rlike("|".join(words))
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return chain.otherwise(DEFAULT_CATEGORY)


def document_stem(name: Column) -> Column:
    """Lower-cased name without its suffix, as it is looked for in a question."""
    return F.replace(F.lower(name), F.lit(DOCUMENT_SUFFIX), F.lit(""))


def complete_hits(hits: DataFrame) -> DataFrame:
    """Source, paragraph and score of a hit with their defaults; ``text`` stands in for ``paragraph``."""
    have = set(hits.columns)

    def either(names: list[str], default: Column) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in have], default)

    return hits.withColumns(
        {
            "source": either(["source"], F.lit(UNKNOWN_SOURCE)),
            "paragraph": either(["paragraph", "text"], F.lit("")),
            "score": either(["score"], F.lit(0.0)).cast("double"),
        }
    )


def context_by_query(hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Each question's snippets in rank order joined by blank lines (at most k per question)."""
    snippet = F.format_string("[SOURCE: %s | SCORE: %.2f]\n%s", "source", "score", "paragraph")
    ranked = hits.select(query_key, F.struct("rank", snippet.alias("snippet")).alias("s"))
    return ranked.groupBy(query_key).agg(
        F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list("s")), lambda s: s["snippet"])).alias("context")
    )


def answer_prompt(context: Column, question: Column) -> Column:
    before, rest = PROMPT_TEMPLATE.split("{context}")
    middle, after = rest.split("{question}")
    return F.concat(F.lit(before), context, F.lit(middle), question, F.lit(after))


