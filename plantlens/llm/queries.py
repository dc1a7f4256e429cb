"""All registered queries of the text operators; importing this module registers them."""

from plantlens.llm import (  # noqa: F401
    chat_format,
    decontaminate,
    license_scan,
    line_rules,
    lm_score,
    ngram_join,
    periodic_runs,
    piece_codec,
    pu_quality,
    revisits,
    sequence_pack,
    source_audit,
    toxicity,
)
from plantlens.llm.common import QUERIES, SQL  # noqa: F401
