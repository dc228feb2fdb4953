"""Registry of this subpackage's queries and their SQL counterparts."""

from __future__ import annotations

from tessera.llm.bpe import op8_bpe_encoding
from tessera.llm.chat import op4_chat_format
from tessera.llm.dedup import op6_suffix_dedup
from tessera.llm.fingerprints import op10_fingerprints
from tessera.llm.html import op5_html_extraction
from tessera.llm.jaccard import op3_jaccard_join
from tessera.llm.oracles import OP3, OP4, OP7
from tessera.llm.packing import op1_packing
from tessera.llm.pii import op9_pii
from tessera.llm.quality import op7_quality_rules
from tessera.llm.secrets import op2_secret_scan

QUERIES: dict = {
    "op1_packing": op1_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_chat_format": op4_chat_format,
    "op5_html_extraction": op5_html_extraction,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe_encoding": op8_bpe_encoding,
    "op9_pii": op9_pii,
    "op10_fingerprints": op10_fingerprints,
}
#: SQL can't express the tokenizers, fingerprints, matches' places or suffix arrays of the others; tests compare those with plain Python.
ORACLES: dict = {"op3_jaccard_join": OP3, "op4_chat_format": OP4, "op7_quality_rules": OP7}
