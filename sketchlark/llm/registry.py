"""The subpackage's queries and, where SQL expresses them, their SQL."""

from __future__ import annotations

from sketchlark.llm.html import op9_html
from sketchlark.llm.jaccard import op2_jaccard
from sketchlark.llm.language import op8_language
from sketchlark.llm.lines import op6_lines
from sketchlark.llm.mixing import op5_mixing
from sketchlark.llm.oracles import ORACLES  # noqa: F401
from sketchlark.llm.packing import op10_packing
from sketchlark.llm.quality import op4_quality
from sketchlark.llm.sharding import op1_sharding
from sketchlark.llm.tokens import op7_tokens
from sketchlark.llm.vectors import op3_vectors

QUERIES = {f.__name__: f for f in (op1_sharding, op2_jaccard, op3_vectors, op4_quality, op5_mixing, op6_lines, op7_tokens, op8_language, op9_html, op10_packing)}
