"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op13_alignment
from .decontaminate import op3_decontamination
from .linededup import OP8_SQL, op8_line_dedup
from .media import op9_media
from .mixing import op6_mixing
from .neardup import op7_near_duplicates
from .passages import OP12_SQL, op12_passages
from .quality import op2_quality
from .secrets import op4_secrets
from .sharding import op1_sharding
from .spelling import OP11_SQL, op11_spelling
from .tokencount import op5_tokens
from .urlfilter import op10_urls

QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_quality, op3_decontamination, op4_secrets, op5_tokens, op6_mixing, op7_near_duplicates, op8_line_dedup, op9_media, op10_urls, op11_spelling, op12_passages, op13_alignment)
}
ORACLES = {"op8_line_dedup": OP8_SQL, "op11_spelling": OP11_SQL, "op12_passages": OP12_SQL}
