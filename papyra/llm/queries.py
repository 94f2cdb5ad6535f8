"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .alignment import op13_tokenizer_alignment
from .ann import op10_nearest_neighbours
from .bpe import op7_bpe_codec
from .chat import OP2_SQL, op2_chat_format
from .decontamination import OP9_SQL, op9_decontamination
from .html_text import op11_html_extraction
from .line_dedup import OP4_SQL, op4_line_dedup
from .near_dup import op5_near_duplicates
from .quality import op8_quality_classifier
from .token_counts import op6_token_counts
from .toxicity import op3_toxicity
from .warc import OP1_SQL, op1_warc_derivatives
from .whitening import op12_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_chat_format, op3_toxicity, op4_line_dedup, op5_near_duplicates, op6_token_counts, op7_bpe_codec, op8_quality_classifier, op9_decontamination, op10_nearest_neighbours, op11_html_extraction, op12_embedding_whitening, op13_tokenizer_alignment)}

#: DuckDB SQL by query.
ORACLES: dict[str, str] = {"op1_warc_derivatives": OP1_SQL, "op2_chat_format": OP2_SQL, "op4_line_dedup": OP4_SQL, "op9_decontamination": OP9_SQL}
