"""The corpus queries by name, and their SQL statements."""

from __future__ import annotations

from .q_alignment import op13_tokenizer_alignment
from .q_conversations import op12_conversation_repair
from .q_fingerprints import op9_fingerprints
from .q_language import op7_language
from .q_licenses import op10_license_scan
from .q_neighbours import OP4_SQL, op4_jaccard_join
from .q_packing import op3_packing
from .q_quality import op8_quality
from .q_rules import OP5_SQL, op5_quality_rules
from .q_secrets import op1_secret_scan
from .q_segments import op6_sampled_segmentations
from .q_tokens import op11_token_counts
from .q_toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_packing, op4_jaccard_join, op5_quality_rules, op6_sampled_segmentations, op7_language, op8_quality, op9_fingerprints, op10_license_scan,
                                 op11_token_counts, op12_conversation_repair, op13_tokenizer_alignment)}
ORACLE = {"op4_jaccard_join": OP4_SQL, "op5_quality_rules": OP5_SQL}
