"""The queries of this subpackage and, where SQL can express them, the SQL."""

from __future__ import annotations

from .decontam import op10_decontamination
from .langid import op1_language_id
from .lexical import OP13_SQL, op13_lexical_search
from .packing import op11_best_fit
from .pieces import op4_sentencepiece
from .planes import op5_token_planes
from .repair import op12_conversation_repair
from .revisits import OP3_SQL, op3_revisits
from .sharding import OP6_SQL, op6_sharding
from .simhash import op2_simhash
from .token_counts import op7_token_counts
from .toxicity import op8_toxicity
from .winnowing import op9_winnowing

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_revisits": op3_revisits,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_planes": op5_token_planes,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_winnowing": op9_winnowing,
    "op10_decontamination": op10_decontamination,
    "op11_best_fit": op11_best_fit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op3_revisits": OP3_SQL,
    "op6_sharding": OP6_SQL,
    "op13_lexical_search": OP13_SQL,
}
