"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .op1_language import op1_language
from .op10_ann import op10_ann
from .op2_token_counts import op2_token_counts
from .op3_simhash import op3_simhash
from .op4_licenses import op4_licenses
from .op5_mix import SQL as _MIX, op5_mix
from .op6_toxicity import op6_toxicity
from .op7_fingerprints import op7_fingerprints
from .op8_bpe import op8_bpe
from .op9_pst import op9_pst

QUERIES = {f.__name__: f for f in (op1_language, op2_token_counts, op3_simhash, op4_licenses, op5_mix, op6_toxicity, op7_fingerprints, op8_bpe, op9_pst, op10_ann)}
ORACLES: dict[str, str] = {"op5_mix": _MIX}
