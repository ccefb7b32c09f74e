"""The operators' registered queries, each over the whole of its tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, secrets, substring
from .decontamination import op10_decontamination
from .html import op4_html_text
from .packing import op7_packing
from .secrets import op5_secret_scan
from .sharding import op8_kd_sharding
from .simhash import op1_simhash
from .substring import op9_substring_dedup
from .tokens import op6_token_counts
from .toxicity import op2_toxicity
from .winnowing import op3_winnowing

QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_winnowing, op4_html_text, op5_secret_scan, op6_token_counts, op7_packing, op8_kd_sharding, op9_substring_dedup, op10_decontamination)}

ORACLE_SQL: dict[str, str] = {
    "op5_secret_scan": secrets.ORACLE_SQL,
    "op9_substring_dedup": substring.ORACLE_SQL,
    "op10_decontamination": decontamination.ORACLE_SQL,
}
