"""The queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from .byte_bpe import op8_byte_bpe
from .common import on_executors
from .html_extract import op1_html_extract
from .media import op7_media
from .minhash import op2_order_minhash
from .nn_descent import op3_nn_descent
from .packing import op5_pattern_packing
from .pii import op10_feistel_pii
from .quality import op4_importance_resampling
from .token_files import op6_token_files
from .url_filter import ORACLE_SQL as URL_SQL
from .url_filter import op9_url_filter


def _ready(f):
    def run(spark, sf_dir):
        on_executors(spark)
        return f(spark, sf_dir)

    return run


_ALL = {
    "op1_html_extract": op1_html_extract,
    "op2_order_minhash": op2_order_minhash,
    "op3_nn_descent": op3_nn_descent,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_pattern_packing": op5_pattern_packing,
    "op6_token_files": op6_token_files,
    "op7_media": op7_media,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_feistel_pii": op10_feistel_pii,
}
QUERIES = {name: _ready(f) for name, f in _ALL.items()}
ORACLE_SQL = {"op9_url_filter": URL_SQL}
