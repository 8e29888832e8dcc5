"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .hmm import op10_hmm
from .linededup import OP2_SQL, op2_line_spread
from .packing import op8_karmarkar_karp
from .pii import op4_boosted_pii
from .quality import OP9_SQL, op9_host_quality
from .sharding import op6_ring_sharding
from .simhash import op5_simhash_ball
from .topk import OP1_SQL, op1_threshold_topk
from .warc import OP3_SQL, op3_salvage_warc
from .wfst import op7_piece_wfst

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_threshold_topk, op2_line_spread, op3_salvage_warc, op4_boosted_pii, op5_simhash_ball, op6_ring_sharding, op7_piece_wfst, op8_karmarkar_karp, op9_host_quality, op10_hmm)}


def oracle_sql() -> dict[str, str]:
    return {"op1_threshold_topk": OP1_SQL, "op2_line_spread": OP2_SQL, "op3_salvage_warc": OP3_SQL, "op9_host_quality": OP9_SQL}
