"""The corpus queries and their SQL, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extract, langid, mixing, mpeg, packing, prefixtrie, quality, simhash, topk, toxicity, urlfilter, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract": extract.op1_extract,
    "op2_mixing": mixing.op2_mixing,
    "op3_media": mpeg.op3_media,
    "op4_langid": langid.op4_langid,
    "op5_urlfilter": urlfilter.op5_urlfilter,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_topk": topk.op9_topk,
    "op10_packing": packing.op10_packing,
    "op11_variants": variants.op11_variants,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_prefixtrie": prefixtrie.op13_prefixtrie,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL,
    "op5_urlfilter": urlfilter.OP5_SQL,
    "op9_topk": topk.OP9_SQL,
    "op11_variants": variants.OP11_SQL,
    "op12_decontaminate": decontaminate.OP12_SQL,
    "op13_prefixtrie": prefixtrie.OP13_SQL,
}
