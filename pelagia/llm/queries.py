"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pelagia.llm.chat import OP9_SQL, op9_chat_formatting
from pelagia.llm.decontamination import op4_decontamination
from pelagia.llm.embedding_duplicates import OP11_SQL, op11_embedding_duplicates
from pelagia.llm.filter_audit import OP12_SQL, op12_filter_audit
from pelagia.llm.html import op3_html_extraction
from pelagia.llm.mixing import op2_mixing
from pelagia.llm.neighbours import op8_nearest_neighbours
from pelagia.llm.secrets import op1_secret_scans
from pelagia.llm.sharding import op10_sharding
from pelagia.llm.simhash import op6_simhash
from pelagia.llm.spelling import op13_spelling_variants
from pelagia.llm.substrings import op5_repeated_substrings
from pelagia.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_repeated_substrings": op5_repeated_substrings,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_sharding": op10_sharding,
    "op11_embedding_duplicates": op11_embedding_duplicates,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op9_chat_formatting": OP9_SQL, "op11_embedding_duplicates": OP11_SQL, "op12_filter_audit": OP12_SQL}
