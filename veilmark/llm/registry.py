"""The queries of this folder, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm.alignment import op11_tokenizer_alignment
from veilmark.llm.ann import op7_nearest_neighbours
from veilmark.llm.centroids import OP12_SQL, op12_centroid_clustering
from veilmark.llm.chat_format import OP2_SQL, op2_chat_formatting
from veilmark.llm.embedding_dedup import op5_embedding_near_dedup
from veilmark.llm.language_id import op6_language_id
from veilmark.llm.mixing import OP8_SQL, op8_mixing
from veilmark.llm.ngram_join import op3_ngram_jaccard_join
from veilmark.llm.packing import op1_best_fit_packing
from veilmark.llm.pieces import op13_sentencepiece
from veilmark.llm.pii import op4_personal_data
from veilmark.llm.quality import op10_quality_classifier
from veilmark.llm.token_files import op9_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_personal_data": op4_personal_data,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_mixing": op8_mixing,
    "op9_token_files": op9_token_files,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLES: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op8_mixing": OP8_SQL, "op12_centroid_clustering": OP12_SQL}
