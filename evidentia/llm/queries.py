"""The subpackage's queries, by the name under which ``__spark_entry__`` registers them, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, prefix_trie
from .curve_search import op3_curve_search
from .decontamination import op12_decontamination
from .fingerprints import op5_fingerprints
from .jaccard_join import op1_ngram_jaccard_join
from .language_id import op8_language_id
from .license_scan import op4_license_scan
from .packing import op2_best_fit_packing
from .pieces import op7_sentencepiece
from .prefix_trie import op13_prefix_trie
from .sharding import op9_sharding
from .suffix_dedup import op6_suffix_dedup
from .token_alignment import op11_token_alignment
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_curve_search": op3_curve_search,
    "op4_license_scan": op4_license_scan,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_id": op8_language_id,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_decontamination": op12_decontamination,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard_join.SQL,
    "op12_decontamination": decontamination.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
