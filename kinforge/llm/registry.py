"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op10_decontam, op11_kd_search, op13_dual_tree
from .op1_toxicity import op1_toxicity
from .op2_tokens import op2_token_counts
from .op3_quotes import op3_quotation_links
from .op4_packing import op4_packing
from .op5_neighbours import op5_nearest_neighbours
from .op6_near_dedup import op6_near_dedup
from .op7_lines import op7_line_dedup
from .op8_mixing import op8_mixing
from .op9_pii import op9_pii_surrogates
from .op10_decontam import op10_decontamination
from .op11_kd_search import op11_exact_search
from .op12_runs import op12_periodic_runs
from .op13_dual_tree import op13_dual_tree_clusters

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_quotation_links": op3_quotation_links,
    "op4_packing": op4_packing,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_near_dedup": op6_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_decontamination": op10_decontamination,
    "op11_exact_search": op11_exact_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_dual_tree_clusters": op13_dual_tree_clusters,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op10_decontamination": op10_decontam.SQL, "op11_exact_search": op11_kd_search.SQL, "op13_dual_tree_clusters": op13_dual_tree.SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
