"""Queries of this folder and their SQL twins."""

from __future__ import annotations

from rankloom.llm import (
    class_model,
    kmeans_tree,
    line_cleaning,
    mixing,
    near_copies,
    packing,
    periodic_runs,
    personal_data,
    product_grid,
    spelling_variants,
    token_counts,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_packing": packing.op2_packing,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_mix": mixing.op4_mix,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_vectors": product_grid.op7_near_vectors,
    "op8_kmeans_tree": kmeans_tree.op8_kmeans_tree,
    "op9_class_model": class_model.op9_class_model,
    "op10_near_copies": near_copies.op10_near_copies,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_line_cleaning": line_cleaning.op12_line_cleaning,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}
TWINS = {**url_filter.SQL, **mixing.SQL, **line_cleaning.SQL, **spelling_variants.SQL}
