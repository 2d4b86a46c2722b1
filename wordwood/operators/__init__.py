"""Operators: functions from DataFrame to DataFrame."""

from wordwood.operators.distribution import differences, distribution, is_classification
from wordwood.operators.forest import (
    accuracy_pct,
    assemble,
    beats_majority,
    conform,
    document_features,
    evaluate_forest,
    forest_sweep,
    score,
    train_forest,
    written_split,
)
from wordwood.operators.runlog import (
    RUN_LOG_SCHEMA,
    mask_failed,
    run_matrix,
    speedup,
    stage_summary,
)
from wordwood.operators.sampling import exact_split, hash_split, permute, preview
from wordwood.operators.sweeps import Journal, copies_sweep, text_sweep, upload_sweep
from wordwood.operators.text import (
    counts_diff,
    counts_match,
    distinct_words,
    text_size_mb,
    to_lines,
    token_total,
    tokenize,
    top_words,
    word_counts,
)
from wordwood.operators.treewalk import forest_nodes, walk_forest, walked_alike
from wordwood.operators.upscale import dense_index, number_copies, replicate, tile

__all__ = [
    "Journal",
    "RUN_LOG_SCHEMA",
    "accuracy_pct",
    "assemble",
    "beats_majority",
    "conform",
    "copies_sweep",
    "counts_diff",
    "counts_match",
    "dense_index",
    "differences",
    "distinct_words",
    "distribution",
    "document_features",
    "evaluate_forest",
    "exact_split",
    "forest_nodes",
    "forest_sweep",
    "hash_split",
    "is_classification",
    "mask_failed",
    "number_copies",
    "permute",
    "preview",
    "replicate",
    "run_matrix",
    "score",
    "speedup",
    "stage_summary",
    "text_size_mb",
    "text_sweep",
    "tile",
    "to_lines",
    "token_total",
    "tokenize",
    "top_words",
    "train_forest",
    "upload_sweep",
    "walk_forest",
    "walked_alike",
    "word_counts",
    "written_split",
]
