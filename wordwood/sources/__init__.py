"""Reading, writing and generating datasets."""

from wordwood.sources.datasets import (
    FEATURE_COLS,
    FEATURE_SCHEMA,
    copy_dataset,
    dataset_path,
    ensure_dataset,
    from_pandas,
    lines_df,
    read_dataset,
    read_lines,
    read_sizes,
    write_dataset,
    write_lines,
    write_size,
    write_sizes,
)
from wordwood.sources.generate import (
    add_classification,
    add_sample_lines,
    gen_classification,
    gen_sample_lines,
    gen_text,
    text_line_count,
    text_lines,
)
from wordwood.sources.replace import replace, restore
from wordwood.sources.scratch import drop_path, drop_scratch, scratch_path
from wordwood.sources.sizing import files_of, row_bytes, stored_bytes, table_bytes

__all__ = [
    "FEATURE_COLS",
    "FEATURE_SCHEMA",
    "add_classification",
    "add_sample_lines",
    "copy_dataset",
    "dataset_path",
    "drop_path",
    "drop_scratch",
    "ensure_dataset",
    "files_of",
    "from_pandas",
    "gen_classification",
    "gen_sample_lines",
    "gen_text",
    "lines_df",
    "read_dataset",
    "read_lines",
    "read_sizes",
    "replace",
    "restore",
    "row_bytes",
    "scratch_path",
    "stored_bytes",
    "table_bytes",
    "text_line_count",
    "text_lines",
    "write_dataset",
    "write_lines",
    "write_size",
    "write_sizes",
]
