"""Row-level operators applied to streaming DataFrames."""
