"""A DataFrame-first engine for bibliographic record pipelines."""
