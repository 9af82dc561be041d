"""Operators for training-data pipelines, each a Spark job over whole tables.

``chat`` (chat formatting), ``tokens`` (token-id files), ``html`` (main text of
pages), ``pieces`` (SentencePiece n-best), ``tiling`` (benchmark
decontamination), ``topk`` (exact vector search), ``langid`` (language of
pages), ``substrings`` (substring dedup), ``neardup`` (near-duplicate groups),
``quality`` (importance resampling).  Nothing outside this subpackage and
``corpus_pipeline.py`` imports it.
"""
