"""Training-data operators: tokens, language models, near duplicates, search, mixing, decontamination.

Each module holds one operator: a general interface (DataFrame in, DataFrame
or files out) and a thin ``op<N>_<name>(spark, sf_dir)`` query over its whole
intended table. ``queries`` lists them. Nothing outside this package imports it.
"""
