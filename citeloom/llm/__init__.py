"""Training-data operators: near-duplicate joins, tokenizers, filters, extraction and formatting.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only if it is there.
"""
