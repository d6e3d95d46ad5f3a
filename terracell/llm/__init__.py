"""Training-data operators: tokens, language, quality, media, sharding, packing, language models, near duplicates.

One module per operator (``op01_token_orc`` .. ``op10_circulant_minhash``); ``queries`` holds the registered queries
and their SQL.  Nothing outside this package imports it.
"""
