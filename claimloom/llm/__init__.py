"""Training-data operators: WARC, language, chat, near-duplicates, quality, mixing, search, BPE.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when the subpackage can be imported.
"""
