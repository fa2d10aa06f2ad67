"""Training-data pipeline operators: quality, near duplicates, sharding, secrets, chat, HTML, packing, URLs, leaks.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so it can be removed as a whole.
"""
