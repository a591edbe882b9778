"""Training-data operators: extraction, de-duplication, scoring, sanitising, packing and token files.

Nothing outside this subpackage imports it.  ``evidra.llm.queries`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
