"""Training-data operators: deduplication, filtering, mixing, packing, search.

Nothing outside this subpackage imports it.  Every module keeps a general
operator (texts, spans, files) and the ``queries`` module derives the thin
``opN_*`` result tables from those operators.
"""
