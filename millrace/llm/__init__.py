"""Training-data operators: one module each, over the tables ``documents``, ``pages`` and ``embeddings``.

Nothing outside this package imports it.
"""
