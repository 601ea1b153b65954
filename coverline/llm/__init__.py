"""Training-data operators: ten numbered jobs over documents, pages and embeddings.

Nothing outside this package imports it.
"""
