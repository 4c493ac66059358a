"""Corpus-preparation operators for large training sets.

Every operator is a DataFrame-in, DataFrame-out function; ``queries`` in
``grainmill.llm.queries`` wraps each with its production parameters.
"""
