"""grainmill: the data side of language-model training as Spark DataFrames.

Sub-packages: ``operators`` (packing, blending, sharding, collation, statistics,
selection ...), ``sources`` (token-file data sources), ``functions`` (column
expressions), ``plans`` (the query registry), ``streaming`` and ``llm``
(corpus-preparation operators; nothing outside ``llm`` imports it).
"""
