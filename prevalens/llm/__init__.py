"""Training-data operators: filtering, deduplication, mixing and packing of a text corpus.

Ten operators, one module each, plus ``registry`` (thin ``opN_*`` queries that
derive the reported digest columns) and ``oracle`` (DuckDB twins).  Nothing
outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` refers to it.
"""
