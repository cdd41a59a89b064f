"""Operators for building large training corpora (text, pages, embeddings).

Each module holds one operator with a general interface on DataFrames;
``queries`` registers one query per operator.  Nothing outside this package
(but ``corpus_pipeline.py`` and the guarded hook of ``__spark_entry__.py``)
imports it.  On a cluster the package must be importable by the Python workers
(``--py-files`` or installed on the executors).
"""
