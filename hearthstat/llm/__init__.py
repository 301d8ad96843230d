"""Corpus operators for training data: counting, scoring, matching, mixing and writing documents.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames;
``queries.py`` binds them to the ``documents`` tables of a data folder.
"""
