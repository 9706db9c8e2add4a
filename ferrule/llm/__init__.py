"""Jobs that prepare text corpora for language-model training.

Nothing else in the package imports this one.  Every operator takes and
returns DataFrames; ``queries.py`` binds them to the driver's tables.
"""
