"""Operators for preparing text corpora for language-model training.

Every operator takes and returns DataFrames and keeps only its id column and
its own results, so extra or clashing columns of the input never matter.
``queries`` lists the registered queries of this subpackage.
"""
