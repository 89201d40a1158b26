"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames;
``queries`` holds the thin ``opN_<name>`` queries that apply them to whole tables.
"""
