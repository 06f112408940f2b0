"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame of documents and the names of its id and text columns, reads only
those two columns (so further columns of any name are harmless), and treats a
null text as the empty text unless its docstring says otherwise.
"""
