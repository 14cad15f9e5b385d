"""Operators of a training-data pipeline: formatting, extraction, encoding, filtering, linking and packing of texts.

Nothing else in the library imports this subpackage.  Every operator reads only the columns it names
and returns only its own, so further columns of the input, whatever they are called, do not matter.
"""
