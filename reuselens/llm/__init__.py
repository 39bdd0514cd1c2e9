"""Operators of a training-data pipeline: WARC files, language ID, benchmark
decontamination, packing, SimHash near-duplicates, URL filters, nearest
neighbours, HTML extraction, substring de-duplication and licence scans.

Each module holds one operator with its own interface; ``queries`` wraps
them as registered queries. Nothing else in the library imports this
package.
"""
