"""Training-data operators: quality, dedup, tokenising, licence and secret scans, mixing, URL filters, WARC, audio.

Nothing else in the library imports this subpackage.
"""
