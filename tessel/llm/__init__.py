"""Operators of a training-data pipeline (language id, packing, secret scan,
quality, mixing, near-duplicates, chat formatting, exact top-k, line dedup).

Nothing outside this subpackage imports it.
"""
