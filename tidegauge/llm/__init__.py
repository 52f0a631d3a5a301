"""Training-data operators: mixing, dedup, quality, decontamination, tokenisation, chat, WARC and scoring.

Nothing outside this subpackage imports it.
"""
