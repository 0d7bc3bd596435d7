"""Training-data operators: near-duplicates, personal data, token files, mixing, decontamination,
WARC archives, quality models and rules, repeated passages and language identification.

Nothing outside this folder imports it.
"""
