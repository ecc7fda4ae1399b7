"""Training-data operators: quality, near-duplicates, fingerprints, toxicity, licences, LM scores, decontamination, packing, languages, page text.

Nothing outside this subpackage imports it.
"""
