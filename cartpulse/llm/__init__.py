"""Operators of a training-data pipeline: sharding, licences, language ID,
near-duplicates, decontamination, toxicity, substring dedup, mixing, nearest
neighbours, personal data, collocations, URL filter and ranked search.
Nothing outside this folder imports it."""
