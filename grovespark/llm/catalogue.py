"""All queries of the training-data operators by name, and the DuckDB SQL of those that SQL can express."""

from . import codes, fingerprints, harmonic, langid, matroska, mixing, packing, repair, secrets, simhash, substrings, toxicity, urls

QUERIES: dict = {}
SQL: dict[str, str] = {}
for module in (fingerprints, secrets, toxicity, langid, substrings, simhash, mixing, urls, matroska, packing, harmonic, codes, repair):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
