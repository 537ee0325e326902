"""The registered queries of this package and their SQL."""

from querykiln.llm import bpe, langid, licenses, linededup, linerules, minhash, neighbors, packing, quality, toxicity

_MODULES = (langid, quality, linededup, neighbors, minhash, bpe, toxicity, linerules, packing, licenses)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: f for m in _MODULES for k, f in m.ORACLE.items()}
