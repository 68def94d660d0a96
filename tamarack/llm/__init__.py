"""Operators for preparing training data at scale; nothing else in the library imports this subpackage."""

from . import language, lm, mixing, mtree, packing, quality, sharding, simhash, suffix, urls

MODULES = [urls, sharding, quality, mtree, simhash, packing, lm, mixing, language, suffix]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
