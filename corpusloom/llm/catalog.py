"""Registry of the corpus operators' queries and their SQL counterparts."""

from __future__ import annotations

from . import alignment, attention, langid, line_dedup, media, minhash, multi_index, packing, pieces, quality, secrets, sharding

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (pieces, langid, packing, quality, media, line_dedup, minhash, multi_index, secrets, sharding, attention, alignment):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
