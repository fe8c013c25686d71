"""Column functions: canonical text by rule, and hashes of it."""

from tallymark.functions.canonical import MARKER, canonical, nullable_canonical
from tallymark.functions.hashing import aggregate_hash, framed, joined, row_hash, signed_hash

__all__ = ["MARKER", "aggregate_hash", "canonical", "framed", "joined", "nullable_canonical", "row_hash", "signed_hash"]
