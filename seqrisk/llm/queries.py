"""All queries of this package, registered by importing its modules."""

from seqrisk.llm import bpe, dialogs, language, licenses, mixing, packing, paragraphs, quality, sharding, simhash, vector_dedup, vector_search, whitening  # noqa: F401
from seqrisk.llm.registry import ORACLE, QUERIES  # noqa: F401
