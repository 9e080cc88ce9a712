"""Parameters of the jobs. The defaults are the values the results are defined with."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TermWeights:
    latin: float
    han_run: float
    han_gram: float
    concept: float


DOCUMENT_WEIGHTS = TermWeights(latin=1.0, han_run=1.0, han_gram=0.9, concept=2.8)
QUERY_WEIGHTS = TermWeights(latin=1.25, han_run=1.4, han_gram=1.25, concept=4.0)


@dataclass(frozen=True)
class ChunkRules:
    prose_target: int = 320
    prose_minimum: int = 80
    prose_overlap: int = 40
    code_target: int = 420
    code_overlap: int = 64
    minimum_chars: int = 12


@dataclass(frozen=True)
class SearchRules:
    limit: int = 8
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    branch_minimum: int = 50
    pool_minimum: int = 20
    dense_threshold: float = 0.15
    per_document: int = 3
    # Scores are compared after rounding to this many decimals, so that the order in which a
    # distributed sum adds its terms can never decide a tie.
    score_digits: int = 9
    # A term's postings are spread over this many join keys, so that a term found in a third of
    # the corpus is not one reducer's work.
    term_salts: int = 16
    # Folders that postings by term are stored in; a corpus of more terms takes more of them. A search deals
    # the postings of its terms to this many parts at least, and to more where a part would exceed part_postings.
    term_buckets: int = 16
    bucket_parts: int = 4
    part_postings: int = 4_000_000
    # Postings that are cut into blocks at once, postings of a block, and levels of impact per unit.
    segment_postings: int = 1_000_000
    block_postings: int = 256
    impact_levels: int = 4
    # Terms of queries that are shipped to the tasks at once; queries beyond are searched for in another turn.
    shipped_terms: int = 1_000_000
    # Query vectors are shipped to the tasks only up to this many bytes; beyond it the vectors
    # are joined block by block.
    max_shipped_vector_bytes: int = 32 * 1024 * 1024
    # Bytes of one product of query vectors and a block of chunk vectors.
    vector_slab_bytes: int = 32 * 1024 * 1024
    # Rows of one vector block in the joined form.
    vector_block_rows: int = 20_000

    @property
    def branch_limit(self) -> int:
        return max(self.limit * 4, self.branch_minimum)

    @property
    def pool_limit(self) -> int:
        return max(self.limit * 4, self.pool_minimum)


@dataclass(frozen=True)
class ContextRules:
    per_document: int = 2
    max_chars: int = 2800
    relevance_weight: float = 0.78
    redundancy_weight: float = 0.22
    same_document_penalty: float = 0.08
    same_document_floor: float = 0.35


@dataclass(frozen=True)
class EvidenceRules:
    max_searches: int = 4
    max_citations: int = 12
    first_round: int = 6
    follow_up: int = 3
    per_document: int = 3
    overlap: float = 0.5
    # Queries that are searched for at once.
    turn_queries: int = 250


@dataclass(frozen=True)
class ScanRules:
    max_files: int = 50_000
    max_total_bytes: int = 8 * 1024 * 1024 * 1024
    max_depth: int = 32
    skip_sensitive: bool = True
    reported_extensions: int = 6


@dataclass(frozen=True)
class HistoryRules:
    max_turns: int = 12
    max_tokens: int = 3000
    message_overhead: int = 4
    minimum_tail: int = 64
