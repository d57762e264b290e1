"""Parameters binding the operators to the driver's synthetic tables.

The reference's defaults (0.70 conflicts, 0.85 pairs, 0.95/0.90 bands …) give
empty results on these near-noise 64-d vectors, so the registered queries use
the values below.  They were fixed before any query was compared with its
oracle, and are the only place thresholds for the driver tables live.
"""

from __future__ import annotations

from corpuscope.functions.bands import Bands

# embedded corpus (embeddings ⋈ documents)
CONFLICT_T = 0.30          # base threshold of phrase conflicts
CONFLICT_FILTER_T = 0.35   # PF-2 re-filter
FILTER_INTENT = "label_3"  # PF-2 label filter
TOPK_K = 100               # SIM-6 neighbours
CAP_N = 500                # SIM-9 cap of the conflicts_capped query
FIRST_N = 1000             # conflicts looked at by the queries named after that limit (AGG-9, AGG-11)
SHOW_N = 50                # LIM-4 rows shown
PAIR_T = 0.05              # SIM-4 confusing-pair threshold
BLOCK_ROWS = 128           # blocked SIM-5 block size at test scale
LSH_TABLES = 8             # SIM-7: SimHash tables; bits grow with the corpus
LSH_SHARE = 0.075          # share of the buckets a phrase looks into, and at most so many
LSH_PROBES = 256

# labels of the wide results: columns are named up front, so no job discovers them
EMB_LABELS = [f"label_{i}" for i in range(10)]
DOC_LABELS = [f"src{i}" for i in range(20)]

# hashing-encoded documents / benchmark search
ENCODE_DIM = 256
SEARCH_T = 0.25
SEARCH_TOPK = 20           # batch top-k
SINGLE_TOPK = 50           # single-search top-k

TABLE_BANDS = Bands(
    risk_high=0.20,
    move=0.45, rephrase=0.40,
    critical_pair=0.15, must_fix=0.20, should_fix_lo=0.05,
    phrase_critical=0.45,
    duplicate=0.66, add=0.52, review=0.34, confidence=0.70,
    cap_very_high=0.66,
    mt_very_high=0.66, mt_high=0.52, mt_moderate=0.42, mt_low=0.34,
    stat_very=0.66, stat_high=0.52,
)
