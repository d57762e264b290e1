"""HyperMinHash sketches: per bucket the leading zeros and leading mantissa bits of the smallest hash."""

from __future__ import annotations

import numpy as np

#: Buckets of a sketch; a register is 16 bits: leading zeros times 2**MANTISSA plus mantissa.
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
EMPTY = 0xFFFF

_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)


def sketch(hashes: list[np.ndarray]) -> np.ndarray:
    """Registers (texts x BUCKETS, uint16) of sorted distinct hash sets.

    The top bits of a hash choose its bucket, so in a sorted set the first hash
    at or after a bucket's lower bound is the bucket's minimum.
    """
    least = np.zeros((len(hashes), BUCKETS), np.uint64)
    has = np.zeros((len(hashes), BUCKETS), bool)
    for row, h in enumerate(hashes):
        at = np.searchsorted(h, _BOUNDS)
        own = at < np.append(at[1:], len(h))
        has[row] = own
        least[row, own] = h[at[own]]
    rest = least << np.uint64(BUCKET_BITS)
    # the top 53 bits convert to float exactly, so the exponent is their bit length
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) + mantissa
    return np.where(has, out, EMPTY).astype(np.uint16)


def accidental(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Expected registers that agree by chance in sketches of disjoint sets of these sizes.

    The minimum of n / BUCKETS uniform values is taken as exponential with that
    rate; a cell (zeros, mantissa) has width 2**-(zeros + 1 + MANTISSA), and the
    sum of the products of both densities over the cells of one leading-zero
    count telescopes into a difference of exponentials.
    """
    a, b = np.maximum(n_a, 1) / BUCKETS, np.maximum(n_b, 1) / BUCKETS
    rate, place = np.unique(a + b, return_inverse=True)  # the sum over cells depends on the rates' sum alone
    total = np.zeros(len(rate))
    for zeros in range(54):
        low, high = 2.0 ** -(zeros + 1), 2.0 ** -zeros
        total += 2.0 ** -(zeros + 1 + MANTISSA) * (np.exp(-rate * low) - np.exp(-rate * high))
    return BUCKETS * a * b / (a + b) * total[place]


def agreement(regs_a: np.ndarray, regs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Registers that agree in each pair of sketches, and the registers that either of them uses."""
    used = np.count_nonzero((regs_a != EMPTY) | (regs_b != EMPTY), axis=1)
    return np.count_nonzero((regs_a == regs_b) & (regs_a != EMPTY), axis=1), used


def corrected(same: np.ndarray, used: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate without the agreements expected by chance."""
    chance = np.minimum(accidental(n_a, n_b), 0.5 * np.maximum(used, 1))
    return np.clip((same - chance) / np.maximum(used - chance, 1e-9), 0, 1)


def similarity(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate of each pair of sketches, and the registers it rests on."""
    same, used = agreement(regs_a, regs_b)
    return corrected(same, used, n_a, n_b), used


def may_reach(same: np.ndarray, used: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float,
              sigmas: float = 4.5) -> np.ndarray:
    """Whether the true similarity may be ``threshold``: the share of agreeing registers is at most so many deviations below.

    The used registers are drawn without replacement from the union, which at the
    threshold has (n_a + n_b) / (1 + threshold) members; small sets are seen
    nearly whole, so their share hardly deviates.  Chance agreements only raise
    the share; the corrected estimate would put small sets that lie on the
    threshold just below it.
    """
    union = np.maximum((n_a + n_b) / (1 + threshold), 2)
    unseen = np.clip((union - used) / (union - 1), 0, 1)
    deviation = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1) * unseen)
    return same / np.maximum(used, 1) >= threshold - sigmas * deviation - 1e-9
