"""Weak supervision: expectation-maximisation over overlapping voters that may abstain.

A voter says 1 (good), 0 (bad) or abstains (-1). An abstention is no evidence. Given the unknown class,
cast votes are independent; rate[c, v, s] is how often voter v casts s on documents of class c, and the
ratio of its rates is what a vote is worth. A voter that never meets another keeps the trust it began with
(nothing in the data speaks for or against it); agreement and conflict move the others. Only the counts of
distinct vote patterns are needed (3^voters at most, far fewer in practice), so the fit costs one
aggregation over all documents with map-side combine, and the driver sees patterns, never documents.
"""

from __future__ import annotations

import numpy as np


class Votes:
    """A fitted model: the probability that a pattern of votes means class 1."""

    def __init__(self, prior: float, rate: np.ndarray):
        self.prior, self.rate = prior, rate

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        p = np.asarray(patterns, np.int64)
        v = np.arange(p.shape[1])
        worth = np.log(self.rate[1]) - np.log(self.rate[0])
        odds = np.log(self.prior / (1 - self.prior)) + np.where(p < 0, 0.0, worth[v, np.maximum(p, 0)]).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def accuracy(self) -> np.ndarray:
        """[voter, vote]: share of right votes among the votes cast; 0.5 where none is."""
        share = np.array([1 - self.prior, self.prior])[:, None, None] * self.rate
        right = np.stack([share[0, :, 0], share[1, :, 1]], axis=1)
        return right / share.sum(0)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, prior: float = 0.85, trust: float = 0.9, strength: float = 5.0) -> Votes:
    """EM from voters whose votes are right ``trust`` of the time, held there by ``strength`` pseudo-votes each."""
    p, c = np.asarray(patterns, np.int64), np.asarray(counts, float)
    n = p.shape[1]
    cast = np.stack([(p == s) for s in (0, 1)], axis=2).astype(float)
    total = max(float(c.sum()), 1.0)
    often = ((cast * c[:, None, None]).sum(0) + 1e-3) / total
    classes = np.array([1 - prior, prior])
    began = np.zeros((2, n, 2))
    for k in (0, 1):
        for s in (0, 1):
            began[k, :, s] = often[:, s] * (trust if s == k else 1 - trust) / classes[k]
    m = Votes(prior, np.clip(began, 1e-6, 1.0))
    if not len(p):
        return m
    for _ in range(rounds):
        q = m.posterior(p)
        rate = np.zeros_like(began)
        for k, g in ((1, q * c), (0, (1 - q) * c)):
            pseudo = strength * np.array([[trust if s == k else 1 - trust for s in (0, 1)]] * n)
            rate[k] = (np.einsum("i,ivs->vs", g, cast) + pseudo) / (g.sum() + strength / classes[k])
        # a vote may come to weigh nothing, never the other way round
        for s in (0, 1):
            rate[1 - s, :, s] = np.minimum(rate[1 - s, :, s], rate[s, :, s])
        at = float(np.clip((q @ c + 0.85 * 10) / (total + 10), 0.02, 0.98))
        rate = np.clip(rate, 1e-6, 1.0)
        moved = abs(at - m.prior) + np.abs(rate - m.rate).max()
        m = Votes(at, rate)
        if moved < 1e-7:
            break
    return m
