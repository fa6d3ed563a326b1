"""Rayleigh fit of amplitude windows: 10 adaptive bins, guess first, scan if it fits badly."""

from __future__ import annotations

import math

import numpy as np

# Histogram bins, fraction of amplitudes inside the axis, scan steps.
BINS = 10
FRACTION = 0.999
SCAN_STEPS = 100
GOOD_CHI_PER_DOF = 2.0
GUESS = math.sqrt(2.0 / math.pi)
LIMIT = math.sqrt(-(4.0 / math.pi) * math.log(1.0 - FRACTION))


def chi_square(counts: np.ndarray, width: np.ndarray, total: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Poisson-error chi-square of filled bins against a Rayleigh density of this scale."""
    centre = width[:, None] * (np.arange(BINS) + 0.5)
    s2 = np.where(scale > 0, scale, 1.0)[:, None] ** 2
    model = (total * width)[:, None] / s2 * centre * np.exp(-0.5 * centre**2 / s2)
    terms = np.where(counts > 0, (model - counts) ** 2 / np.where(counts > 0, counts, 1), 0.0)
    return terms.sum(axis=1)


def fit_windows(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, chi-square and degrees of freedom per row; NaN entries are unused slots."""
    used = ~np.isnan(windows)
    total = used.sum(axis=1).astype(float)
    mean = np.where(used, windows, 0.0).sum(axis=1) / np.maximum(total, 1)
    width = np.maximum(mean * LIMIT / BINS, 1e-300)
    index = np.where(used, np.floor(np.where(used, windows, 0.0) / width[:, None]), BINS).astype(int)
    counts = np.stack([(index == b).sum(axis=1) for b in range(BINS)], axis=1)
    filled = (counts > 0).sum(axis=1)
    scale = GUESS * mean
    chi, ndf = chi_square(counts, width, total, scale), filled.copy()
    bad = np.flatnonzero(chi / np.maximum(ndf, 1) >= GOOD_CHI_PER_DOF)
    if len(bad):
        trials = np.stack(
            [chi_square(counts[bad], width[bad], total[bad], 2 * scale[bad] * s / SCAN_STEPS) for s in range(1, SCAN_STEPS)], axis=1
        )
        best = np.argmin(trials, axis=1)
        chi[bad] = trials[np.arange(len(bad)), best]
        scale[bad] = 2 * scale[bad] * (best + 1) / SCAN_STEPS
        ndf[bad] = filled[bad] - 1
    return scale, chi, ndf
