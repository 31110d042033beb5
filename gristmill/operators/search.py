"""Search for parameters within a time: a sampler that learns from its draws, and fits that run side by side.

The first draws are even over the space. Later ones come from a ratio of densities: draws so far are split into the better share and the rest,
each parameter's values are smoothed into a density of either, candidates are drawn from the better one's, and the candidate is taken
that is likeliest under it against the other. Rounds of several draws are fitted at once, each in a scheduler pool of its own, so that a cluster with
fair scheduling shares its executors among them. What a round proposes depends on finished rounds only, so a search gives the same draws
however its fits end; whether another round begins depends on the clock alone.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext

#: Draws before the sampler learns, the share of draws that counts as better, and candidates of a draw.
EVEN_DRAWS, BETTER, CANDIDATES = 6, 0.25, 24
#: Parameters that a search may draw, with their bounds; whole numbers where both bounds are.
SPACE = {"maxDepth": (2, 8), "maxIter": (10, 60), "stepSize": (0.03, 0.3), "subsamplingRate": (0.5, 1.0), "minInstancesPerNode": (1, 50), "minInfoGain": (0.0, 0.01), "maxBins": (16, 64)}

Space = Mapping[str, tuple[float, float]]


@dataclass(frozen=True)
class Draw:
    """One fit: its number, parameters, score (None if it failed), what it failed with, and its time."""

    number: int
    params: dict
    score: float | None
    error: str | None
    seconds: float


def _value(bounds: tuple[float, float], u: float):
    """A parameter's value at a share of its range."""
    low, high = bounds
    if isinstance(low, int) and isinstance(high, int):
        return min(high, low + int(u * (high - low + 1)))
    return low + u * (high - low)


def _share(bounds: tuple[float, float], value: float) -> float:
    low, high = bounds
    if isinstance(low, int) and isinstance(high, int):
        return (value - low + 0.5) / (high - low + 1)
    return (value - low) / (high - low) if high > low else 0.5


def _log_density(at: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A mixture of one bell around each value seen and an even part, over shares of the range."""
    width = max(0.05, 1.06 * (seen.std() if len(seen) > 1 else 0.3) * len(seen) ** -0.2)
    bells = np.exp(-0.5 * ((at[:, None] - seen) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return np.log((1.0 + bells.sum(1)) / (1 + len(seen)))


def propose(space: Space, seen: Sequence[tuple[dict, float]], seed: int, number: int) -> dict:
    """The parameters of a draw, from the draws (parameters, score to raise) seen so far; failed ones have no score and are left out."""
    rng = np.random.default_rng([seed, number])
    if len(seen) < EVEN_DRAWS:
        return {k: _value(b, rng.random()) for k, b in space.items()}
    order = sorted(range(len(seen)), key=lambda i: -seen[i][1])
    n = max(2, math.ceil(BETTER * len(order)))
    out = {}
    for k, b in space.items():
        shares = np.array([_share(b, p[k]) for p, _ in seen])
        good, rest = shares[order[:n]], shares[order[n:]]
        width = max(0.05, 1.06 * good.std() * len(good) ** -0.2)
        near = np.clip(rng.choice(good, CANDIDATES) + width * rng.normal(size=CANDIDATES), 0, 1 - 1e-9)
        found = np.r_[near, rng.random(CANDIDATES // 4)]
        out[k] = _value(b, float(found[np.argmax(_log_density(found, good) - _log_density(found, rest))]))
    return out


def search(
    fit_score: Callable[[dict], float],
    seconds: float,
    draws: int = 20,
    together: int = 4,
    seed: int = 42,
    space: Space = SPACE,
    clock: Callable[[], float] = time.monotonic,
) -> list[Draw]:
    """The draws, best first: ``fit_score(parameters)`` gives a score to raise. Fits that fail are kept, last, and do not end the search.

    A round is not begun when the mean time of the rounds so far would not fit in what is left; the first one always is.
    """
    began, out, rounds = clock(), [], []

    def one(number: int, params: dict, at: int) -> Draw:
        context, start = SparkContext._active_spark_context, clock()
        if context is not None:
            context.setLocalProperty("spark.scheduler.pool", f"search-{at}")
        try:
            return Draw(number, params, float(fit_score(params)), None, clock() - start)
        except Exception as e:  # told in the result
            return Draw(number, params, None, f"{type(e).__name__}: {e}"[:200], clock() - start)
        finally:
            if context is not None:
                context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(together) as pool:
        while len(out) < draws:
            now = clock()
            if rounds and sum(rounds) / len(rounds) > seconds - (now - began):
                break
            seen = [(d.params, d.score) for d in out if d.score is not None and math.isfinite(d.score)]
            numbers = range(len(out), min(draws, len(out) + together))
            waiting = [pool.submit(one, n, propose(space, seen, seed, n), i) for i, n in enumerate(numbers)]
            out += [w.result() for w in waiting]
            rounds.append(clock() - now)
    return sorted(out, key=lambda d: (d.score is None or not math.isfinite(d.score), -(d.score or 0.0) if d.score is not None and math.isfinite(d.score) else 0.0, d.number))
