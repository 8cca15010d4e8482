"""The mixture of languages against plain expectation-maximisation over every set of languages."""

from itertools import combinations

import numpy as np
import pytest

from pramana.llm import language_mixture

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {}
    for r in docs.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 600").select("lang", "text").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return language_mixture.fit(docs), texts


def plain_estimate(counts, here, chosen, steps=3000):
    """Proportions and log-likelihood of a set of languages by many plain steps from equal shares."""
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(steps):
        mixed = sum(s * here[:, j] for s, j in zip(share, chosen, strict=True))
        share = np.array([s * float((counts * here[:, j] / mixed).sum()) for s, j in zip(share, chosen, strict=True)]) / counts.sum()
    mixed = sum(s * here[:, j] for s, j in zip(share, chosen, strict=True))
    return share, float((counts * np.log(mixed)).sum())


def best_set(text, theta):
    """The set with the greatest penalised log-likelihood of all, and its proportions."""
    at, counts = language_mixture.trigram_counts(text)
    here, n = theta[at], theta.shape[1]
    penalty = 0.5 * np.log(max(counts.sum(), 2.0)) + 1.0
    found = []
    for size in range(1, n + 1):
        for chosen in combinations(range(n), size):
            share, value = plain_estimate(counts, here, chosen, 1 if size == 1 else 400)
            found.append((value - penalty * (size - 1), chosen, share))
    return max(found, key=lambda x: x[0])


def mixtures(texts):
    rng = np.random.default_rng(3)
    names = sorted(texts)
    for i in range(24):
        a, b = rng.choice(len(names), 2, replace=False)
        share = (1.0, 0.5, 0.7, 0.9)[i % 4]
        one, two = (texts[names[k]][int(rng.integers(len(texts[names[k]])))] for k in (a, b))
        n = 500 + 100 * (i % 5)
        yield one[: int(n * share)] + " " + two[: n - int(n * share)]


def test_sets_and_proportions_like_an_exhaustive_search(learned):
    (_, theta), texts = learned
    same = 0
    for text in mixtures(texts):
        mine = language_mixture.mixture(text, theta)
        value, chosen, share = best_set(text, theta)
        at, counts = language_mixture.trigram_counts(text)
        own = tuple(np.flatnonzero(mine).tolist())
        penalty = 0.5 * np.log(counts.sum()) + 1.0
        again, likelihood = plain_estimate(counts, theta[at], own, 400)
        assert np.abs(mine[list(own)] - again).max() < 0.02  # proportions, whatever the set
        assert value - (likelihood - penalty * (len(own) - 1)) < 2 * penalty  # never far from the best of all sets
        same += own == chosen
        if own == chosen:
            assert np.abs(mine[list(own)] - share).max() < 0.02
        assert abs(mine.sum() - 1) < 1e-9
    assert same >= 22


def test_one_language_and_two(learned):
    (names, theta), texts = learned
    for lang in names:
        share = language_mixture.mixture(texts[lang][0][:800], theta)
        assert names[int(share.argmax())] == lang and share.max() > 0.9
    a, b = names[0], names[1]
    share = language_mixture.mixture(texts[a][0][:600] + " " + texts[b][0][:600], theta)
    assert 0.35 < share[0] < 0.65 and 0.35 < share[1] < 0.65
    assert language_mixture.mixture("12 .. !", theta) is None and language_mixture.mixture(None, theta) is None
