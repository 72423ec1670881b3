import bisect
import itertools
import random
from collections import Counter
from fractions import Fraction

import pytest

from quiverine.errors import InvalidArgs
from quiverine.operators.sampling import WeightedIndex, cumulative, sample_at


def exact_pick(weights, u):
    """The first index whose exact running total is over ``u``."""
    totals = list(itertools.accumulate(map(Fraction, weights)))
    at = bisect.bisect_right(totals, Fraction(u))
    while not weights[at]:
        at += 1
    return at


def random_weights(rng):
    weights = [rng.choice((0, 0, rng.randrange(1, 40))) / 4 for _ in range(rng.randrange(1, 9))]
    return weights if any(weights) else [*weights, 0.75]


def test_draws_follow_the_running_total():
    rng = random.Random(12)
    for _ in range(300):
        weights = random_weights(rng)
        index = WeightedIndex(weights)
        assert index.total == sum(weights)
        for _ in range(20):
            u = rng.randrange(int(16 * index.total)) / 16
            assert index.sample(lambda total, u=u: u) == exact_pick(weights, u)


def test_shares_of_an_even_grid():
    """Draws at the middle of n even cells of the total give each index its share of them."""
    weights = [0.5, 0.0, 4.25, 1.25]
    index, n = WeightedIndex(weights), 24
    drawn = Counter(index.at((k + 0.5) * index.total / n) for k in range(n))
    assert drawn == {0: 2, 2: 17, 3: 5}


def test_the_end_of_the_total_is_the_last_index_with_a_weight():
    assert WeightedIndex([0.1, 0.2, 0.0]).at(1e9) == 1


@pytest.mark.parametrize("weights", [(), (4, -0.5), (0.0,) * 4, (2, float("inf")), (float("nan"),)])
def test_weights_that_are_refused(weights):
    with pytest.raises(InvalidArgs):
        WeightedIndex(weights)


def test_updates_are_made_as_a_whole_or_not_at_all():
    rng = random.Random(13)
    for _ in range(300):
        weights = random_weights(rng)
        index = WeightedIndex(weights)
        changes = [(rng.randrange(len(weights) + (rng.random() < 0.1)), rng.choice((0, 1.5, 3, -1 if rng.random() < 0.1 else 2))) for _ in range(rng.randrange(4))]
        wanted = list(weights)
        good = all(at < len(weights) for at, _ in changes)
        if good:
            for at, weight in changes:
                wanted[at] = weight
            good = min(wanted) >= 0 and sum(wanted) > 0
        if good:
            index.update(changes)
        else:
            with pytest.raises(InvalidArgs):
                index.update(changes)
            wanted = weights
        assert [index.get(k) for k in range(len(wanted))] == wanted
        assert index.get(len(wanted)) is None
        u = rng.randrange(int(8 * sum(wanted)) or 1) / 8
        assert index.at(u) == exact_pick(wanted, u)


def test_running_totals_of_a_table(spark):
    rng = random.Random(14)
    weights = [rng.choice((0, 1, 2, 7)) for _ in range(300)]
    at = sorted([*rng.sample(range(1000), 298), -(10**12), 10**12])
    df = spark.createDataFrame(list(zip(at, map(float, weights))), "at long, w double").repartition(5)
    got = [r["cumulative"] for r in cumulative(df, "at", "w").orderBy("at").collect()]
    assert got == list(itertools.accumulate(weights))
    for u in (0, 1.5, got[150], got[-1] - 0.5):
        assert sample_at(df, "at", "w", u).first()["at"] == at[exact_pick(weights, u)]
