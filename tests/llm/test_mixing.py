import random
import re

import pytest

from passages.llm.mixing import mixed, with_copies


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Targets as the shares are handed round, source by source."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = cap * sizes[s]
            left -= cap * sizes[s]
        open_ -= above
    return target


def rows_of(seed, n=2500):
    draw = random.Random(seed)
    sources = ["a", "B", "é", None, "tiny", "zero"]
    weights = [900, 300, 200, 100, 5, 0]
    rows = []
    for i in range(n):
        source = draw.choices(sources, weights)[0]
        rows.append((i, " ".join(["w"] * int(draw.expovariate(1 / 40))), source))
    return [*rows, (n, None, "zero"), (n + 1, "", "zero")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(docs_of, seed):
    rows = rows_of(seed)
    found = mixed(docs_of(rows)).collect()
    assert len(found) == len(rows)
    source = {r[0]: r[2] for r in rows}
    sizes, taken, targets, most = {}, {}, {}, {}
    for r in found:
        s = source[r["id"]]
        assert r["size"] == len(re.findall(r"\S+", rows[r["id"]][1] or ""))
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        most[s] = max(most.get(s, 0), r["size"])
        targets[s] = r["target"]
    wanted = plain_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(wanted[s])
        assert abs(taken[s] - targets[s]) <= 2 * most[s] + 1e-6, s
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))


def test_rates_are_one_exponential_per_source(docs_of):
    import math

    rows = rows_of(3)
    found = [r for r in mixed(docs_of(rows)).collect() if r["size"] and 0.01 < r["rate"] < 2.99]
    by_source = {}
    for r in found:
        by_source.setdefault(rows[r["id"]][2], []).append(math.log(r["rate"]) / r["size"])
    for slopes in by_source.values():
        assert max(slopes) - min(slopes) < 1e-3 * abs(max(slopes)) + 2e-4


def test_same_in_every_run_and_odd_rows(docs_of, odd_rows):
    one, two = (sorted(map(repr, mixed(docs_of(odd_rows, n)).collect())) for n in (1, 5))
    assert one == two and len(one) == len(odd_rows)


def test_rows_with_copies(docs_of, odd_rows):
    frame = docs_of(odd_rows)
    found = with_copies(frame)
    assert found.count() == len(odd_rows)
    assert set(found.columns) == set(frame.columns) | {"taken"}
    assert mixed(docs_of([])).collect() == [] and with_copies(docs_of([])).collect() == []
