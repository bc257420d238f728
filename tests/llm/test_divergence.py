import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.llm import divergence as module
from passages.llm.divergence import _Tree, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def expected(rows, min_docs=3, top=200):
    """From ``(text, lang, source)``."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = {s: c for (own, s), c in counts.items() if own == lang}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        of = {s: shares(c) for s, c in groups.items()}
        usual = shares(sum(groups.values(), Counter()))
        for source, p in of.items():
            pairs = {
                o: sum((p[t] - q[t]) ** 2 // q[t] for t in kept) for o, q in of.items() if o != source
            }
            terms = {
                t: (p[t] - usual[t]) ** 2 // usual[t]
                for t in kept
                if groups[source][t] and p[t] > usual[t]
            }
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(values, key=lambda i: (-values[i], i.encode()))[:most]
                out += [(lang, source, part, i, values[i], r) for r, i in enumerate(order, 1)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    frame = frame.withColumns({c: F.lit("x") for c in ("term", "n", "item", "value", "rank", "place", "p", "absent")})
    return sorted(tuple(r) for r in divergence(frame, **options).collect())


def test_against_plain_sums(spark, odd_rows, random_rows):
    draw = random.Random(7)
    rows = [(r[1], draw.choice(["en", "", None, "É"]), r[2]) for r in odd_rows + random_rows]
    rows += [("Été ÉTÉ été don't x_y 日本 a1b", "en", s) for s in "abc"] * 2
    rows += [(None, "empty", "a"), ("", "empty", "b"), ("1 2 3", "empty", None), ("alone", "single", "a")]
    assert found(spark, rows) == expected(rows)


def test_ties_and_the_number_of_terms(spark):
    rows = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)), "en", s) for s in "aab"]
    rows += [("tail " * 50, "en", "b")] * 3
    for top in (200, 7):
        assert found(spark, rows, top=top) == expected(rows, top=top)


def test_parts_of_texts_of_rows_and_of_tasks(spark, monkeypatch, random_rows):
    for name, size in (("PART_BYTES", 8), ("COUNTED", 5), ("TREE_CELLS", 8)):
        monkeypatch.setattr(module, name, size)
    rows = [(r[1], "en", f"s{r[0] % 11}") for r in random_rows]
    assert found(spark, rows) == expected(rows)


def test_trees_share_nodes():
    paths = [((1, 5), (2, 7)), ((1, 5), (2, 7), (3, 9)), ((1, 5), (2, 8)), ((1, 6),), ((2, 7), (3, 9))]
    times = [4, 3, 2, 1, 6]
    flat = [entry for path in paths for entry in path]
    tree = _Tree(
        np.array([len(p) for p in paths]),
        np.array([e[0] for e in flat]),
        np.array([e[1] for e in flat]),
        np.ones(len(flat), np.int64),
        np.array(times),
    )
    nodes = [(level, w) for level, starts, weight in tree.nodes() for w in weight.tolist()]
    assert nodes == [(0, 9), (0, 1), (0, 6), (1, 7), (1, 2), (1, 6), (2, 3)]


def test_large_counts_stay_exact(spark):
    # Shares of counts near 10^12, which products of 64 bits could not hold.
    frame = spark.createDataFrame([(10**12, 3 * 10**12, 5)], "n long, total long, kept long")
    assert frame.select(module.share("n")).first()[0] == 1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 5)


def test_empty_table(spark):
    assert found(spark, []) == []
