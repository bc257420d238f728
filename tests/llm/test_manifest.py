import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from passages.llm import manifest as module
from passages.llm.manifest import append_log, height, leaf_digest, manifest, neighbours, position


def digest(text):
    return sha256(text.encode()).hexdigest()


def tree(leaves):
    """All levels, plainly."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def steps(levels, place):
    for level in levels[:-1]:
        run = level[place // 8 * 8 : place // 8 * 8 + 8]
        yield "".join(run[: place % 8]), "".join(run[place % 8 + 1 :])
        place //= 8


def expected(rows):
    """From ``(id, tree, leaf, claim)``."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        built[name] = own, tree([r[2] for r in own])
    top = tree([built[name][1][-1][0] for name in names])
    root = top[-1][0]
    out = []
    for number, name in enumerate(names):
        own, levels = built[name]
        for place, (row_id, _, leaf, claim) in enumerate(own):
            path = [*steps(levels, place), *steps(top, number)]
            node = claim or leaf
            for left, right in path:
                node = digest(left + node + right)
            proof = digest("".join(left + right for left, right in path))
            out.append((row_id, leaf, levels[-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def proofs_of(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, claim string")
    frame = frame.repartition(parts).withColumns({c: F.lit("x") for c in ("id", "tree", "n", "rank", "part", "at", "task")})
    return manifest(frame, claim_col="claim").proofs()


@pytest.mark.parametrize("count", [1, 2, 7, 8, 9, 63, 64, 65, 100, 513])
def test_positions_address_the_log(count):
    leaves = [digest(str(i)) for i in range(count)]
    for levels in (height(count), height(count) + 2):
        log = append_log([leaf.encode() for leaf in leaves], levels).decode()
        plain = tree(leaves)
        while len(plain) <= levels:  # a block of a larger tree goes on above its last node
            plain.append([digest(plain[-1][0])])
        assert len(log) == 64 * sum(map(len, plain[: levels + 1]))
        for level, nodes in enumerate(plain[: levels + 1]):
            for index, node in enumerate(nodes):
                place = position(level, index, count)
                assert log[64 * place : 64 * place + 64] == node
        if levels == height(count):
            found = neighbours(log.encode(), count, levels)
            for place in range(count):
                assert [(a.decode(), b.decode()) for a, b in found[place]] == list(steps(plain, place))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_proofs_against_plain_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(module, "LEVELS", levels)
    monkeypatch.setattr(module, "BLOCK", 8**levels)
    draw = random.Random(levels)
    rows = []
    for name, count in (("en", 700), ("", 1), (None, 9), ("é", 8), ("z", 64), ("Z", 65), ("one", 1)):
        for i in range(count):
            row_id = draw.choice([i, i, i // 2, None])
            leaf = digest(f"{name} {row_id} {draw.randrange(3)}")
            rows.append((row_id, name, leaf, digest("other") if draw.random() < 0.3 else None))
    rows += [rows[0]] * 40  # repeated in full
    found = sorted([tuple(r) for r in proofs_of(spark, rows).collect()], key=repr)
    # Among rows of one id and leaf it is open which one's claim meets which place.
    assert len(found) == len(rows)
    unclaimed = [(*r[:3], None) for r in rows]
    plain = sorted([tuple(r) for r in proofs_of(spark, unclaimed).collect()], key=repr)
    assert plain == expected(unclaimed)
    assert all(r[6] for r in plain)
    unique = {(r[0], r[1], r[2]): r for r in rows}.values()
    found = sorted([tuple(r) for r in proofs_of(spark, list(unique)).collect()], key=repr)
    assert found == expected(unique)
    assert {r[6] for r in found} == {True, False}


def test_layers_of_full_size(spark):
    rows = [(i, "en" if i % 3 else "de", digest(str(i)), None) for i in range(13_000)]
    found = sorted([tuple(r) for r in proofs_of(spark, rows).collect()], key=repr)
    assert found == expected(rows)


def test_a_log_lists_nodes_in_completion_order(spark):
    rows = [(i, "en", digest(str(i)), None) for i in range(5000)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, claim string")
    layers = manifest(frame).trees.layers
    assert [layer.count() for layer in layers] == [2, 1]
    blocks = {r["block"]: r for r in layers[0].collect()}
    first = bytes(blocks[0]["nodes"]).decode()
    assert len(first) == 64 * (4096 + 512 + 64 + 8 + 1)
    assert first[8 * 64 : 9 * 64] == digest(first[: 8 * 64])


def test_leaf_digest(spark):
    rows = [(1, "é", None, 5), (None, "", "a:b", None)]
    frame = spark.createDataFrame(rows, "a long, b string, c string, d long")
    found = [r[0] for r in frame.select(leaf_digest(*[F.col(c) for c in "abcd"])).collect()]
    assert found == [digest("1:12:é-1:5"), digest("-0:3:a:b-")]


def test_empty_table(spark):
    assert proofs_of(spark, []).collect() == []
