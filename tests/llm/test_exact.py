import hashlib
from collections import defaultdict

import pytest

from passages.llm.exact import LOWER, UPPER, exact_duplicates, without_duplicates

TABLE = str.maketrans(UPPER, LOWER)


def expected(rows, best):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(TABLE)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not kept, digest))
            kept = kept or i == keep
    return sorted(out, key=repr)


@pytest.mark.parametrize(("keep", "best"), [("smallest", min), ("largest", max)])
def test_against_groups(docs_of, odd_rows, random_rows, keep, best):
    rows = odd_rows + random_rows + [(i, "Hot Ä") for i in range(300)] + [(None, "only"), (None, "ONLY")]
    found = [tuple(r) for r in exact_duplicates(docs_of(rows), keep=keep).collect()]
    assert sorted(found, key=repr) == expected(rows, best)


def test_rows_that_stay(docs_of, odd_rows):
    frame = docs_of(odd_rows)
    kept = without_duplicates(frame, keep="largest")
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    wanted = [row[0] for row in expected(odd_rows, max) if row[3]]
    assert sorted(ids, key=repr) == sorted(wanted, key=repr)


def test_plan_sorts_texts_once(docs_of):
    plan = exact_duplicates(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "rangepartitioning" not in plan  # written before


def test_empty_table_and_bad_rule(docs_of):
    assert exact_duplicates(docs_of([])).collect() == []
    assert without_duplicates(docs_of([])).collect() == []
    with pytest.raises(ValueError, match="keep"):
        exact_duplicates(docs_of([]), keep="first")
