import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from passages.llm.mixing import with_copies  # noqa: E402

from .test_jaccard import expected as near  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, docs_of, odd_rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs_of(odd_rows).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0) for i in range(14)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11.")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_pass_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), folder)
        assert empty.collect() == [] and empty.columns == kept.columns, name
        assert stage(spark, docs.union(docs), folder).count() >= kept.count() > 0, name


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def ids(frame):
        return sorted(r["doc_id"] for r in frame.collect())

    once = {}
    for i in sorted(rows):
        once["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[i])] = i
    assert ids(stages["exact dedup"](spark, docs, str(FOLDER))) == sorted(once.values())
    wanted, _ = near(list(rows.items()))
    assert ids(stages["n-gram Jaccard join"](spark, docs, str(FOLDER))) == [i for i, _, c in wanted if i == c]
    clean = ids(stages["benchmark decontamination"](spark, docs, str(FOLDER)))
    assert not [i for i in clean if any(t in rows[i] for t in items)]
    assert len(clean) >= 0.9 * len(rows)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").collect()}
    kept = ids(stages["toxicity"](spark, docs, str(FOLDER)))
    assert len(set(rows) - toxic - set(kept)) <= 0.1 * len(rows)
    mix = stages["mixing"](spark, docs, str(FOLDER))
    found = {}
    for r in mix.collect():
        found.setdefault((r["doc_id"], r["copies"]), []).append(r["copy"])
    assert all(sorted(numbers) == list(range(1, copies + 1)) for (_, copies), numbers in found.items())
    taken = with_copies(docs).where("copies > 0").select("doc_id", "copies").collect()
    assert sorted(found) == sorted((r["doc_id"], r["copies"]) for r in taken) and len(found) < len(rows)
    result = corpus_pipeline.run(spark, str(FOLDER))
    assert result.select("doc_id").distinct().count() < len(rows)
    assert 0 < result.count() <= 3 * len(rows)
