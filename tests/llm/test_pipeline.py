"""The pipeline's stages, each against its operator's decisions, and its whole run."""

import pyarrow.parquet as pq
import pytest

from .test_near_copies import least_of_components
from .test_queries import EDGES, docs_table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def ids(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir):
    from quadrille.llm import queries as llm

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    q = llm.queries()
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(q["op4_string_kernel"](spark, sf_dir).where("lang_pred <> 'und' AND score >= 0.3"))
    good = corpus_pipeline.good_quality(spark, docs, sf_dir)
    assert good.columns == docs.columns
    assert ids(good) == ids(q["op1_pu_quality"](spark, sf_dir).where("predicted = 1"))
    one = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert one.columns == docs.columns
    kept_rows = least_of_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert ids(one) == sorted(str(d) for d, _ in kept_rows)
    cut = corpus_pipeline.repeated_passages(spark, docs, sf_dir)
    assert cut.columns == docs.columns and ids(cut) == ids(docs)
    gone = {r.doc_id: r.n_removed for r in q["op3_deep_shallow"](spark, sf_dir).collect()}
    old = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
    for r in cut.collect():
        less = old[r.doc_id] - len((r.text or "").encode())
        assert gone[r.doc_id] <= less <= gone[r.doc_id] + 6 * (gone[r.doc_id] > 0) * (1 + gone[r.doc_id] // 50)


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 0


@pytest.fixture(scope="module", params=["edges", "nothing"])
def folder(request, tmp_path_factory):
    """The edge rows of test_queries with columns named like those the stages make, or no rows at all."""
    at = tmp_path_factory.mktemp(request.param)
    table = docs_table(EDGES if request.param == "edges" else [])
    for name in ("own_text", "twin", "own_id", "ats", "own", "text_key", "root", "rank", "set", "keys", "h", "lang_pred", "other"):
        table = table.append_column(name, table.column("n_chars"))
    pq.write_table(table, f"{at}/documents.parquet")
    labels = {n: table.column("doc_id" if n == "doc_id" else "n_chars") for n in ("doc_id", "quality", "toxic")}
    pq.write_table(type(table).from_pydict(labels), f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES])
def test_edges(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    rows = found.collect()
    if stage != "packing":
        assert found.columns == docs.columns and len(rows) <= docs.count()
    else:
        assert len(rows) >= docs.count()
    if stage == "repeated_passages":
        assert sorted((str(r.doc_id), r.text is None) for r in rows) == sorted((str(r.doc_id), r.text is None) for r in docs.collect())
    if stage == "language":
        assert all(any(c.isalpha() for c in r.text or "") for r in rows)
