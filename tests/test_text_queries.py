"""The text queries read whole papers: titles and abstracts, by sentence."""

from __future__ import annotations

import pytest

from litweave.operators import formulas
from litweave.plans import text_queries as q

PAPERS = [
    (1, "Remanent polarization of films", "We grew bismuth films. Was hysteresis seen? Hysteresis was seen. © 2004 A Publisher."),
    (2, "Polarization again", None),
    (3, None, "Only bismuth hysteresis"),
    (4, None, None),
]


@pytest.fixture(scope="module")
def papers(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("papers"))
    spark.createDataFrame(PAPERS, "paper_id long, title string, abstract string").write.parquet(f"{d}/paper.parquet")
    return d


def test_document_sentences(spark, papers):
    got = {(r.doc, r.sent): r.words for r in q.document_sentences(spark, papers).collect()}
    assert got[1, 0] == ["remanent", "polarization", "of", "films"] and got[1, 2] == ["was", "hysteresis", "seen"]
    assert got[2, 0] == ["polarization", "again"] and {d for d, _ in got} == {1, 2, 3}
    flat = [(d, w) for (d, _), words in sorted(got.items()) for w in words]
    assert flat == [(r.doc, r.token) for r in q.document_tokens(spark, papers).orderBy("doc", "pos").collect()]


def test_terms_of_abstracts_have_counts_and_vectors(spark, papers):
    assert {r.token: r.n for r in q.unigram_documents(spark, papers).collect()}["hysteresis"] == 3
    assert "publisher" not in {r.token for r in q.unigram_documents(spark, papers).collect()}
    assert {"hysteresis", "bismuth", "polarization"} <= {r.token for r in q.spectral_embedding(spark, papers).collect()}
    assert {(r.doc, r.sent) for r in q.sentence_vectors(spark, papers).collect()} >= {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}


def test_split_formulas_of_any_length(spark):
    texts = [(1, "on Ga5 V5 N3 and Li2 O"), (2, "Films (of Ga5 V5 N3), Li2\nO."), (2, "on Ga5 V5 N3 and Li2 O"), (3, None), (4, ""), (5, "Li2O . Li2 and O")]
    rows = spark.createDataFrame(texts, "paper_id long, text string")
    terms = spark.createDataFrame([(f"Xx{k}",) for k in range(600)] + [("Ga5V5N3",), ("Li2O",), ("V5N3",), (None,), ("a b",)], "name string")
    got = sorted((r.paper_id, r.tokens) for r in formulas.merge_split_terms(rows, terms).collect())
    first = ["on", "Ga5V5N3", "and", "Li2O"]
    assert got == [(1, first), (2, ["Films", "(of", "Ga5V5N3),", "Li2O."]), (2, first), (4, []), (5, ["Li2O", ".", "Li2", "and", "O"])]


def test_merged_formulas_reads_titles_abstracts_and_all_names(spark, tmp_path):
    n = 600
    tables = {
        "paper": ([(1, "On Ga5 V5 N3", "With X599 Y Z seen.", None, None)], "paper_id long, title string, abstract string, date date, doi string"),
        "chemical": ([(k, f"X{k}YZ") for k in range(n)] + [(n, "Ga5V5N3")], "chemical_id long, name string"),
        "chemical_paper_mapping": ([(k, 1) for k in range(n + 1)], "chemical_id long, paper_id long"),
    }
    for name in ("author", "affiliation", "paper_author_mapping", "author_affiliation_mapping"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.field: r.tokens for r in q.merged_formulas(spark, str(tmp_path)).collect()}
    assert got == {"title": ["On", "Ga5V5N3"], "abstract": ["With", "X599YZ", "seen."]}
