"""Archives, upserts, files, sparse matrices and streams."""

from __future__ import annotations

import gzip
import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from litweave.functions import predicates, text
from litweave.sources import harvest, textio, upsert
from litweave.sources.npz import NpzSource

DOC = """<REC xmlns="http://x"><UID>1</UID><static_data><summary><pub_info sortdate="2001-02-03"/><titles><title type="source">S</title><title type="item">T &amp; "q"</title></titles>
<doctypes><doctype>Article</doctype></doctypes></summary><fullrecord_metadata><abstracts><abstract><abstract_text><p>P1</p><p>P2</p></abstract_text></abstract></abstracts></fullrecord_metadata></static_data>
<dynamic_data><cluster_related><identifiers><identifier type="issn" value="1"/><identifier type="xref_doi" value="10.1/a"/></identifiers></cluster_related></dynamic_data></REC>"""
BARE = "<REC><static_data><summary><doctypes><doctype>Note</doctype></doctypes></summary></static_data></REC>"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "2001_DATA.zip", "w") as z:
        for name, body in (("a.xml.gz", f"<records>{DOC}{BARE}</records>"), ("b.xml.gz", f"<records>{DOC}<REC>"), ("c.txt", "no")):
            buffer = io.BytesIO()
            with gzip.GzipFile(fileobj=buffer, mode="w") as g:
                g.write(body.encode())
            z.writestr(name, buffer.getvalue())
    archives = harvest.read_archives(spark, str(tmp_path))
    records, rejects = harvest.extract_records(archives)
    rows = {(r.member, r.number): r for r in records.collect()}
    first = rows["a.xml.gz", 0]
    assert (first.year, first.doc_type, str(first.date), first.title, first.abstract, first.doi) == (2001, "Article", "2001-02-03", 'T & "q"', "P1", "10.1/a")
    bare = rows["a.xml.gz", 1]
    assert (bare.doc_type, bare.date, bare.title, bare.abstract, bare.doi) == ("Note", None, None, None, None)
    assert ("b.xml.gz", 0) in rows and [(r.member, r.number, r.xml) for r in rejects.collect()] == [("b.xml.gz", 1, None)]
    again, _ = harvest.replay(spark.createDataFrame([("z", 2001, "m", 0, DOC.replace("P1", "P\\1\x01"))], "archive string, year int, member string, number long, xml string"))
    assert again.first().abstract == "P1"


def test_upsert(spark):
    paper = spark.createDataFrame([(5, "10.1/a", None, "old", None)], "paper_id long, doi string, date date, title string, abstract string")
    author = spark.createDataFrame([(3, "S1", "A", "B")], "author_id long, scopus_id string, given_name string, surname string")
    aff = spark.createDataFrame([], "aff_id long, scopus_id string, name string, city string, country string")
    pa = spark.createDataFrame([(5, 3)], "paper_id long, author_id long")
    af = spark.createDataFrame([], "author_id long, aff_id long")
    place = ("F1", "Inst", "C", "L")
    incoming = spark.createDataFrame(
        [("10.1/a", None, "again", None, []), ("10.1/b", None, "new", None, [("S1", "A", "B", [place]), ("S2", "C", "D", [place]), ("S2", "C", "D", [])]), ("10.1/c", None, "new2", None, [("S2", "C", "D", [])]), (None, None, "no doi", None, [])],
        "doi string, date date, title string, abstract string, authors array<struct<scopus_id: string, given_name: string, surname: string, affiliations: array<struct<scopus_id: string, name: string, city: string, country: string>>>>",
    )
    out = upsert.upsert_papers(paper, author, aff, pa, af, incoming)
    assert sorted((r.paper_id, r.doi) for r in out["paper"].collect())[0] == (5, "10.1/a") and {r.paper_id for r in out["paper"].collect()} == {5, 6, 7}
    assert sorted((r.author_id, r.scopus_id) for r in out["author"].collect()) == [(3, "S1"), (4, "S2")]
    assert out["paper_author"].count() == 4 and out["author_affiliation"].count() == 2 and out["affiliation"].count() == 1
    more, bridge, unknown = upsert.complete_affiliations(out["author"], out["affiliation"], out["author_affiliation"], spark.createDataFrame([("S2", "F9", "n", "c", "l"), ("S7", "F9", "n", "c", "l")], "author_scopus string, scopus_id string, name string, city string, country string"))
    assert more.count() == 2 and bridge.count() == 3 and [r.author_scopus for r in unknown.collect()] == ["S7"]


def test_files(spark, tmp_path):
    textio.write_walks(spark.createDataFrame([("K a_1 x",), ("K y",)], "sentence string").coalesce(1), str(tmp_path / "w"))
    textio.write_walks(spark.createDataFrame([("K z",)], "sentence string"), str(tmp_path / "w"))
    walks = textio.read_walks(spark, str(tmp_path / "w"))
    assert walks.select("walk").distinct().count() == 3 and walks.count() == 7
    (tmp_path / "t.tsv").write_text("id\tname\tx\n1\tA\t0\n")
    assert textio.read_columns(spark, str(tmp_path / "t.tsv"), {"name": "drug"}).collect()[0].asDict() == {"drug": "A"}
    (tmp_path / "v.csv").write_text("d1,0.5,1\n")
    assert textio.read_vectors(spark, str(tmp_path / "v.csv")).first().vec == [0.5, 1.0]
    (tmp_path / "m.json").write_text('{"a": 1990, "b": 2000}')
    assert dict(map(tuple, textio.read_json_map(spark, str(tmp_path / "m.json")).collect())) == {"a": 1990, "b": 2000}
    (tmp_path / "adj").write_text("# c\n1 2 3\n4\n")
    assert sorted(map(tuple, textio.read_adjacency(spark, str(tmp_path / "adj")).collect())) == [(1, 2), (1, 3)]
    (tmp_path / "n").write_text("1991\nx\n2000.5\n")
    assert [r.value for r in textio.read_numbers(spark, str(tmp_path / "n")).collect()] == [1991.0, None, 2000.5]
    textio.write_by_year(spark.createDataFrame([(2001, 1), (2002, 2)], "year int, x int"), str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).where("year = 2002").first().x == 2
    assert textio.corpus_tokens(spark, str(tmp_path / "n")).count() == 3


def test_npz(spark, tmp_path):
    spark.dataSource.register(NpzSource)
    dense = np.array([[0, 2, 0], [1, 0, 3]])
    row, col = dense.nonzero()
    np.savez(tmp_path / "m.npz", data=dense[row, col], indices=col, indptr=np.array([0, 1, 3]), shape=np.array([2, 3]), format=b"csr")
    df = spark.read.format("npz").load(str(tmp_path / "m.npz"))
    cells = sorted(map(tuple, df.collect()))
    assert cells == [(0, 1, 2.0), (1, 0, 1.0), (1, 2, 3.0)]
    df.write.format("npz").mode("append").save(str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.format("npz").load(str(tmp_path / "out")).collect())) == cells


def test_stream(spark, tmp_path):
    from litweave.streaming import harvest as live

    lines = spark.createDataFrame([(1, "1,A,,T,B,"), (2, "bad"), (3, '1,A,,"T,B,')], "line_id long, line string")
    lines.write.parquet(str(tmp_path / "in"))
    q = live.load_lines(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.line_id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert {r.line_id: r.reason for r in spark.read.parquet(str(tmp_path / "no")).collect()} == {2: "column_count", 3: "quoting"}
    rows = spark.createDataFrame([(1, "2020-01-01"), (1, "2020-01-02"), (2, "2020-01-03")], "k int, d string").select("k", F.to_timestamp("d").alias("loaded_at"))
    rows.write.parquet(str(tmp_path / "rows"))
    s = live.arrivals_by_period(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows")), "k").writeStream.outputMode("complete").format("memory").queryName("arrivals").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert {(r.k, r.n) for r in spark.sql("SELECT k, sum(n) AS n FROM arrivals GROUP BY k").collect()} == {(1, 2), (2, 1)}


def test_text_functions(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c.alias("x")).first().x
    assert one(text.clean_text(F.col("a")), a="Inf. © 2001 Press. All rights reserved.") == "inf.  "
    long = "© " + " ".join(["w"] * 30) + "."
    assert one(text.clean_text(F.col("a")), a=long) == long
    assert one(text.prune_walk(F.col("w"), "author"), w="kw a_1 aff_2 x1.5 a_b") == "kw aff_2 x1.5 a_b"
    assert one(text.prune_walk(F.col("w"), "entity", "kw"), w="kw a_1 aff_2 x") == "kw a_1 aff_2"
    assert one(text.prune_walk(F.col("w"), "author_affiliation"), w="kw a_1 kw") is None
    assert one(text.merge_split_terms(F.split("t", " "), F.array(F.lit("Li2O"), F.lit("NaCl"))), t="of Li2 O and Na Cl x") == ["of", "Li2O", "and", "NaCl", "x"]
    assert one(text.composition(F.col("f")), f="Li2O4Li") == {"Li": 3.0, "O": 4.0}
    assert one(text.normalise(F.col("t")), t="Heated to 95.5 K, Li2O!") == "heated to <nUm> k li2o"
    df = spark.createDataFrame([("100% Curie", None), ("100x curie", "Curie"), (None, None)], "title string, abstract string")
    assert [r.x for r in df.select(predicates.keyword(("title", "abstract"), "100%").alias("x")).collect()] == [True, False, False]
    assert [r.x for r in df.select(predicates.keywords(["Curie", "100"], comb="AND", case_sensitives=["Curie"]).alias("x")).collect()] == [True, True, False]


def test_inverse_normal(spark):
    from statistics import NormalDist

    from litweave.functions.scores import inverse_normal

    ps = [0.001, 0.02, 0.1, 0.5, 0.77, 0.99, 0.9999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(inverse_normal(F.col("p")).alias("x")).collect()
    assert all(abs(r.x - NormalDist().inv_cdf(p)) < 1e-8 for r, p in zip(got, ps, strict=True))


def test_npz_is_read_in_pieces(tmp_path, monkeypatch):
    from litweave.sources import npz

    dense = np.array([[0, 1, 2, 3, 4], [0, 0, 0, 0, 0], [5, 0, 0, 0, 6]])
    row, col = np.nonzero(dense)
    ptr = np.concatenate([[0], np.cumsum((dense != 0).sum(1))])
    np.savez_compressed(tmp_path / "a.npz", data=dense[row, col], indices=col, indptr=ptr, shape=np.array(dense.shape), format=b"csr")
    np.savez(tmp_path / "b.npz", data=dense[row, col], row=row, col=col, shape=np.array(dense.shape), format="coo")
    np.savez(tmp_path / "c.npz", data=dense[:0, 0], row=row[:0], col=col[:0], shape=np.array(dense.shape), format="coo")
    reader = npz.NpzReader("file:" + str(tmp_path))
    assert len(reader.partitions()) == 3
    for chunk in (1, 2, 100):
        monkeypatch.setattr(npz, "CHUNK", chunk)
        got = sorted(x for p in reader.partitions() for x in reader.read(p))
        assert got == sorted(2 * list(zip(row.tolist(), col.tolist(), dense[row, col].astype(float).tolist(), strict=True)))
