"""What random, fitted and file operators must keep, as queries with SQL that says the same.

Random operators cannot equal another random stream, so their invariants are checked on whole results: every step along
a hyperedge, lengths, caps, membership and counts. Fitted vectors are checked for what defines them, vector operators
on features that SQL can compute, and file formats by writing and reading whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.operators import density, hops, textstats, training, vectors, walks
from litweave.operators.incidence import projection
from litweave.plans.common import BASE, MEMORY, PROPERTY, YEAR, catalog, graph, recent
from litweave.plans.graph_queries import _TM, EVENTS, _expert, _plain_transitions, event_tokens
from litweave.plans.measure_queries import _SD
from litweave.plans.predictors import author_embedding_predictor, embedding_predictor
from litweave.plans.text_queries import _AMOUNTS, _DOCUMENT_TOK, _ELEMENTS, _GRAM, _PW, TOK, _walk_prediction, _walks, composition_vectors, document_sentences, grams, title_tokens
from litweave.runtime import materialise, new_path, table
from litweave.sources import harvest, textio, upsert
from litweave.sources.npz import NpzSource

QUERIES, ORACLE = {}, {}


def query(sql: str):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# walks and samples

_WALKERS = {
    "deepwalk": (6, {}, None),
    "node2vec": (6, {"q": 0.5}, None),
    "alpha": (5, {"weight": walks.weight_alpha(2.0)}, None),
    "entities": (5, {"weight": walks.weight_entities}, "author"),
    "authors": (5, {"weight": walks.weight_authors}, "entity"),
    "mixture": (5, {"weight": walks.weight_mixture({"author": 0.4, "entity": 0.6})}, None),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', 200, true, true, true, true, true)" for n in _WALKERS) + ") t(name, n_walks, from_keyword, in_length, on_edges, leaves, kinds)")
def walk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every walk starts at the keyword, keeps its length, moves along a hyperedge that holds both nodes, and never stays."""
    inc, out = recent(spark, sf_dir).inc, None
    for name, (length, options, never) in _WALKERS.items():
        w = materialise(walks.keyword_walks(inc, 200, length, **options), "checked-walks")
        before = w.select("walk", (F.col("pos") + 1).alias("pos"), F.col("t").alias("pt"), F.col("v").alias("pv"))
        steps = w.where(F.col("pos") > 0).join(before, ["walk", "pos"])
        steps = steps.join(inc.select("e", "t", "v", F.lit(1).alias("to")), ["e", "t", "v"], "left").join(inc.select("e", F.col("t").alias("pt"), F.col("v").alias("pv"), F.lit(1).alias("at")), ["e", "pt", "pv"], "left")
        step = steps.agg(F.every(F.col("to").isNotNull() & F.col("at").isNotNull()).alias("on_edges"), F.every((F.col("t") != F.col("pt")) | (F.col("v") != F.col("pv"))).alias("leaves"), F.every(F.col("t") != F.lit(never or "")).alias("kinds"))
        whole = w.agg(F.lit(name).alias("name"), F.count_distinct("walk").alias("n_walks"), F.every((F.col("pos") > 0) | (F.col("t") == "keyword")).alias("from_keyword"), F.every(F.col("pos") < length).alias("in_length"))
        one = whole.join(F.broadcast(step))
        out = one if out is None else out.unionByName(one)
    return out


_EDGES = f"""{BASE}, q AS ({_TM.format(w="1.0 / siz.s", s="siz")} WHERE a.t = 'entity' AND b.t = 'entity' AND a.v <> b.v GROUP BY 1, 2, 3, 4)"""


@query(f"{_EDGES} SELECT count(DISTINCT v1) AS n_sources, true AS along_edges FROM q")
def positive_sample_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step samples: every node with an edge has some, and all are edges."""
    trans = _plain_transitions(spark, sf_dir)
    found = walks.positive_samples(trans, 3, 2).join(trans.select("src", "dst", F.lit(1).alias("edge")), ["src", "dst"], "left")
    return found.agg(F.count_distinct("src").alias("n_sources"), F.every(F.col("edge").isNotNull()).alias("along_edges"))


@query("SELECT 250 AS n_rows, true AS in_pool, true AS leaves")
def expert_walk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pool = _expert(spark, sf_dir)
    found = materialise(found, "checked-walks")
    near = found.join(found.select("walk", (F.col("pos") + 1).alias("pos"), F.col("v").alias("before")), ["walk", "pos"], "left").join(pool.withColumn("known", F.lit(1)), "v", "left")
    return near.agg(F.count("*").alias("n_rows"), F.every(F.col("known").isNotNull()).alias("in_pool"), F.every(F.col("before").isNull() | (F.col("before") != F.col("v"))).alias("leaves"))


@query("SELECT true AS of_the_paper, true AS once_a_run")
def random_entity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity picked for a step is one of its paper, and not picked twice in a row of steps on that paper."""
    inc = recent(spark, sf_dir).inc
    w, members = materialise(walks.keyword_walks(inc, 200, 6), "checked-walks"), inc.where(F.col("t") == "entity")
    picks = walks.random_entities(w, members).where(F.col("v").isNotNull()).join(w.select("walk", "pos", "e"), ["walk", "pos"])
    held = picks.join(members.select("e", "v", F.lit(1).alias("known")), ["e", "v"], "left")
    after = held.select("walk", (F.col("pos") + 1).alias("pos"), F.col("e").alias("pe"), F.col("v").alias("pv"))
    both = held.join(after, ["walk", "pos"], "left")
    return both.agg(F.every(F.col("known").isNotNull()).alias("of_the_paper"), F.every(F.col("pe").isNull() | (F.col("pe") != F.col("e")) | (F.col("pv") != F.col("v"))).alias("once_a_run"))


@query(f"""{_SD}, s AS (SELECT v, sum(sd) FILTER (year BETWEEN {YEAR - MEMORY} AND {YEAR - 1}) AS s FROM sd GROUP BY v)
SELECT count(*) AS n_entities, least(50, count(*) FILTER (s > 0)) AS n_chosen, 0::BIGINT AS n_wrong FROM s""")
def random_density_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty entities with density score 1, all others 0."""
    sd = materialise(density.social_density(graph(spark, sf_dir).written()), "densities")
    found = density.random_density(sd, YEAR, MEMORY).join(density.scalar_density(sd, YEAR, MEMORY).withColumnRenamed("score", "s"), "v", "left")
    wrong = (F.col("score") == 1) & ~F.coalesce(F.col("s") > 0, F.lit(False)) | ~F.col("score").isin(0.0, 1.0)
    return found.agg(F.count("*").alias("n_entities"), F.sum((F.col("score") == 1).cast("long")).alias("n_chosen"), F.sum(wrong.cast("long")).alias("n_wrong"))


_PROJECTED = f"{BASE}, ed AS (SELECT DISTINCT a.v AS src, b.v AS dst FROM win a JOIN win b USING (e) WHERE a.t = 'entity' AND b.t = 'entity' AND a.v <> b.v)"


@query(f"{_PROJECTED} SELECT src, least(10, count(*)) AS n, true AS along_edges FROM ed GROUP BY src")
def neighbor_sample_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = materialise(projection(recent(spark, sf_dir).inc.where(F.col("t") == "entity")).select(F.col("v1").alias("src"), F.col("v2").alias("dst")).where(F.col("src") != F.col("dst")), "edges")
    found = training.sample_neighbors(p, 10).join(p.withColumn("edge", F.lit(1)), ["src", "dst"], "left")
    return found.groupBy("src").agg(F.count_distinct("dst").alias("n"), F.every(F.col("edge").isNotNull()).alias("along_edges"))


@query(f"{BASE} SELECT count(*) AS n_rows, ceil(count(*) / 500.0)::INT AS n_batches FROM win")
def mini_batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row is in one batch, and the batches are as many as their size asks for."""
    return training.mini_batches(recent(spark, sf_dir).inc, 500).groupBy("e", "t", "v").agg(F.count("*").alias("n"), F.min("batch").alias("batch")).agg(F.sum("n").alias("n_rows"), (F.max("batch") + 1).alias("n_batches"))


@query(f"{_PW} SELECT least(50, count(DISTINCT token)) AS n, true AS unstudied FROM un")
def random_prediction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, first = _walks(spark, sf_dir)
    open_ = tokens.where(F.col("token") != "kw").select("token").distinct().join(first.where(F.col("year") < YEAR), "token", "left_anti").withColumn("open", F.lit(1))
    found = _walk_prediction(spark, sf_dir, "random").join(open_, "token", "left")
    return found.agg(F.count_distinct("token").alias("n"), F.every(F.col("open").isNotNull()).alias("unstudied"))


# models


@query(f"WITH {_GRAM}, r AS (SELECT center, sum(n) AS s FROM gr GROUP BY center) SELECT count(DISTINCT context) AS n_vectors, true AS orthonormal FROM gr g JOIN r a ON a.center = g.center JOIN r b ON b.center = g.context WHERE g.n * (SELECT sum(n) FROM gr)::DOUBLE / (a.s::DOUBLE * b.s) > 1")
def spectral_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output vectors are orthonormal columns over all tokens of the table."""
    ppmi = materialise(textstats.sppmi(materialise(grams(spark, sf_dir), "grams"), 1.0), "ppmi")
    v = materialise(training.spectral(ppmi, 4, 3).where(F.col("out_vec").isNotNull()), "spectral")
    cells = [F.abs(F.sum(F.col("out_vec")[i] * F.col("out_vec")[j]) - float(i == j)) < 1e-6 for i in range(4) for j in range(4)]
    return v.agg(F.count("*").alias("n_vectors"), F.forall(F.array(*cells), lambda x: x).alias("orthonormal"))


@query(f"WITH {_DOCUMENT_TOK} SELECT count(*) AS n_tokens, 16 AS size, true AS finite FROM (SELECT token FROM tok GROUP BY token HAVING count(*) >= 5)")
def word2vec_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with five occurrences has a vector."""
    v = training.word2vec(document_sentences(spark, sf_dir), "words", 16)
    return v.agg(F.count_distinct("token").alias("n_tokens"), F.max(F.size("vec")).alias("size"), F.every(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))).alias("finite"))


@query(f"{BASE} SELECT count(DISTINCT v) AS n_nodes, true AS of_length_one FROM win WHERE t = 'entity'")
def graph_inference_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers give every node a vector of length one (or none of any length after the first layer's cut at 0)."""
    import numpy as np

    inc = recent(spark, sf_dir).inc.where(F.col("t") == "entity")
    edges = materialise(projection(inc).select(F.col("v1").alias("src"), F.col("v2").alias("dst")).where(F.col("src") != F.col("dst")), "edges")
    features = inc.groupBy("v").agg(F.array(F.count("*").cast("double"), F.lit(1.0), F.avg(F.col("e") % 7).cast("double")).alias("vec"))
    found = training.graph_inference(features, edges, [(np.eye(3), np.ones((3, 3)) / 3), (np.eye(3), np.eye(3))])
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    return found.agg(F.count_distinct("v").alias("n_nodes"), F.every(F.abs(length - 1) < 1e-9).alias("of_length_one"))


@query(f"""WITH {_AMOUNTS}, m AS (SELECT chemical_id, map(list(element), list(amount)) AS m FROM am GROUP BY chemical_id),
x AS (SELECT c.chemical_id AS v, list_transform({_ELEMENTS!r}, lambda e: coalesce(m.m[e], 0.0)) AS a FROM chemical c LEFT JOIN m USING (chemical_id) WHERE c.name IS NOT NULL),
n AS (SELECT v, a, sqrt(list_sum(list_transform(a, lambda z: z * z))) AS n FROM x)
SELECT v, list_transform(list_concat(a, [0.0, 0.0]), lambda z: CASE WHEN n > 0 THEN round(z / n, 6) ELSE 0.0 END) AS vec FROM n""")
def composition_vector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all named entities, rounded."""
    names = table(spark, sf_dir, "chemical").where(F.col("name").isNotNull()).select(F.col("chemical_id").alias("v"))
    return composition_vectors(spark, sf_dir).join(names, "v", "left_semi").select("v", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


# vector operators on plain features of tokens: length, count modulo 7, one

_PLAIN_EMB = f"{TOK}, em AS (SELECT token, [length(token)::DOUBLE, (count(*) % 7)::DOUBLE, 1.0] AS vec, count(*) AS n FROM tok GROUP BY token)"
_COSINE = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _plain_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = textstats.unigrams(title_tokens(spark, sf_dir))
    return materialise(counts.select("token", F.array(F.length("token").cast("double"), (F.col("n") % 7).cast("double"), F.lit(1.0)).alias("vec"), "n"), "plain-vectors")


@query(f"WITH {_PLAIN_EMB}, s AS (SELECT doc, pos // 10 AS sent, token FROM tok), x AS (SELECT s.doc, s.sent, i.i, avg(em.vec[i.i] * (0.001 / (0.001 + em.n))) AS x FROM s JOIN em USING (token), (SELECT unnest([1, 2, 3]) AS i) i GROUP BY 1, 2, 3) SELECT doc, sent::INT AS sent, list(round(x, 9) ORDER BY i) AS vec FROM x GROUP BY doc, sent")
def sentence_vector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = title_tokens(spark, sf_dir).select("doc", F.floor(F.col("pos") / 10).cast("int").alias("sent"), "token")
    found = vectors.sentence_vectors(tokens, _plain_vectors(spark, sf_dir))
    return found.select("doc", "sent", F.transform("vec", lambda x: F.round(x, 9)).alias("vec"))


@query(f"""WITH {_PLAIN_EMB}, kw AS (SELECT vec FROM em WHERE token IN ({", ".join(f"'{w}'" for w in PROPERTY.split())})), b AS (SELECT em.token, max({_COSINE.format("em.vec", "kw.vec")}) AS sim FROM em, kw GROUP BY em.token)
SELECT m.author_id AS author, p.paper_id AS paper, year(p.date)::INT AS year, round(max(b.sim), 9) AS sim FROM tok JOIN b USING (token) JOIN paper p ON p.paper_id = tok.doc JOIN (SELECT DISTINCT paper_id, author_id FROM paper_author_mapping WHERE author_id IS NOT NULL) m ON m.paper_id = p.paper_id GROUP BY 1, 2, 3""")
def author_similarity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    own = title_tokens(spark, sf_dir).withColumnRenamed("doc", "paper_id").join(c.paper_author.where(F.col("author_id").isNotNull()).distinct(), "paper_id").join(c.paper.select("paper_id", "year"), "paper_id")
    found = vectors.author_similarity(own.select(F.col("author_id").alias("author"), F.col("paper_id").alias("paper"), "year", "token"), PROPERTY.split(), _plain_vectors(spark, sf_dir))
    return found.withColumn("sim", F.round("sim", 9))


_NAMED_EMB = "ne AS (SELECT lower(name) AS token, min(chemical_id) AS v, [length(name)::DOUBLE, (min(chemical_id) % 5)::DOUBLE, 1.0] AS vec FROM chemical WHERE name IS NOT NULL GROUP BY lower(name), length(name))"


@query(f"{BASE}, {_NAMED_EMB} SELECT v, round({_COSINE.format('vec', '[1.0::DOUBLE, 2.0, 3.0]')}, 9) AS score FROM ne WHERE v NOT IN (SELECT v FROM fy WHERE year < {YEAR}) ORDER BY 2 DESC, v LIMIT 50")
def embedding_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding predictor over plain vectors of names."""
    names = catalog(spark, sf_dir).entity.where(F.col("name").isNotNull()).groupBy(F.lower("name").alias("token"), F.length("name").alias("size")).agg(F.min("entity_id").alias("v"))
    emb = names.select("token", F.array(F.col("size").cast("double"), (F.col("v") % 5).cast("double"), F.lit(1.0)).alias("vec"))
    anchor = spark.createDataFrame([("the keyword", [1.0, 2.0, 3.0])], "token string, vec array<double>")
    return embedding_predictor(graph(spark, sf_dir), emb.unionByName(anchor), names.select("v", "token"), "the keyword")(YEAR, scores=True)


@query(f"WITH au AS (SELECT author_id AS author, [(author_id % 11)::DOUBLE, (author_id % 7)::DOUBLE, 1.0] AS vec FROM author) SELECT author, round({_COSINE.format('vec', '[1.0::DOUBLE, 2.0, 3.0]')}, 9) AS score FROM au ORDER BY 2 DESC, author LIMIT 50")
def author_embedding_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author predictor over plain vectors of authors."""
    ids = catalog(spark, sf_dir).author.select("author_id")
    emb = ids.select(F.concat(F.lit("a_"), F.col("author_id").cast("string")).alias("token"), F.array((F.col("author_id") % 11).cast("double"), (F.col("author_id") % 7).cast("double"), F.lit(1.0)).alias("vec"))
    anchor = spark.createDataFrame([("kw", [1.0, 2.0, 3.0])], "token string, vec array<double>")
    return author_embedding_predictor(emb.unionByName(anchor), "kw")(scores=True)


# files: whole tables written and read again


@query(f"WITH {EVENTS} SELECT pos::INT AS pos, token, count(*) AS n FROM ev GROUP BY 1, 2")
def walk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks as lines of text."""
    path = new_path(spark, "walk-files")
    textio.write_walks(walks.sentences(event_tokens(spark, sf_dir), F.col("token")), path)
    return textio.read_walks(spark, path).groupBy("pos", "token").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, w AS (SELECT walk, count(*) AS size FROM ev GROUP BY walk) SELECT size::INT AS size, count(*) AS n FROM w GROUP BY 1")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of texts, a document a line."""
    path = new_path(spark, "corpus-files")
    textio.write_walks(walks.sentences(event_tokens(spark, sf_dir), F.col("token")), path)
    return textio.corpus_tokens(spark, path).groupBy(F.size("tokens").alias("size")).agg(F.count("*").alias("n"))


@query("SELECT year(date)::DOUBLE AS value, count(*) AS n FROM paper GROUP BY 1")
def number_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, one a line; what is no number comes back as null."""
    path = new_path(spark, "number-files")
    catalog(spark, sf_dir).paper.select(F.coalesce(F.col("year").cast("string"), F.lit("none")).alias("value")).write.text(path)
    return textio.read_numbers(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT paper_id::VARCHAR AS id, year(date)::VARCHAR AS at FROM paper")
def column_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of three of a delimited file."""
    path = new_path(spark, "column-files")
    catalog(spark, sf_dir).paper.select("paper_id", F.lit("x").alias("other"), "year").write.csv(path, sep="\t", header=True)
    return textio.read_columns(spark, path, {"paper_id": "id", "year": "at"})


@query("SELECT vec_id::VARCHAR AS token, 64 AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as lines of an id and its components."""
    path = new_path(spark, "vector-files")
    e = table(spark, sf_dir, "embeddings")
    e.select(F.concat_ws(",", F.col("vec_id").cast("string"), F.transform("embedding", lambda x: x.cast("string"))).alias("value")).write.text(path)
    return textio.read_vectors(spark, path).select("token", F.size("vec").alias("size"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query("SELECT source AS key, max_repeats AS value FROM source_target")
def json_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object of a small table (one row a source)."""
    path = new_path(spark, "json-file")
    table(spark, sf_dir, "source_target").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "max_repeats")))).alias("value")).write.text(path)
    return textio.read_json_map(spark, path)


@query("SELECT DISTINCT paper_id AS src, chemical_id AS dst FROM chemical_paper_mapping WHERE paper_id IS NOT NULL AND chemical_id IS NOT NULL")
def adjacency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency lines: a paper and its entities."""
    path = new_path(spark, "adjacency-files")
    pairs = catalog(spark, sf_dir).paper_entity.where(F.col("paper_id").isNotNull() & F.col("entity_id").isNotNull())
    pairs.groupBy("paper_id").agg(F.collect_set("entity_id").alias("n")).select(F.concat_ws(" ", F.col("paper_id").cast("string"), F.transform("n", lambda x: x.cast("string"))).alias("value")).write.text(path)
    return textio.read_adjacency(spark, path)


@query("SELECT year(date)::INT AS year, count(*) AS n, sum(paper_id)::BIGINT AS ids FROM paper WHERE date IS NOT NULL GROUP BY 1")
def year_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers in folders of years."""
    path = new_path(spark, "year-files")
    textio.write_by_year(catalog(spark, sf_dir).paper.where(F.col("year").isNotNull()).select("paper_id", "year"), path)
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("paper_id").alias("ids"))


@query(f"{BASE} SELECT e AS row, v AS col, 1.0::DOUBLE AS value FROM win WHERE t = 'entity'")
def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidence of papers and entities as a sparse matrix in .npz files."""
    path = new_path(spark, "matrix-files")
    spark.dataSource.register(NpzSource)
    recent(spark, sf_dir).inc.where(F.col("t") == "entity").select(F.col("e").alias("row"), F.col("v").alias("col"), F.lit(1.0).alias("value")).write.format("npz").mode("append").save(path)
    return spark.read.format("npz").load(path)


def _write_archive(folder: str):
    """A writer of one zip archive a task: a compressed XML member with the papers of the task."""

    def run(batches):
        import gzip
        import uuid
        import zipfile
        from xml.sax.saxutils import escape, quoteattr

        import pyarrow as pa

        from litweave.sources.files import open_fs

        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not rows:
            return
        system, at = open_fs(folder)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{uuid.uuid4().hex}_2001.zip") as raw, zipfile.ZipFile(raw, "w") as z, z.open("part.xml.gz", "w") as member, gzip.open(member, "wt", encoding="utf-8") as out:
            out.write('<records xmlns="http://example.org/r">')
            for date, title, abstract, doi in rows:
                day = f"<pub_info sortdate={quoteattr(date)}/>" if date else ""
                name = f'<titles><title type="source">x</title><title type="item">{escape(title)}</title></titles>' if title else ""
                text = f"<fullrecord_metadata><abstracts><abstract><abstract_text><p>{escape(abstract)}</p></abstract_text></abstract></abstracts></fullrecord_metadata>" if abstract else ""
                key = f'<identifiers><identifier type="issn" value="1"/><identifier type="xref_doi" value={quoteattr(doi)}/></identifiers>' if doi else ""
                out.write(f"<REC><static_data><summary>{day}{name}<doctypes><doctype>Article</doctype></doctypes></summary>{text}</static_data><dynamic_data><cluster_related>{key}</cluster_related></dynamic_data></REC>")
            out.write("</records>")
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    return run


#: What XML keeps of a text: no control characters, line ends as line feeds.
_SAID = r"nullif(regexp_replace(regexp_replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '')"
_TRIMMED = r"nullif(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '')"


@query(f"SELECT 'Article' AS doc_type, CASE WHEN year(date) BETWEEN 1 AND 9999 THEN date END AS date, {_SAID.format('title')} AS title, {_SAID.format('abstract')} AS abstract, {_TRIMMED.format('doi')} AS doi FROM paper")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as zip archives of compressed XML, harvested again (control characters, which XML cannot hold, left out)."""
    path = new_path(spark, "archives")
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    papers = table(spark, sf_dir, "paper").select(F.when(F.year("date").between(1, 9999), F.col("date").cast("string")), clean("title"), clean("abstract"), clean("doi"))
    papers.mapInArrow(_write_archive(path), "n long").write.format("noop").mode("overwrite").save()
    records, _ = harvest.extract_records(harvest.read_archives(spark, path))
    return records.select("doc_type", "date", "title", "abstract", "doi")


@query("""WITH d AS (SELECT doi, min(paper_id) AS paper_id FROM paper WHERE doi IS NOT NULL GROUP BY doi), old AS (SELECT doi FROM d WHERE paper_id % 2 = 0), new AS (SELECT * FROM d WHERE paper_id % 2 = 1),
a AS (SELECT scopus_id, min(author_id) AS author_id FROM author WHERE scopus_id IS NOT NULL GROUP BY scopus_id),
m AS (SELECT DISTINCT new.doi, a.scopus_id FROM new JOIN paper_author_mapping p USING (paper_id) JOIN a ON a.author_id = p.author_id)
SELECT (SELECT count(*) FROM d) AS n_papers, (SELECT count(DISTINCT scopus_id) FROM m) AS n_authors, (SELECT count(*) FROM m) AS n_links, true AS keys_differ""")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the papers are known, all others are delivered with their authors; every natural key ends up once."""
    c = catalog(spark, sf_dir)
    first = c.paper.where(F.col("doi").isNotNull()).groupBy("doi").agg(F.min("paper_id").alias("paper_id"))
    papers = materialise(first.join(c.paper.select("paper_id", "date", "title", "abstract"), "paper_id"), "upsert-papers")
    people = c.author.where(F.col("scopus_id").isNotNull()).groupBy("scopus_id").agg(F.min("author_id").alias("author_id"))
    people = people.join(c.author.select("author_id", "given_name", "surname"), "author_id")
    place = F.array().cast("array<struct<scopus_id:string,name:string,city:string,country:string>>").alias("affiliations")
    who = c.paper_author.distinct().join(people, "author_id").groupBy("paper_id").agg(F.collect_set(F.struct("scopus_id", "given_name", "surname", place)).alias("authors"))
    none = F.array().cast("array<struct<scopus_id:string,given_name:string,surname:string,affiliations:array<struct<scopus_id:string,name:string,city:string,country:string>>>>")
    incoming = papers.join(who, "paper_id", "left").select("paper_id", "doi", "date", "title", "abstract", F.coalesce("authors", none).alias("authors"))
    known = papers.where(F.pmod("paper_id", F.lit(2)) == 0).select("paper_id", "doi", "date", "title", "abstract")
    out = upsert.upsert_papers(known, c.author.limit(0), c.affiliation.limit(0), c.paper_author.limit(0), c.author_affiliation.limit(0), incoming.drop("paper_id"))
    n = lambda t, x: out[t].agg(F.count("*").alias(x))
    keys = out["paper"].agg((F.count("*") == F.count_distinct("paper_id")).alias("keys_differ"))
    return n("paper", "n_papers").join(F.broadcast(n("author", "n_authors"))).join(F.broadcast(n("paper_author", "n_links"))).join(F.broadcast(keys))
