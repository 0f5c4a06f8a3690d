"""Queries of token statistics, vectors and models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.functions import text
from litweave.operators import evaluate, formulas, textstats, training, vectors
from litweave.plans.graph_queries import EVENTS, event_tokens
from litweave.plans.common import BASE, PROPERTY, catalog, graph, recent
from litweave.plans.predictors import author_embedding_predictor, embedding_predictor, walk_predictor
from litweave.operators.ranking import with_rank
from litweave.runtime import materialise, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, token) of lower-cased paper titles."""
    papers = table(spark, sf_dir, "paper").where(F.col("title").isNotNull())
    return papers.select(F.col("paper_id").alias("doc"), F.posexplode(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}.]+"), F.lit(0))).alias("pos", "token"))


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, sent, words): lower-cased tokens of each sentence of title and abstract; the title is sentence 0."""
    papers = table(spark, sf_dir, "paper").select(F.col("paper_id").alias("doc"), text.title_and_abstract(F.col("title"), F.col("abstract")).alias("text")).where(F.col("text").isNotNull())
    split = papers.select("doc", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("sent", "text"))
    return split.select("doc", "sent", F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)).alias("words")).where(F.size("words") > 0)


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, token) of lower-cased titles and abstracts, one run of positions a paper."""
    papers = table(spark, sf_dir, "paper").select(F.col("paper_id").alias("doc"), text.title_and_abstract(F.col("title"), F.col("abstract")).alias("text")).where(F.col("text").isNotNull())
    return papers.select("doc", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))).alias("pos", "token"))


#: Tokens of running text: dots count within a token only.
WORDS = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"
TOK = """tok AS (SELECT doc, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT paper_id AS doc, regexp_extract_all(lower(title), '[\\pL\\pN.]+') AS l FROM paper WHERE title IS NOT NULL))"""
_NOTE = "CASE WHEN n <> '' AND len(string_split(n, ' ')) < 20 THEN regexp_replace(a, '{0}', '', 'g') ELSE a END AS a FROM (SELECT *, regexp_extract(a, '{0}') AS n FROM {1})"
_DOCUMENT_TOK = f"""d0 AS (SELECT paper_id AS doc, replace(replace(coalesce(title, '') || '. ' || coalesce(abstract, ''), 'Inf', 'inf'), 'All rights reserved.', '') AS a FROM paper WHERE title IS NOT NULL OR abstract IS NOT NULL),
d1 AS (SELECT doc, {_NOTE.format("\\[DOI:(.*)\\]", "d0")}), d2 AS (SELECT doc, {_NOTE.format("©(.*)\\.", "d1")}),
tok AS (SELECT doc, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc, regexp_extract_all(lower(a), '{WORDS}') AS l FROM d2))"""
_GRAM = TOK + ", gr AS (SELECT a.token AS center, b.token AS context, count(*) AS n FROM tok a JOIN tok b ON a.doc = b.doc AND b.pos BETWEEN a.pos - 4 AND a.pos + 4 AND b.pos <> a.pos GROUP BY 1, 2)"
WINDOW = 9


def grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.skipgrams(title_tokens(spark, sf_dir), WINDOW)


@query(f"WITH {TOK} SELECT token, count(*) AS n FROM tok GROUP BY token")
def unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.unigrams(title_tokens(spark, sf_dir))


@query(f"WITH {TOK}, f AS (SELECT token, count(*) AS n, arg_min((doc, pos), (doc, pos)) AS f FROM tok GROUP BY token) SELECT token, n, f[1] AS doc, f[2]::INT AS pos FROM f")
def vocabulary_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.vocabulary(title_tokens(spark, sf_dir))


@query(f"WITH {_GRAM} SELECT * FROM gr")
def skipgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams(spark, sf_dir)


@query(f"WITH {_GRAM}, r AS (SELECT center, sum(n) AS s FROM gr GROUP BY center) SELECT * FROM (SELECT g.center, g.context, round(ln(g.n * (SELECT sum(n) FROM gr)::DOUBLE / (a.s::DOUBLE * b.s)) - ln({WINDOW}), 9) AS v FROM gr g JOIN r a ON a.center = g.center JOIN r b ON b.center = g.context) WHERE v > 0")
def sppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.sppmi(materialise(grams(spark, sf_dir), "grams"), WINDOW).withColumn("v", F.round("v", 9)).where(F.col("v") > 0)


@query(f"""WITH {_GRAM}, q AS (SELECT context, n AS q FROM gr WHERE center = 'polarization'), nm AS (SELECT center, sqrt(sum(n * n)) AS norm FROM gr GROUP BY center)
SELECT g.center AS token, round(sum(g.n * q.q) / (any_value(nm.norm) * (SELECT sqrt(sum(q * q)) FROM q)), 9) AS sim FROM gr g JOIN q USING (context) JOIN nm ON nm.center = g.center WHERE g.center <> 'polarization' GROUP BY g.center""")
def most_similar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.similar_terms(materialise(grams(spark, sf_dir), "grams"), "polarization").withColumn("sim", F.round("sim", 9))


#: A formula is kept when its elements stand in alphabetical order, once each, and no number divides all amounts.
_NORMAL = r"""f AS (SELECT token, n, regexp_extract_all(token, '[A-Z][a-z]?') AS el, list_transform(regexp_extract_all(token, '[A-Z][a-z]?([0-9.]*)', 1), lambda x: CASE WHEN x = '' THEN 1.0 ELSE try_cast(x AS DOUBLE) END) AS am,
  regexp_extract_all(token, '[A-Z][a-z]?([0-9.]*)', 1) AS raw FROM u WHERE regexp_full_match(token, '(?:[A-Z][a-z]?[0-9.]*){2,}'))
SELECT token, n FROM f WHERE n > 2 AND (token IN ('H2', 'O2', 'N2') OR (el = list_sort(el) AND len(el) = len(list_distinct(el)) AND len(list_filter(am, lambda x: x IS NULL)) = 0
  AND len(list_filter(list_zip(am, raw), lambda z: z[2] <> CASE WHEN z[1] = 1 THEN '' WHEN z[1] = floor(z[1]) THEN z[1]::BIGINT::VARCHAR ELSE z[1]::VARCHAR END)) = 0
  AND (len(list_filter(am, lambda x: x <> floor(x) OR x < 1 OR x >= 10000)) > 0 OR len(list_filter(range(2, list_min(am)::BIGINT + 1), lambda d: len(list_filter(am, lambda x: x % d <> 0)) = 0)) = 0)))"""


def cased_tokens(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """(token) of fields of papers, letter case kept: formulas need it."""
    papers = table(spark, sf_dir, "paper")
    return papers.select(F.explode(F.concat(*[F.coalesce(F.regexp_extract_all(f, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>")) for f in fields])).alias("token"))


def _cased(*fields: str) -> str:
    return f"WITH u AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_concat({', '.join(f'coalesce(regexp_extract_all({f}, {chr(39)}{WORDS}{chr(39)}), [])' for f in (*fields, 'NULL::VARCHAR'))})) AS token FROM paper) GROUP BY token), {_NORMAL}"


@query(_cased("title"))
def frequent_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of titles in normal form, above a count."""
    return textstats.frequent_vocabulary(textstats.unigrams(cased_tokens(spark, sf_dir, "title")), 2)


# The same statistics over the whole text of a paper: titles with abstracts. The queries above are those of titles, as their SQL has it.


@query(ORACLE["unigram"].replace(TOK, _DOCUMENT_TOK))
def unigram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.unigrams(document_tokens(spark, sf_dir))


@query(ORACLE["vocabulary_first_seen"].replace(TOK, _DOCUMENT_TOK))
def vocabulary_first_seen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.vocabulary(document_tokens(spark, sf_dir))


@query(ORACLE["skipgram"].replace(TOK, _DOCUMENT_TOK))
def skipgram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.skipgrams(document_tokens(spark, sf_dir), WINDOW)


@query(ORACLE["sppmi"].replace(TOK, _DOCUMENT_TOK))
def sppmi_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.sppmi(materialise(skipgram_documents(spark, sf_dir), "grams"), WINDOW).withColumn("v", F.round("v", 9)).where(F.col("v") > 0)


@query(ORACLE["most_similar_terms"].replace(TOK, _DOCUMENT_TOK))
def most_similar_terms_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.similar_terms(materialise(skipgram_documents(spark, sf_dir), "grams"), "polarization").withColumn("sim", F.round("sim", 9))


@query(_cased("title", "abstract"))
def frequent_vocabulary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of titles and abstracts in normal form, above a count."""
    return textstats.frequent_vocabulary(textstats.unigrams(cased_tokens(spark, sf_dir, "title", "abstract")), 2)


@query(f"WITH {EVENTS} SELECT token, count(*) AS n FROM ev WHERE token <> 'signup' GROUP BY token")
def walk_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.walk_token_counts(event_tokens(spark, sf_dir), "signup")


@query("""WITH e AS (SELECT event_id, string_split('a_' || user_id || ' ' || event_type || ' aff_' || (event_id % 7) || ' ' || event_type || ' kw', ' ') AS l FROM events)
SELECT event_id, event_type || ' ' || event_type || ' kw' AS walk FROM events""")
def pruned_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    walk = F.concat_ws(" ", F.concat(F.lit("a_"), "user_id"), "event_type", F.concat(F.lit("aff_"), F.col("event_id") % 7), "event_type", F.lit("kw"))
    return e.select("event_id", text.prune_walk(walk, "author_affiliation").alias("walk"))


@query("SELECT event_id, user_id AS author FROM events")
def author_of_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.author_of_token(F.concat(F.lit("a_"), F.col("user_id").cast("string"))).alias("author"))


@query()
def merged_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, field, tokens): tokens of titles and abstracts with split formulas, in any number of pieces, joined again."""
    c = catalog(spark, sf_dir)
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "abstract")])).alias("f")
    texts = c.paper.select("paper_id", fields).select("paper_id", "f.field", "f.text")
    return formulas.merge_split_terms(texts, c.entity)


# vectors

_EMB = "em AS (SELECT vec_id::VARCHAR AS token, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings)"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, vec, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vec"), "label")


@query(f"WITH {_EMB} SELECT a.token, round({_COS.format('a.vec', 'b.vec')}, 6) AS sim FROM em a, (SELECT vec FROM em WHERE token = '1') b")
def cosine_to_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return vectors.cosine_to_anchor(e, e, "1").withColumn("sim", F.round("sim", 6))


@query(f"WITH {_EMB} SELECT a.token AS a, b.token AS b, round({_COS.format('a.vec', 'b.vec')}, 6) AS sim FROM em a, em b WHERE a.token::BIGINT % 100 = 0")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every id divisible by 100, against all rows."""
    e = emb(spark, sf_dir)
    return vectors.cosine_pairs(e.where(F.col("token").cast("long") % 100 == 0), e).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_EMB} SELECT round(max({_COS.format('a.vec', 'b.vec')}), 6) AS sim FROM em a, em b WHERE a.label = 1 AND b.label = 2")
def max_cosine_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = materialise(emb(spark, sf_dir), "vectors")
    return vectors.max_cosine(e.where(F.col("label") == 1), e.where(F.col("label") == 2), e).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_EMB} SELECT a.token, round(exp(-sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))), 6) AS sim FROM em a, (SELECT vec FROM em WHERE token = '1') b")
def euclid_to_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    one = e.where(F.col("token") == "1").select(F.col("vec").alias("q"))
    return e.join(F.broadcast(one)).select("token", F.round(vectors.euclid_similarity(F.col("vec"), F.col("q")), 6).alias("sim"))


@query(f"WITH {_EMB} SELECT token, list_transform(vec, lambda x: round(x / sqrt(list_dot_product(vec, vec)), 6)) AS vec FROM em")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.unit_vectors(emb(spark, sf_dir)).select("token", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("WITH s AS (SELECT vec_id::VARCHAR AS token, label::DOUBLE AS score FROM embeddings WHERE label < 5), w AS (SELECT vec_id AS pos, vec_id::VARCHAR AS token FROM embeddings) SELECT w.pos, w.token, s.score FROM w LEFT JOIN s USING (token)")
def aligned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    known = e.where(F.col("label") < 5).select("token", F.col("label").cast("double").alias("score"))
    return vectors.aligned_scores(e.select(F.col("token").cast("long").alias("pos"), "token"), known)


@query("""WITH d AS (SELECT n_chars AS s, (lang = 'en')::INT AS y FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM d)
SELECT round((sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 9) AS auc FROM r""")
def auc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("lang").isNotNull())
    return evaluate.auc(d.select(F.col("n_chars").alias("score"), (F.col("lang") == "en").cast("int").alias("label"))).withColumn("auc", F.round("auc", 9))


_GROUP = "[(\\[]([^()\\[\\]]*)[)\\]]([0-9.]*)"
_AMOUNTS = f"""pt AS (SELECT chemical_id, unnest(regexp_extract_all(regexp_replace(name, '{_GROUP}', '', 'g'), '[A-Z][a-z]?[0-9.]*')) AS x, 1.0::DOUBLE AS k FROM chemical WHERE name IS NOT NULL
UNION ALL SELECT chemical_id, unnest(regexp_extract_all(g, '[A-Z][a-z]?[0-9.]*')), coalesce(try_cast(m AS DOUBLE), 1) FROM (SELECT chemical_id, unnest(regexp_extract_all(name, '{_GROUP}', 1)) AS g, unnest(regexp_extract_all(name, '{_GROUP}', 2)) AS m FROM chemical WHERE name IS NOT NULL)),
am AS (SELECT chemical_id, regexp_extract(x, '^[A-Z][a-z]?') AS element, round(sum(coalesce(try_cast(regexp_extract(x, '[0-9.]+$') AS DOUBLE), 1) * k), 9) AS amount FROM pt GROUP BY 1, 2)"""


@query(f"WITH {_AMOUNTS} SELECT * FROM am")
def formula_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount of every element of a name, brackets multiplied."""
    m = table(spark, sf_dir, "chemical").where(F.col("name").isNotNull()).select("chemical_id", F.explode(text.composition(F.col("name"))).alias("element", "amount"))
    return m.withColumn("amount", F.round("amount", 9))


_ELEMENTS = ["Al", "Bi", "Ca", "Cu", "Fe", "Ga", "In", "La", "Li", "Mn", "Nb", "O", "P", "S", "Sb", "Se", "Si", "Sn", "Sr", "Te", "Ti", "Y", "Yb", "Zn", "Zr"]


@query()
def composition_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.composition_vectors(table(spark, sf_dir, "chemical").select(F.col("chemical_id").alias("v"), "name"), _ELEMENTS)


# models


def _document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, vec, out_vec, n) of the tokens of titles and abstracts from spectral PPMI."""
    tokens = document_tokens(spark, sf_dir)
    ppmi = materialise(textstats.sppmi(materialise(textstats.skipgrams(tokens, WINDOW), "grams"), 1.0), "ppmi")
    return materialise(training.spectral(ppmi, 8, 4).join(textstats.unigrams(tokens), "token"), "document-vectors")


@query()
def spectral_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_vectors(spark, sf_dir)


@query(f"""WITH {TOK}, u AS (SELECT token, count(*) AS n FROM tok GROUP BY token), b AS (SELECT a.token AS first, b.token AS second, count(*) AS n FROM tok a JOIN tok b ON a.doc = b.doc AND b.pos = a.pos + 1 GROUP BY 1, 2)
SELECT * FROM (SELECT b.first, b.second, b.n, round((b.n - 5) * (SELECT count(*) FROM u)::DOUBLE / (x.n::DOUBLE * y.n), 9) AS score FROM b JOIN u x ON x.token = b.first JOIN u y ON y.token = b.second WHERE b.n >= 5) WHERE score > 10""")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.phrases(title_tokens(spark, sf_dir)).withColumn("score", F.round("score", 9)).where(F.col("score") > 10)


@query(ORACLE["phrases"].replace(TOK, _DOCUMENT_TOK))
def phrases_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.phrases(document_tokens(spark, sf_dir)).withColumn("score", F.round("score", 9)).where(F.col("score") > 10)


@query()
def word2vec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors trained on every sentence of titles and abstracts."""
    return training.word2vec(document_sentences(spark, sf_dir), "words", 16)


@query()
def word2vec_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "paper").where(F.col("title").isNotNull()).select(F.split(F.lower("title"), r"\s+").alias("words"))
    return training.word2vec(t, "words", 16)


@query()
def sentence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = document_sentences(spark, sf_dir).select("doc", "sent", F.explode("words").alias("token"))
    return vectors.sentence_vectors(tokens, _document_vectors(spark, sf_dir))


@query()
def author_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    own = sentence_vectors(spark, sf_dir).withColumnRenamed("doc", "paper_id").join(c.paper_author, "paper_id").where(F.col("author_id").isNotNull())
    return vectors.author_vectors(own.select(F.col("author_id").alias("author"), "vec"), 8)


@query()
def author_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    own = document_tokens(spark, sf_dir).withColumnRenamed("doc", "paper_id").join(c.paper_author.where(F.col("author_id").isNotNull()).distinct(), "paper_id").join(c.paper.select("paper_id", "year"), "paper_id")
    return vectors.author_similarity(own.select(F.col("author_id").alias("author"), F.col("paper_id").alias("paper"), "year", "token"), PROPERTY.split(), _document_vectors(spark, sf_dir))


@query()
def predict_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by the vectors of their names in titles and abstracts."""
    names = catalog(spark, sf_dir).entity.where(F.col("name").isNotNull()).select(F.col("entity_id").alias("v"), F.lower("name").alias("token")).dropDuplicates(["token"])
    return embedding_predictor(graph(spark, sf_dir), _document_vectors(spark, sf_dir), names, "polarization")(2012, scores=True)


@query()
def predict_author_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = author_vectors(spark, sf_dir).select(F.concat(F.lit("a_"), F.col("author").cast("string")).alias("token"), "vec")
    kw = _document_vectors(spark, sf_dir).where(F.col("token") == "polarization").select("token", "vec")
    return author_embedding_predictor(e.unionByName(kw), "polarization")(scores=True)


def _walks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Papers as walks: (walk, pos, token) of the entities of a paper in id order after the keyword where it applies; studied tokens."""
    from pyspark.sql import Window

    from litweave.operators.truth import first_years

    g = graph(spark, sf_dir)
    own = g.inc.where(F.col("t") != "author").select(F.col("e").alias("walk"), F.when(F.col("t") == "keyword", "kw").otherwise(F.col("v").cast("string")).alias("token"), F.when(F.col("t") == "keyword", -1).otherwise(F.col("v")).alias("o"))
    tokens = own.withColumn("pos", F.row_number().over(Window.partitionBy("walk").orderBy("o")) - 1).select("walk", "pos", "token")
    return materialise(tokens, "paper-walks"), materialise(first_years(g).select(F.col("v").cast("string").alias("token"), "year"), "first-years")


_PW = f"""{BASE}, pw AS (SELECT e AS walk, token, row_number() OVER (PARTITION BY e ORDER BY o) - 1 AS pos FROM (SELECT e, CASE WHEN t = 'keyword' THEN 'kw' ELSE v::VARCHAR END AS token, CASE WHEN t = 'keyword' THEN -1 ELSE v END AS o FROM inc WHERE t <> 'author')),
un AS (SELECT * FROM pw WHERE token NOT IN (SELECT v::VARCHAR FROM fy WHERE year < 2012) AND token <> 'kw')"""


def _walk_prediction(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    tokens, first = _walks(spark, sf_dir)
    return walk_predictor(tokens, "kw", lambda y: first.where(F.col("year") < y).select("token"), how)(2012, scores=True)


@query(f"{_PW} SELECT token, count(*)::DOUBLE AS score FROM un GROUP BY token ORDER BY 2 DESC, token LIMIT 50")
def predict_walk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_prediction(spark, sf_dir, "count")


@query(f"{_PW}, h AS (SELECT u.walk, u.token, min(u.pos - k.pos) AS d FROM un u JOIN pw k ON k.walk = u.walk AND k.token = 'kw' AND k.pos < u.pos GROUP BY 1, 2) SELECT token, round(avg(d), 9) AS score FROM h GROUP BY token ORDER BY 2, token LIMIT 50")
def predict_first_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_prediction(spark, sf_dir, "passage")


@query(f"""{_PW}, gr AS (SELECT a.token AS center, b.token AS context, count(*) AS n FROM pw a JOIN pw b ON a.walk = b.walk AND b.pos BETWEEN a.pos - 4 AND a.pos + 4 AND b.pos <> a.pos GROUP BY 1, 2),
q AS (SELECT context, n AS q FROM gr WHERE center = 'kw'), nm AS (SELECT center, sqrt(sum(n * n)) AS norm FROM gr GROUP BY center)
SELECT g.center AS token, round(sum(g.n * q.q) / (any_value(nm.norm) * (SELECT sqrt(sum(q * q)) FROM q)), 9) AS score FROM gr g JOIN q USING (context) JOIN nm ON nm.center = g.center
WHERE g.center IN (SELECT token FROM un) GROUP BY g.center ORDER BY 2 DESC, 1 LIMIT 50""")
def predict_walk_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_prediction(spark, sf_dir, "similar")


@query()
def predict_walk_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_prediction(spark, sf_dir, "random")


@query()
def neighbor_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litweave.operators.incidence import projection

    p = projection(recent(spark, sf_dir).inc.where(F.col("t") == "entity")).select(F.col("v1").alias("src"), F.col("v2").alias("dst")).where(F.col("src") != F.col("dst"))
    return training.sample_neighbors(p, 10)


@query()
def graph_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers over the entity graph, fitted on neighbours."""
    inc = recent(spark, sf_dir).inc.where(F.col("t") == "entity")
    from litweave.operators.incidence import projection

    edges = materialise(projection(inc).select(F.col("v1").alias("src"), F.col("v2").alias("dst")).where(F.col("src") != F.col("dst")), "entity-edges")
    nodes = inc.select("v").distinct()
    from litweave.operators.walks import uniform

    features = materialise(nodes.select("v", F.array(*[uniform(7, F.col("v"), i) - 0.5 for i in range(8)]).alias("vec")), "entity-features")
    return training.graph_inference(features, edges, training.train_sage(features, edges, edges, (8, 8), sample=500))


@query("SELECT paper_id, n, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rank FROM (SELECT paper_id, count(*) AS n FROM paper_author_mapping WHERE paper_id IS NOT NULL GROUP BY paper_id)")
def author_rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of the papers' numbers of authors."""
    c = catalog(spark, sf_dir)
    n = c.paper_author.where(F.col("paper_id").isNotNull()).groupBy("paper_id").agg(F.count("*").alias("n"))
    return with_rank(materialise(n, "author-numbers"), "n", "rank")


@query(f"{_PW}, sm AS (SELECT chemical_id::VARCHAR AS token, round(ln(1 + length(name)), 9) AS sim FROM chemical WHERE name IS NOT NULL) SELECT DISTINCT token, sim AS score FROM un JOIN sm USING (token) ORDER BY sim DESC, token LIMIT 50")
def predict_given_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk tokens ranked by similarities computed elsewhere (here the length of the name)."""
    tokens, first = _walks(spark, sf_dir)
    sims = catalog(spark, sf_dir).entity.where(F.col("name").isNotNull()).select(F.col("entity_id").cast("string").alias("token"), F.round(F.log1p(F.length("name").cast("double")), 9).alias("sim"))
    return walk_predictor(tokens, "kw", lambda y: first.where(F.col("year") < y).select("token"), "given", sims)(2012, scores=True)


@query("SELECT p.paper_id AS pos, p.title AS value, f.at FROM paper p LEFT JOIN (SELECT title, min(paper_id) AS at FROM paper WHERE year(date) < 2012 GROUP BY title) f ON f.title = p.title")
def located_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each title stands among the older ones."""
    papers = catalog(spark, sf_dir).paper.select(F.col("paper_id").alias("pos"), F.col("title").alias("value"), "year")
    return vectors.locate(papers.select("pos", "value"), papers.where(F.col("year") < 2012))


@query()
def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.mini_batches(recent(spark, sf_dir).inc, 500)
