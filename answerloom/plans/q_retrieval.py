"""Registered queries: tokens, dictionary, lexical and vector retrieval."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tok
from ..functions.scale import spread
from ..functions.text import fold
from ..operators import dictionary as dic
from ..operators import lexical as lx
from ..operators import vectors as vec
from .registry import query, table

FOLD = "replace(lower({0}), 'ß', 'ss')"
WORDS = "regexp_extract_all(" + FOLD + ", '[a-z0-9_]+')"


def corpus(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")
    return spread(docs, "chunk_id")


def questions(spark, d):
    """The words of every benchmark item as a query."""
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.array_join(tok.word_tokenizer(F.col("text")), " ").alias("query"))


def joined(c):
    return F.array_join(c, " ")


@query("tokenize_bigram", f"SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS tokens FROM documents")
def q_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(tok.bigram_tokenizer()(F.col("text"))).alias("tokens"))


@query("tokenize_unigram", "SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9_]+|[\\x{4e00}-\\x{9fff}]')) AS n, array_to_string(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]+|[\\x{4e00}-\\x{9fff}]'), lambda s: lower(s)), ' ') AS tokens FROM documents")
def q_tokenize_unigram(spark, d):
    t = tok.tokenize_unigram(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), joined(t).alias("tokens"))


CJK = "translate(text, 'aeiou', '会员退款费')"


@query("semantic_tokens", rf"""WITH t AS (SELECT doc_id, replace(lower(translate(text, 'aeiou', '会员退款费')), 'ß', 'ss') AS s FROM documents),
 c AS (SELECT doc_id, s, regexp_replace(s, '[^\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS j FROM t)
SELECT doc_id, len(list_distinct(list_concat(list_transform(range(1, greatest(length(j), 1)), lambda i: substr(j, i, 2)), regexp_extract_all(s, '[a-z0-9]+')))) AS n,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(range(1, greatest(length(j), 1)), lambda i: substr(j, i, 2)), regexp_extract_all(s, '[a-z0-9]+')))), ' ') AS tokens FROM c""")
def q_semantic_tokens(spark, d):
    t = tok.semantic_tokens(F.translate("text", "aeiou", "会员退款费"))
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.size(t).cast("long").alias("n"), joined(F.array_sort(t)).alias("tokens"))


# --- dictionary: part names as terms, brands as domains ---------------------------------------------------------------

TERMS = """terms AS (SELECT p_partkey AS term_id, p_name AS term, p_brand AS domain, [upper(p_type), p_name || ' ' || p_type] AS aliases, p_size AS frequency,
  CASE WHEN p_partkey % 5 = 0 THEN 'candidate' ELSE 'approved' END AS status FROM part)"""


def terms(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"), F.col("p_brand").alias("domain"),
        F.array(F.upper("p_type"), F.concat_ws(" ", "p_name", "p_type")).alias("aliases"), F.col("p_size").alias("frequency"),
        F.when(F.col("p_partkey") % 5 == 0, "candidate").otherwise("approved").alias("status"), F.lit("product").alias("term_type"))


@query("seed_terms", f"""WITH {TERMS}, e AS (SELECT DISTINCT domain, lower(term) AS n FROM terms WHERE term_id % 3 = 0)
SELECT term_id, domain, lower(trim(' ' || upper(term))) AS normalized_term FROM terms t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.domain = t.domain AND e.n = lower(t.term))""")
def q_seed_terms(spark, d):
    t = terms(spark, d)
    stored = t.where("term_id % 3 = 0").select("domain", fold("term").alias("normalized_term"))
    feed = t.withColumn("term", F.concat(F.lit(" "), F.upper("term")))
    return dic.seed_terms(stored, feed).select("term_id", "domain", "normalized_term")


@query("seed_conflicts", f"WITH {TERMS} SELECT domain, lower(term) AS normalized_term, count(*) AS n FROM terms GROUP BY ALL HAVING count(*) > 1")
def q_seed_conflicts(spark, d):
    return dic.seed_conflicts(terms(spark, d))


@query("normalize_terms", f"""WITH {TERMS}, f AS (SELECT term_id, CASE WHEN term_id % 7 = 0 THEN '  ' WHEN term_id % 7 = 1 THEN term || chr(10) || 'x' WHEN term_id % 7 = 2 THEN repeat(term, 20) ELSE ' ' || upper(term) END AS raw, term, aliases FROM terms)
SELECT term_id, lower(trim(raw)) AS normalized_term, CASE WHEN term_id % 7 = 3 THEN lower(aliases[1]) || '|' || lower(aliases[2]) ELSE lower(aliases[1]) || '|' || lower(aliases[2]) END AS aliases,
 CASE WHEN term_id % 7 = 0 THEN 'blank_term' WHEN term_id % 7 = 1 THEN 'multi_line_term' WHEN length(trim(raw)) > 100 THEN 'term_too_long' ELSE '' END AS error_code FROM f""")
def q_normalize_terms(spark, d):
    m = F.col("term_id") % 7
    raw = (F.when(m == 0, "  ").when(m == 1, F.concat("term", F.lit("\nx"))).when(m == 2, F.repeat("term", F.lit(20)))
           .otherwise(F.concat(F.lit(" "), F.upper("term"))))
    noisy = F.concat(F.col("aliases"), F.array(F.concat(F.lit(" "), F.col("aliases")[0]), F.upper(F.trim("term")), F.lit("  ")))
    feed = terms(spark, d).withColumn("aliases", F.when(m > 2, noisy).otherwise(F.col("aliases"))).withColumn("term", raw)
    out = dic.normalize_terms(feed)
    return out.select("term_id", "normalized_term", F.array_join("aliases", "|").alias("aliases"),
                      F.coalesce("error_code", F.lit("")).alias("error_code"))


RENDER = f"""{TERMS}, w AS (SELECT lower(trim(unnest(list_concat([term], aliases)))) AS word, frequency FROM terms WHERE status = 'approved'),
r AS (SELECT word, max(frequency) AS frequency FROM w GROUP BY word)"""


@query("render_dictionary", f"WITH {RENDER} SELECT word, frequency, word || ' ' || frequency || ' nz' AS line FROM r")
def q_render(spark, d):
    return dic.render_dictionary(terms(spark, d))


@query("publish_dictionary", f"""WITH {RENDER}, a AS (SELECT string_agg(word || ' ' || frequency || ' nz' || chr(10), '' ORDER BY word) AS artifact, count(*) AS term_count FROM r)
SELECT 26 AS version_number, sha256(artifact) AS artifact_hash, FALSE AS reused, term_count, 25 AS supersedes FROM a""")
def q_publish(spark, d):
    versions = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("version_number"), F.sha2(F.col("n_name"), 256).alias("artifact_hash"))
    return dic.publish_dictionary(terms(spark, d), versions).select("version_number", "artifact_hash", "reused", "term_count", "supersedes")


ENTRIES = f"""ent AS (SELECT ['user','assistant','system'][item_id % 3 + 1] AS domain, CAST(item_id AS BIGINT) AS position, {WORDS.format('text')}[2] AS term, {WORDS.format('text')}[5] AS alias FROM benchmark)"""


def entries(spark, d):
    words = tok.word_tokenizer(F.col("text"))
    roles = F.array(*[F.lit(r) for r in ("user", "assistant", "system")])
    return table(spark, d, "benchmark").select(
        F.element_at(roles, (F.col("item_id") % 3 + 1).cast("int")).alias("domain"), F.col("item_id").alias("position"),
        F.get(words, F.lit(1)).alias("term"), F.array(F.get(words, F.lit(4))).alias("aliases"))


def turns(spark, d):
    return table(spark, d, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"),
        F.col("role").alias("domain"), "text")


@query("match_terms", f"""WITH {ENTRIES}, m AS (SELECT conv_id || ':' || turn AS text_id, term, min(position) AS p FROM conversations JOIN ent ON role = domain
   AND (contains({FOLD.format('text')}, term) OR contains({FOLD.format('text')}, alias)) GROUP BY ALL)
SELECT conv_id || ':' || turn AS text_id, coalesce((SELECT string_agg(term, '|' ORDER BY p) FROM m WHERE m.text_id = conv_id || ':' || turn), '') AS terms FROM conversations""")
def q_match_terms(spark, d):
    return dic.match_terms(turns(spark, d), entries(spark, d)).select("text_id", F.array_join("domain_terms", "|").alias("terms"))


@query("scan_aliases", f"""WITH RECURSIVE {ENTRIES}, al AS (SELECT DISTINCT domain, term AS canonical, unnest([term, alias]) AS surface FROM ent),
 tx AS (SELECT conv_id || ':' || turn AS text_id, role, {FOLD.format('text')} AS s FROM conversations),
 oc AS (SELECT text_id, canonical, i AS start, i + length(surface) AS stop FROM tx JOIN al ON role = domain AND contains(s, surface), range(1, length(s) + 1) r(i)
   WHERE substr(s, i, length(surface)) = surface),
 rk AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY start - stop, start, canonical) AS rn FROM oc),
 ls AS (SELECT text_id, list({{'start': start, 'stop': stop, 'canonical': canonical}} ORDER BY rn) AS l FROM rk GROUP BY text_id),
 pick AS (SELECT text_id, l, 1 AS i, []::STRUCT(start BIGINT, stop BIGINT, canonical VARCHAR)[] AS got FROM ls
   UNION ALL SELECT text_id, l, i + 1, CASE WHEN len(list_filter(got, lambda u: l[i].start < u.stop AND l[i].stop > u.start)) > 0 THEN got ELSE list_append(got, l[i]) END FROM pick WHERE i <= len(l))
SELECT tx.text_id, coalesce(array_to_string(list_transform(list_sort(got), lambda g: g.canonical), '|'), '') AS names FROM tx LEFT JOIN (SELECT * FROM pick WHERE i = len(l) + 1) p ON p.text_id = tx.text_id""")
def q_scan_aliases(spark, d):
    al = entries(spark, d).select("domain", F.col("term").alias("canonical"), F.explode(F.concat(F.array("term"), "aliases")).alias("surface")).distinct()
    return dic.scan_aliases(turns(spark, d), al).select("text_id", F.array_join("names", "|").alias("names"))


@query("dictionary_filter", f"WITH {TERMS} SELECT term_id, domain, lower(term) AS normalized_term FROM terms WHERE status = 'approved' AND domain = 'Brand#3'")
def q_dictionary_filter(spark, d):
    t = terms(spark, d).withColumn("normalized_term", fold("term"))
    return dic.list_terms(t, domain="Brand#3", status="approved").select("term_id", "domain", "normalized_term")


# --- lexical ----------------------------------------------------------------------------------------------------------

BM25 = f"""dt AS (SELECT doc_id AS chunk_id, lang, {WORDS.format('text')} AS toks FROM documents),
dl AS (SELECT chunk_id, lang, len(toks) AS length FROM dt),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark)"""
GAIN = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))"


@query("bm25_index", f"""WITH {BM25}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT t.chunk_id, t.term, t.tf, CAST(l.length AS BIGINT) AS length, f.df FROM tf t JOIN dl l USING (chunk_id) JOIN df f USING (term)""")
def q_bm25_index(spark, d):
    found = lx.counted_postings(corpus(spark, d).select("chunk_id", "text"))
    return found.select("chunk_id", "term", "tf", F.col("length").cast("long").alias("length"), "df")


@query("bm25_search", f"""WITH {BM25}, st AS (SELECT count(*) AS n, avg(length) AS avg_length FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sc AS (SELECT query_id, chunk_id, round(sum({GAIN}), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM rk WHERE rank <= 5""")
def q_bm25_search(spark, d):
    return _ranked(lx.bm25_search(corpus(spark, d), questions(spark, d), 5))


def _ranked(hits):
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


LANGS = ("en", "fr", "es", "de")


# Overlapping sets: a language, the languages of two, every other document, and all documents.
SETS = """ts AS (SELECT 0 AS s, doc_id AS v FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id FROM documents WHERE lang IN ('en', 'fr')
 UNION ALL SELECT 2, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 3, doc_id FROM documents)"""


@query("bm25_filtered", f"""WITH {BM25}, {SETS}, st AS (SELECT s, count(*) AS n, avg(length) AS avg_length FROM ts JOIN dl ON v = chunk_id GROUP BY s),
 df AS (SELECT s, term, count(*) AS df FROM tf JOIN ts ON v = chunk_id GROUP BY ALL), qs AS (SELECT *, query_id % 4 AS s FROM qt),
 sc AS (SELECT query_id, chunk_id, round(sum({GAIN}), 9) AS score FROM qs JOIN ts USING (s) JOIN dl ON chunk_id = v JOIN tf USING (chunk_id, term) JOIN df USING (s, term) JOIN st USING (s) GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM rk WHERE rank <= 5""")
def q_bm25_filtered(spark, d):
    asks = questions(spark, d).withColumn("target_set", F.col("query_id") % 4)
    chunks = corpus(spark, d).withColumn("version_id", F.col("chunk_id"))
    given = F.array_compact(F.array(F.when(F.col("lang") == "en", 0), F.when(F.col("lang").isin("en", "fr"), 1), F.when(F.col("version_id") % 2 == 0, 2), F.lit(3)))
    targets = chunks.select(F.explode(given.cast("array<long>")).alias("target_set"), "version_id")
    return _ranked(lx.bm25_search(chunks, asks, 5, targets=targets))


@query("fielded_search", rf"""WITH base AS (SELECT doc_id AS chunk_id, lang, source, string_split(text, chr(10))[1] AS title, text, len(text) % 11 <> 0 AS active, CASE WHEN doc_id % 3 = 0 THEN ['public'] ELSE ['staff', 'public'] END AS scope, source AS dterm FROM documents),
 live AS (SELECT * FROM base WHERE active),
 q AS (SELECT item_id AS query_id, array_to_string({WORDS.format('text')}, ' ') AS query, ['en','fr','es','de'][item_id % 4 + 1] AS lang, CASE WHEN item_id % 2 = 0 THEN ['public'] ELSE ['staff'] END AS allowed, 'src' || (item_id % 20) AS dterm FROM benchmark),
 qt AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS term FROM q),
 tt AS (SELECT chunk_id, 'title' AS f, {WORDS.format('title')} AS toks FROM live UNION ALL SELECT chunk_id, 'content', {WORDS.format('text')} FROM live),
 dl AS (SELECT chunk_id, f, len(toks) AS length FROM tt), st AS (SELECT f, count(*) AS n, avg(length) AS avg_length FROM dl GROUP BY f),
 tf AS (SELECT chunk_id, f, term, count(*) AS tf FROM (SELECT chunk_id, f, unnest(toks) AS term FROM tt) GROUP BY ALL),
 df AS (SELECT f, term, count(*) AS df FROM tf GROUP BY ALL),
 sc AS (SELECT query_id, chunk_id, f, round(sum({GAIN}), 9) AS s FROM qt JOIN tf USING (term) JOIN df USING (f, term) JOIN dl USING (chunk_id, f) JOIN st USING (f) GROUP BY ALL),
 al AS (SELECT q.query_id, l.chunk_id, coalesce(a.s, 0) AS t, coalesce(b.s, 0) AS c, CASE WHEN q.dterm = l.dterm THEN 6.0 ELSE 0 END AS d,
   CASE WHEN contains(' ' || array_to_string({WORDS.format('title')}, ' ') || ' ', ' ' || query || ' ') THEN 4.0 ELSE 0 END AS tp,
   CASE WHEN contains(' ' || array_to_string({WORDS.format('text')}, ' ') || ' ', ' ' || query || ' ') THEN 2.0 ELSE 0 END AS cp
   FROM q JOIN live l ON q.lang = l.lang AND list_has_any(scope, allowed)
   LEFT JOIN (SELECT * FROM sc WHERE f = 'title') a ON a.query_id = q.query_id AND a.chunk_id = l.chunk_id
   LEFT JOIN (SELECT * FROM sc WHERE f = 'content') b ON b.query_id = q.query_id AND b.chunk_id = l.chunk_id),
 sm AS (SELECT query_id, chunk_id, round(greatest(t * 2.5, c) + d + tp + cp, 9) AS score FROM al),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sm WHERE score > 0)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM rk WHERE rank <= 10""")
def q_fielded(spark, d):
    key = F.col("chunk_id")
    index = corpus(spark, d).select(
        "chunk_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("content"), F.lit("o").alias("owner"),
        F.col("lang").alias("domain"), (F.length("text") % 11 != 0).alias("active"),
        F.when(key % 3 == 0, F.array(F.lit("public"))).otherwise(F.array(F.lit("staff"), F.lit("public"))).alias("access_scope"),
        F.array("source").alias("domain_terms"))
    langs = F.array(*[F.lit(x) for x in LANGS])
    item = F.col("query_id")
    asks = questions(spark, d).select(
        "query_id", "query", F.lit("o").alias("owner"), F.element_at(langs, (item % 4 + 1).cast("int")).alias("domain"),
        F.when(item % 2 == 0, F.array(F.lit("public"))).otherwise(F.array(F.lit("staff"))).alias("allowed_scopes"),
        F.array(F.concat(F.lit("src"), (item % 20).cast("string"))).alias("domain_terms"))
    return _ranked(lx.fielded_search(index, asks, 10))


@query("lexical_snapshot", """WITH a AS (SELECT c_mktsegment AS owner, 'ix' || o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000)
SELECT owner, sha256('lexical-v1|' || string_agg(id, '|' ORDER BY id) || '|dict-hash') AS generation FROM a GROUP BY owner""")
def q_lexical_snapshot(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 100000").join(
        table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    ids = orders.select(F.col("c_mktsegment").alias("owner"), F.concat(F.lit("ix"), F.col("o_orderkey").cast("string")).alias("index_version_id"))
    return lx.generation_key(ids, "dict-hash")


# --- vectors ----------------------------------------------------------------------------------------------------------

DIM = 32


@query("hash_embed", f"""WITH x AS (SELECT item_id AS chunk_id, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 100 + turn, text FROM conversations),
 t AS (SELECT chunk_id, text, list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]+'), lambda s: lower(s)) AS toks FROM x),
 f AS (SELECT chunk_id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || toks[i + 1]))) AS feat FROM t),
 h AS (SELECT chunk_id, sha256(feat) AS s FROM f),
 c AS (SELECT chunk_id, CAST(('0x' || substr(s, 1, 16))::UBIGINT % {DIM} AS INT) AS bucket, sum(CASE WHEN ('0x' || substr(s, 18, 1))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM h GROUP BY ALL)
SELECT chunk_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)), 6) AS value FROM c WHERE v <> 0""")
def q_hash_embed(spark, d):
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), "text").unionByName(
        table(spark, d, "conversations").select((1000000 + F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), "text"))
    out = vec.hash_embed(texts, "text", DIM)
    return out.select("chunk_id", F.posexplode("vector").alias("bucket", "value")).where("value <> 0").select(
        "chunk_id", "bucket", F.round("value", 6).alias("value"))


@query("check_vectors", """SELECT CAST(vec_id AS VARCHAR) AS key, CASE WHEN vec_id % 4 = 0 THEN 'dimension' ELSE 'not_finite' END AS problem FROM embeddings WHERE vec_id % 4 = 0 OR vec_id % 4 = 1
UNION ALL SELECT CAST(vec_id + 1000000 AS VARCHAR), 'vector_count' FROM embeddings WHERE vec_id % 10 = 0""")
def q_check_vectors(spark, d):
    key = F.col("vec_id")
    base = table(spark, d, "embeddings").select("vec_id", "embedding")
    spoiled = base.withColumn("embedding", F.when(key % 4 == 0, F.slice("embedding", 1, 10)).when(
        key % 4 == 1, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(F.col("embedding")))
    texts = base.select("vec_id").unionByName(base.where("vec_id % 10 = 0").select((key + 1000000).alias("vec_id")))
    return vec.check_vectors(spoiled, 64, texts=texts)


@query("cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def vector_tables(spark, d):
    base = table(spark, d, "embeddings").withColumnRenamed("label", "domain")
    key = F.col("vec_id")
    stored = base.withColumn("access_scope", F.when(key % 3 == 0, F.array(F.lit("staff"))).otherwise(F.array(F.lit("public"), F.lit("vip"))))
    first = base.where("vec_id % 20 = 0").select(key.alias("query_id"), F.col("embedding").alias("vector"), "domain",
        F.when(key % 2 == 0, F.array(F.lit("public"))).otherwise(F.array(F.lit("staff"), F.lit("vip"))).alias("allowed_scopes"))
    return stored, first


@query("vector_search", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 3 = 0 THEN ['staff'] ELSE ['public','vip'] END AS scope FROM embeddings),
 q AS (SELECT vec_id AS query_id, label, e, CASE WHEN vec_id % 2 = 0 THEN ['public'] ELSE ['staff','vip'] END AS allowed FROM v WHERE vec_id % 20 = 0),
 s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM q JOIN v ON q.label = v.label AND list_has_any(scope, allowed)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def q_vector_search(spark, d):
    stored, first = vector_tables(spark, d)
    return _ranked(vec.vector_search(stored, first, 10))


@query("vector_search_lsh", """WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN ['staff'] ELSE ['public','vip'] END AS scope FROM embeddings),
 q AS (SELECT vec_id AS query_id, label, CASE WHEN vec_id % 2 = 0 THEN ['public'] ELSE ['staff','vip'] END AS allowed FROM v WHERE vec_id % 20 = 0)
SELECT query_id, least(10, count(*)) AS hits, TRUE AS exact_scores, TRUE AS recall_reached FROM q JOIN v ON q.label = v.label AND list_has_any(scope, allowed) GROUP BY query_id""")
def q_vector_lsh(spark, d):
    """Per query: hits (all of them allowed and as many as there can be), right scores, and recall of at least 0.9."""
    stored, first = vector_tables(spark, d)
    exact = vec.vector_search(stored, first, 10)
    near = vec.vector_search_lsh(stored, first, 10)
    pairs = near.join(first.select("query_id", "vector", "allowed_scopes", "domain"), "query_id").join(
        stored.select(F.col("vec_id").alias("chunk_id"), "embedding", "access_scope", F.col("domain").alias("own")), "chunk_id")
    right = (F.abs(vec.cosine(F.col("vector"), F.col("embedding")) - F.col("score")) < 1e-6) & (F.col("own") == F.col("domain")) & F.arrays_overlap("access_scope", "allowed_scopes")
    checked = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.bool_and(right).alias("exact_scores"))
    return checked.join(vec.recall_against(exact, near), "query_id").select("query_id", "hits", "exact_scores", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("build_vectors", f"""SELECT doc_id AS version_id, count(*) AS total, count(*) AS indexed, TRUE AS complete FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE doc_id % 3 <> 0)
 WHERE length(trim(l)) > 0 GROUP BY doc_id""")
def q_build_vectors(spark, d):
    from ..operators.blocks import text_blocks
    lines = text_blocks(corpus(spark, d).select(F.col("chunk_id").alias("version_id"), "text"), separator="\n")
    children = lines.select("version_id", F.concat_ws(":", F.col("version_id").cast("string"), F.col("ordinal").cast("string")).alias("chunk_id"), "content")
    plan = table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("version_id"), F.lit("k1").alias("build_key"))
    return vec.build_vectors(children, plan, DIM)[1].select("version_id", "total", "indexed", "complete")
