"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, embdedup, jaccard, licenses, linededup, mixing, pii, quality, tokencount


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_t(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, class probabilities and keep of every document."""
    docs = _t(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, _t(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_t(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_t(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_t(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the vocabulary in the folder that the setting siltlog.tokenizers names."""
    docs = _t(spark, sf_dir, "documents")
    return tokencount.edited_counts(docs, tokencount.house_edits(docs), spark.conf.get("siltlog.tokenizers", tokencount.TOKENIZERS))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document: its class of near copies and how many documents it is similar to."""
    return jaccard.jaccard_classes(_t(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_t(spark, sf_dir, "conversations"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.dedup_embeddings(_t(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op3_license_scan": OP3, "op4_source_mixing": OP4, "op7_decontamination": OP7, "op8_ngram_jaccard_join": OP8, "op10_embedding_dedup": OP10}


OP1 = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
nb AS (SELECT doc_id, list_filter(list_transform(range(1, len(ls) + 1), lambda i: {'p': i, 's': trim(ls[i])}), lambda v: v.s <> '') AS nl FROM d),
w AS (SELECT doc_id, i, nl[i].s || chr(10) || nl[i + 1].s || chr(10) || nl[i + 2].s AS w, [nl[i].p, nl[i + 1].p, nl[i + 2].p] AS ps
      FROM nb, unnest(range(1, len(nl) - 1)) AS u(i)),
r AS (SELECT doc_id, ps, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS rn FROM w),
c AS (SELECT DISTINCT doc_id, unnest(ps) AS p FROM r WHERE rn > 1),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n IS NULL THEN text ELSE
         array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ls[i]), chr(10)) END AS text,
       CAST(coalesce(n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN g USING (doc_id)
"""

_QUOTED = ", ".join("({}, '{}', '{}')".format(k, n.replace("'", "''"), t.replace("'", "''")) for k, (n, t) in enumerate(licenses.TEMPLATES))
_GRAMS = "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"

OP3 = f"""
WITH tw AS (SELECT k, license, {_WORDS.format("text")} AS ws FROM (VALUES {_QUOTED}) AS v(k, license, text)),
t AS (SELECT k, license, len(ws) - 1 AS width, len(list_distinct({_GRAMS})) AS n, unnest(list_distinct({_GRAMS})) AS g FROM tw),
dw AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
b AS (SELECT doc_id, len(ws) - 1 AS size, i - 1 AS p, ws[i] || ' ' || ws[i + 1] AS g FROM dw, unnest(range(1, len(ws))) AS u(i)),
h AS (SELECT doc_id, k, license, width, n, p, g, size FROM b JOIN t USING (g) WHERE size >= width),
c AS (SELECT doc_id, k, license, width, s, count(DISTINCT g) / n::DOUBLE AS containment
      FROM h, unnest(range(greatest(0, p - width + 1), least(p, size - width) + 1)) AS u(s) GROUP BY doc_id, k, license, width, n, s
      HAVING count(DISTINCT g) / n::DOUBLE >= {licenses.CONTAINMENT} - 1e-12),
i AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id, k ORDER BY s) < width + 1 THEN 0 ELSE 1 END AS new FROM c),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, k ORDER BY s) AS region FROM i),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k, region ORDER BY containment DESC, s) AS rn FROM r)
SELECT doc_id, license, CAST(s AS BIGINT) AS word_start, CAST(width + 1 AS BIGINT) AS n_words, containment FROM x WHERE rn = 1
"""

OP4 = f"""
WITH z AS (SELECT source, sum(length(text))::DOUBLE AS size FROM documents GROUP BY source),
w AS (SELECT source, size, pow(size, {mixing.TEMPERATURE}) AS w FROM z WHERE size > 0),
r AS (SELECT source, w / (SELECT sum(w) FROM w) * (SELECT sum(size) FROM w) / size AS rate FROM w),
p AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM r, unnest(range(0, CAST(floor(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS u(k)),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
h AS (SELECT doc_id, source, CAST('0x' || substring(md5('{mixing.SEED}|' || doc_id), 1, 13) AS BIGINT) / pow(2, 52) AS u FROM documents),
n AS (SELECT h.doc_id, count(*) AS n FROM h JOIN f ON h.source = f.source AND f.cdf <= h.u GROUP BY h.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c AS copy
FROM documents d JOIN n USING (doc_id), unnest(range(1, n.n + 1)) AS u(c)
"""

OP7 = f"""
WITH dw AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
bw AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
dg AS (SELECT doc_id, i - 1 AS i, array_to_string(ws[i:i + {decontam.MIN_WORDS - 1}], ' ') AS g FROM dw, unnest(range(1, len(ws) - {decontam.MIN_WORDS - 2})) AS u(i)),
bg AS (SELECT item_id, j - 1 AS j, array_to_string(ws[j:j + {decontam.MIN_WORDS - 1}], ' ') AS g FROM bw, unnest(range(1, len(ws) - {decontam.MIN_WORDS - 2})) AS u(j)),
h AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM dg JOIN bg USING (g))
SELECT doc_id, item_id, min(i) AS doc_start, min(j) AS item_start, count(*) + {decontam.MIN_WORDS - 1} AS n_words
FROM h GROUP BY doc_id, item_id, i - j, run
"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS gs FROM w WHERE len(ws) > 0),
f AS (SELECT gs, min(doc_id) AS s, len(gs) AS n, count(*) AS m FROM g GROUP BY gs),
t AS (SELECT s, n, unnest(gs) AS t FROM f),
o AS (SELECT a.s AS x, b.s AS y, a.n AS n1, b.n AS n2, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.s < b.s GROUP BY ALL),
h AS (SELECT x, y FROM o WHERE c / (n1 + n2 - c)::DOUBLE >= {jaccard.THRESHOLD} - 1e-12),
p AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
r(v, u) AS (SELECT s, s FROM f UNION SELECT r.v, p.y FROM r JOIN p ON r.u = p.x),
k AS (SELECT v AS s, min(u) AS class_id FROM r GROUP BY v),
l AS (SELECT p.x AS s, sum(f.m) AS links FROM p JOIN f ON p.y = f.s GROUP BY p.x)
SELECT g.doc_id, k.class_id, CAST(coalesce(l.links, 0) + f.m - 1 AS BIGINT) AS n_links FROM g JOIN f ON g.gs = f.gs JOIN k ON f.s = k.s LEFT JOIN l ON f.s = l.s
UNION ALL SELECT DISTINCT doc_id, doc_id, CAST(0 AS BIGINT) FROM w WHERE len(ws) = 0
"""

OP10 = f"""
WITH RECURSIVE p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding, b.embedding) >= {embdedup.THRESHOLD}),
r(v, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.v, p.y FROM r JOIN p ON r.m = p.x)
SELECT v AS vec_id, min(m) AS representative, min(m) = v AS kept FROM r GROUP BY v
"""
