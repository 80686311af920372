"""The flagship query: dense and lexical channels fused, cut to a character budget, with hashes of the evidence."""

from pyspark.sql import functions as F

from ..functions import digest, sha
from ..operators import integrity as I
from ..operators import rank as R
from .ranking import questions
from .registry import COS, Tables, query

K, BUDGET = 16, 6000


def ranked_evidence(t: Tables):
    """A question takes the vector of its own number as its embedding, and a document the vector of its id, if there is one.

    Vectors are checked first; documents without one have the lexical channel alone.
    """
    ok = I.validate_vectors(t.vectors(), 64, 1e-3).where("reason = 'ok'")
    vectors = t.vectors().join(ok, "id", "left_semi")
    asked = questions(t)
    dense = R.cosine_topk(asked.select("query_id").join(vectors.withColumnRenamed("id", "query_id"), "query_id"), vectors, K)
    lexical = R.rank_channel(R.lexical_hits(asked, t.docs(), k=K)).where(F.col("rank") <= K)
    fused = R.rrf_pair(dense, lexical)
    # of a text, no more than the budget is used, so no more is shuffled
    texts = fused.join(t.docs().withColumn("text", F.substring("text", 1, BUDGET)), "id")
    cut = R.prefix_budget(texts, BUDGET, K)
    out = cut.select("query_id", "id", "rank", "score", "chars", sha(F.col("text")).alias("text_sha"))
    return out.withColumn("receipt", digest("query_id", "id", "rank", "text_sha"))


query("ranked_evidence", f"""WITH questions AS (SELECT conv_id AS query_id, text AS question FROM conversations WHERE turn = 0 AND conv_id % 10 = 0), terms AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(question), '[\\p{{L}}0-9]+'), lambda x: length(x) >= 4)) AS terms FROM questions),
 de AS (SELECT q.query_id, v.vec_id AS id, {COS.format(a='a.embedding', b='v.embedding')} AS s FROM questions q JOIN embeddings a ON a.vec_id = q.query_id, embeddings v), dr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM de QUALIFY rank <= 16),
 le AS (SELECT query_id, doc_id AS id, len(list_filter(terms, lambda x: contains(lower(text), x))) / len(terms) AS s FROM documents, terms WHERE len(terms) > 0), lr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM le WHERE s > 0 QUALIFY rank <= 16),
 f AS (SELECT query_id, id, round(coalesce(0.4 / (60 + dr.rank), 0) + coalesce(0.6 / (60 + lr.rank), 0), 12) AS score FROM dr FULL JOIN lr USING (query_id, id)), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f),
 x AS (SELECT k.*, text FROM k JOIN documents ON doc_id = id), b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x WHERE rank <= 16),
 c AS (SELECT query_id, id, rank, score, CAST(least(length(text), 6000 - before) AS INTEGER) AS chars, sha256(substring(text, 1, CAST(6000 - before AS BIGINT))) AS text_sha FROM b WHERE before < 6000)
 SELECT *, sha256(query_id || '|' || id || '|' || rank || '|' || text_sha) AS receipt FROM c""")(ranked_evidence)
