"""Registered queries on documents, pages and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import docs as D
from strandline.operators import postings
from strandline.operators import state as S
from strandline.plans.common import Market, query, r, rounded, rr, sql
from strandline.sources.scratch import scratch_path

#: Frequent tokens of the invented prose; the operators take word lists as arguments.
POSITIVE = ["the", "of", "and", "der", "und"]
NEGATIVE = ["that", "for", "with", "die", "les"]
TERMS = ["the", "that", "ing"]
_TOK = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


@query("dedup_docs", sql("SELECT min(id) AS id, sha256(text) AS dedup_key FROM staging GROUP BY sha256(text)", "staging"))
def dedup_docs(m: Market):
    return D.new_documents(m.staging).select("id", "dedup_key")


@query("chunk_tokens", sql(f"""SELECT id, CASE WHEN total_chunks = 1 THEN id ELSE id || '-chunk-' || CAST(s // 160 AS VARCHAR) END AS chunk_id, CAST(s // 160 AS INT) AS chunk_index, total_chunks, CASE WHEN total_chunks = 1 THEN text ELSE array_to_string(list_slice(t, s + 1, s + 200), ' ') END AS chunk FROM
    (SELECT *, CAST(len(starts) AS INT) AS total_chunks, unnest(starts) AS s FROM (SELECT id, text, t, CASE WHEN len(t) <= 200 THEN [0] ELSE range(0, len(t), 160) END AS starts FROM (SELECT id, text, {_TOK} AS t FROM staging)))""", "staging"))
def chunk_tokens(m: Market):
    return D.chunk_tokens(m.staging, 200, 40)


@query("chunk_chars", sql("SELECT id, CAST(s // 900 AS INT) AS chunk_index, CAST(s AS INT) AS start, substr(text, s + 1, 1000) AS chunk FROM (SELECT id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, greatest(length(text) - 100, 1), 900) END) AS s FROM staging)", "staging"))
def chunk_chars(m: Market):
    return D.chunk_chars(m.staging, 1000, 100)


@query("chunk_markdown")
def chunk_markdown(m: Market):
    """Order-dependent fold without an SQL form; the tests compare it with a line-by-line fold."""
    return D.chunk_markdown(m.staging.select(F.col("id").alias("path"), "text"))


@query("token_counts", sql(f"SELECT id, len({_TOK}) AS tokens, array_to_string(list_slice({_TOK}, 1, 12), ' ') AS head FROM staging", "staging"))
def token_counts(m: Market):
    return m.staging.select("id", F.size(D.tokens(F.col("text"))).cast("long").alias("tokens"), D.truncate_tokens(F.col("text"), 12).alias("head"))


@query("stage_documents", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN trim(text) = '' THEN 'FAILED' ELSE 'PENDING' END AS embedding_status FROM documents")
def stage_documents(m: Market):
    return D.stage(m.table("documents").select(F.col("doc_id").cast("string").alias("id"), "text")).select("id", "embedding_status")


@query("pending_batch", sql("SELECT id, source FROM staging WHERE embedding_status = 'PENDING' ORDER BY id LIMIT 50", "staging"))
def pending_batch(m: Market):
    return D.pending_batch(m.staging, 50).select("id", "source")


@query("status_counts", sql("SELECT source, embedding_status, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT source FROM staging), (SELECT unnest(['PENDING', 'IN_PROGRESS', 'COMPLETED', 'FAILED']) AS embedding_status)) LEFT JOIN (SELECT source, embedding_status, count(*) AS n FROM staging GROUP BY 1, 2) USING (source, embedding_status)", "staging"))
def status_counts(m: Market):
    return S.status_counts(m.staging, ["PENDING", "IN_PROGRESS", "COMPLETED", "FAILED"])


@query("status_transition", sql("SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'COMPLETED' WHEN CAST(id AS BIGINT) % 4 = 1 THEN CASE WHEN CAST(id AS BIGINT) % 3 + 1 < 3 THEN 'PENDING' ELSE 'FAILED' END ELSE embedding_status END AS embedding_status, CAST(id AS BIGINT) % 3 + CASE WHEN CAST(id AS BIGINT) % 4 = 1 THEN 1 ELSE 0 END AS retry_count FROM staging", "staging"))
def status_transition(m: Market):
    n = F.col("id").cast("long")
    docs = m.staging.withColumns({"retry_count": n % 3, "error_message": F.lit(None).cast("string")})
    results = m.staging.filter(n % 4 < 2).select("id", (n % 4 == 0).alias("ok"), F.lit("timeout").alias("error"))
    return S.transition(docs, results).select("id", "embedding_status", "retry_count")


@query("source_runs", "SELECT o_orderpriority AS source, count(*) AS runs, CAST(sum(o_custkey % 100) AS BIGINT) AS processed, CAST(sum(o_custkey % 7) AS BIGINT) AS failed, max(CASE WHEN ok THEN o_orderdate END) AS last_success, count(*) FILTER (WHERE NOT ok AND (l IS NULL OR o_orderdate > l)) AS consecutive_failures FROM (SELECT *, max(CASE WHEN ok THEN o_orderdate END) OVER (PARTITION BY o_orderpriority) AS l FROM (SELECT *, o_orderkey % 50 = 0 AS ok FROM orders)) GROUP BY 1")
def source_runs(m: Market):
    o = m.table("orders")
    return S.source_runs(o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("timestamp").alias("run_at"), (F.col("o_custkey") % 100).alias("processed"), (F.col("o_custkey") % 7).alias("failed"), (F.col("o_orderkey") % 50 == 0).alias("ok")))


_CT = "CASE WHEN source LIKE '%9' THEN 'rss' WHEN source LIKE '%8' THEN 'wiki_pages' WHEN source LIKE '%7' THEN 'cve_database' WHEN source LIKE '%6' THEN 'legal_docs' WHEN source LIKE '%5' THEN 'code_repo' ELSE source END"


@query("content_type", sql(f"SELECT id, t AS content_type, t IN ('article', 'documentation', 'legal') AS human_friendly, t IN ('code', 'documentation', 'vulnerability') AS agent_friendly FROM (SELECT id, CASE WHEN c LIKE '%rss%' THEN 'article' WHEN c LIKE '%wiki%' THEN 'documentation' WHEN c LIKE '%cve%' THEN 'vulnerability' WHEN c LIKE '%legal%' OR c LIKE '%law%' THEN 'legal' WHEN c LIKE '%code%' THEN 'code' ELSE 'document' END AS t FROM (SELECT id, {_CT} AS c FROM staging))", "staging"))
def content_type(m: Market):
    d = m.staging.withColumn("content_type", D.content_type(F.expr(_CT), F.lit("")))
    can = D.capabilities(F.col("content_type"))
    return d.select("id", "content_type", can["human_friendly"].alias("human_friendly"), can["agent_friendly"].alias("agent_friendly"))


_LEX = r"regexp_extract_all(lower(text), '[a-zA-Z0-9_\-]+')"
_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query("lexicon_sentiment", sql(f"SELECT id, {rr('(p - n) / greatest(p + n, 1) AS sentiment_score', 'least(1.0, (p + n) / 10.0) AS confidence')}, CASE WHEN contains(lower(text), 'thea') THEN 'A' WHEN contains(lower(text), 'ein') THEN 'B' ELSE 'BTC' END AS symbol FROM (SELECT *, len(list_filter(t, lambda x: x IN {_in(POSITIVE)})) AS p, len(list_filter(t, lambda x: x IN {_in(NEGATIVE)})) AS n FROM (SELECT id, text, {_LEX} AS t FROM staging))", "staging"))
def lexicon_sentiment(m: Market):
    s = D.lexicon_sentiment(F.col("text"), POSITIVE, NEGATIVE)
    return rounded(m.staging.select("id", *[c.alias(n) for n, c in s.items()], D.first_alias(F.col("text"), {"thea": "A", "ein": "B"}, "BTC").alias("symbol")))


@query("pattern_sentiment", sql(f"SELECT id, {rr('(p - n) / greatest(p + n, 1) AS sentiment_score', 'least(1.0, (p + n) / 6.0) AS confidence')} FROM (SELECT id, len(regexp_extract_all(lower(text), 'the|und')) AS p, len(regexp_extract_all(lower(text), 'that|die')) AS n FROM staging)", "staging"))
def pattern_sentiment(m: Market):
    return rounded(m.staging.select("id", *[c.alias(n) for n, c in D.pattern_sentiment(F.col("text"), "the|und", "that|die").items()]))


_ABOUT = "regexp_matches(low, 'and|und')"


@query("symbol_extraction", sql(rf"""SELECT id, unnest(list_distinct(list_filter(list_filter(list_concat(regexp_extract_all(t, '\$([A-Z]{{2,10}})', 1), list_filter(regexp_split_to_array(left(t, 80), '\s+'), lambda x: regexp_full_match(x, '[A-Z]{{2,6}}'))), lambda x: x IN ('BTC', 'ETH'))
    || [CASE WHEN contains(low, 'thea') THEN 'ETH' END, CASE WHEN contains(low, 'ein') THEN 'BTC' END, CASE WHEN {_ABOUT} THEN 'CRYPTO_GLOBAL' END, CASE WHEN {_ABOUT} AND contains(low, 'the') THEN 'REGION_EN' END, CASE WHEN {_ABOUT} AND contains(low, 'der') THEN 'REGION_DE' END], lambda x: x IS NOT NULL))) AS symbol
    FROM (SELECT id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM staging)""", "staging"))
def symbol_extraction(m: Market):
    """At most five symbols can be found, so the first eight are all."""
    s = D.extract_symbols(F.substring("text", 1, 80), F.col("text"), ["BTC", "ETH"], {"thea": "ETH", "ein": "BTC"}, ["and", "und"], {"REGION_EN": ["the"], "REGION_DE": ["der"]})
    return m.staging.select("id", F.explode(s).alias("symbol"))


_PROSE = r"trim(regexp_replace(translate(coalesce(text, ''), '[]{}<>&=|''', ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("wikitext", f"SELECT doc_id, trim(regexp_replace('Head Over label and words link' || CASE WHEN t = '' THEN '' ELSE ' ' || t END || ' end', ' +', ' ', 'g')) AS cleaned FROM (SELECT doc_id, {_PROSE} AS t FROM documents)")
def wikitext(m: Market):
    """The whole given texts (less characters of markup of their own) inside real markup: nested templates, references, links, headings."""
    prose = F.translate(F.coalesce("text", F.lit("")), "[]{}<>&=|'", "")
    marked = F.concat(
        F.lit("{{Infobox|a={{small|x}}|b=[[y]]}}<!-- note -->\n== Head ==\n''Over'' [[Target page|label]]<ref name=\"r\">gone {{cite}}</ref> and [https://x.org words] '''[[link]]'''&nbsp;\n[[File:a.png|thumb|see [[y]] here]]\n"),
        prose, F.lit("\n{| class=x\n| cell\n|}<br/> end [[Category:C]]<ref name=r />"),
    )
    return m.table("documents").select("doc_id", D.clean_wikitext(marked).alias("cleaned"))


@query("page_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS title, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*)', 1), '(?is)</article>.*', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 10000) AS content FROM pages")
def page_text(m: Market):
    return m.table("pages").select("page_id", *[c.alias(n) for n, c in D.page_text(F.col("html"), F.col("url")).items()])


@query("snippets", sql("SELECT id, substr(text, 1, 200) AS snippet FROM staging", "staging"))
def snippets(m: Market):
    return m.staging.select("id", D.snippet(F.col("text")).alias("snippet"))


# ---- search ----------------------------------------------------------------------------------------

_QV = [((k * 7) % 13 - 6) / 6.0 for k in range(64)]
_VEC = f"SELECT id, collection, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), [{', '.join(repr(x) for x in _QV)}]::DOUBLE[]) AS score FROM vectors"


@query("vector_topk", sql(f"SELECT id, collection, {rr('score')}, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, id) AS k FROM v) WHERE k <= 20 ORDER BY score DESC, id LIMIT 20)", "vectors", extra={"v": _VEC}))
def vector_topk(m: Market):
    return rounded(D.vector_top_k(m.vectors, _QV, 20))


_BM = {
    "tk": r"SELECT id, collection, regexp_extract_all(lower(text), '[\p{L}0-9_]+') AS t FROM staging WHERE embedding_status = 'COMPLETED'",
    "tf": f"SELECT id, collection, len(t) AS l, {', '.join(f'''len(list_filter(t, lambda x: x = '{w}')) AS tf{i}''' for i, w in enumerate(TERMS))} FROM tk",
    "st": f"SELECT count(*) AS n, avg(l) AS al, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM tf",
    "bm": f"SELECT id, collection, {' + '.join(f'ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / al))' for i in range(len(TERMS)))} AS score FROM tf, st WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(TERMS)))}",
}


def _ranked(m: Market):
    path = scratch_path(m.spark, "postings")
    postings.build(m.staging, path)
    return postings.rank(m.spark, path, TERMS, 20)


@query("text_rank", sql(f"SELECT id, collection, {rr('score')}, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm ORDER BY round(score, 9) DESC, id LIMIT 20", "staging", extra=_BM))
def text_rank(m: Market):
    return rounded(_ranked(m))


@query("hybrid_rrf", sql(f"SELECT key, collection, lists, {rr('score', digits=9)} FROM (SELECT key, sum(1.0::DOUBLE / (60 + rank)) AS score, arg_min(collection, s) AS collection, count(*) AS lists FROM (SELECT id AS key, collection, 0 AS s, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM v ORDER BY score DESC, id LIMIT 20) UNION ALL SELECT id, collection, 1, row_number() OVER (ORDER BY round(score, 9) DESC, id) FROM (SELECT * FROM bm ORDER BY round(score, 9) DESC, id LIMIT 20)) GROUP BY key) ORDER BY round(score, 12) DESC, key LIMIT 20", "vectors", "staging", extra={"v": _VEC, **_BM}))
def hybrid_rrf(m: Market):
    v = D.vector_top_k(m.vectors, _QV, 20).withColumnRenamed("id", "key")
    t = _ranked(m).withColumnRenamed("id", "key")
    return D.fuse(v, t, 20).select("key", "collection", "lists", r("score", 9).alias("score"))


@query("routed_vectors", sql("SELECT s.id, v.collection, s.source FROM staging s JOIN vectors v USING (id)", "staging", "vectors"))
def routed_vectors(m: Market):
    return D.attach_vectors(m.staging, m.vectors).select("id", "collection", "source")
