"""Queries of the text, identity and predicate families."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import python as P
from lectern.functions import text as T
from lectern.operators import predicates as R
from lectern.operators import sync as S
from lectern.plans.registry import query
from lectern.sources.files import bibtex, normalise_hits
from lectern.sources.html import page_links, page_meta


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS spaced,
regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '', 'g') AS compact FROM part""")
def title_keys(t):
    title = F.concat_ws(" / ", "p_name", "p_brand")
    return t("part").select("p_partkey", T.normalize_title(title).alias("spaced"), T.compact_title(title).alias("compact"))


@query("""SELECT o_orderkey, '10.' || (1000 + o_custkey) || '/x' || o_orderkey AS doi,
CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE '10.' || (1000 + o_custkey) || '/x' || o_orderkey END AS canonical
FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, 'none ' || o_orderkey, '' FROM orders WHERE o_orderkey % 4 = 3""")
def doi_forms(t):
    o = F.col("o_orderkey")
    bare = F.concat(F.lit("10."), (1000 + F.col("o_custkey")).cast("string"), F.lit("/x"), o.cast("string"))
    raw = F.when(o % 4 == 0, F.concat(F.lit(" https://doi.org/"), bare)).when(o % 4 == 1, F.concat(F.lit("DOI: "), bare)).when(o % 4 == 2, F.concat(bare, F.lit(", "), bare)).otherwise(F.concat(F.lit("none "), o.cast("string")))
    return t("orders").select("o_orderkey", T.normalize_doi(raw).alias("doi"), T.canonical_doi(raw).alias("canonical"))


@query("""SELECT o_orderkey, printf('%02d%02d.%05d', y, m, o_orderkey % 100000) AS arxiv_id,
m BETWEEN 1 AND 12 AND (y > 7 OR (y = 7 AND m >= 4)) AS valid
FROM (SELECT o_orderkey, CAST(o_custkey % 30 AS INTEGER) AS y, CAST(o_orderkey % 14 AS INTEGER) AS m FROM orders)""")
def arxiv_ids(t):
    y, m, n = F.col("o_custkey") % 30, F.col("o_orderkey") % 14, F.col("o_orderkey") % 100000
    raw = F.concat(F.lit("arXiv:"), F.format_string("%02d%02d.%05d", y, m, n), F.lit("v2"))
    return t("orders").select("o_orderkey", T.normalize_arxiv(raw).alias("arxiv_id"), T.valid_arxiv(raw).alias("valid"))


@query("""SELECT c_custkey, lower(c_mktsegment) AS surname, lower(c_mktsegment) AS other FROM customer""")
def surnames(t):
    given = F.concat(F.lit("A. "), F.initcap("c_mktsegment"), F.lit("."))
    turned = F.concat(F.initcap("c_mktsegment"), F.lit(", A. B."))
    return t("customer").select("c_custkey", T.surname(turned).alias("surname"), T.last_token_surname(given).alias("other"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS fingerprint FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def fingerprints(t):
    return t("documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint")).where("fingerprint IS NOT NULL")


@query("""SELECT doc_id, CASE WHEN f <> doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)""")
def exact_duplicates(t):
    docs = t("documents").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("pos"), "text")
    return S.intra_dedup(docs, F.sha2("text", 256)).select(F.col("key").alias("doc_id"), "duplicate_of")


@query("""SELECT o_orderkey, ['k' || o_custkey, 'm' || o_orderkey, 'k' || o_custkey] AS keys,
['k' || o_custkey] || CASE WHEN o_orderkey % 2 = 0 THEN ['p' || o_orderkey] ELSE [] END AS cited FROM orders""")
def citation_tokens(t):
    a, b = F.concat(F.lit("k"), F.col("o_custkey").cast("string")), F.concat(F.lit("m"), F.col("o_orderkey").cast("string"))
    tex = F.concat(F.lit("\\citep[see]{"), a, F.lit(", "), b, F.lit("} and \\cite{"), a, F.lit("}"))
    prose = F.concat(F.lit("As ["), a, F.lit("] and [12] say, ["), a, F.lit("]; [x]"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" [p"), F.col("o_orderkey").cast("string"), F.lit("]"))).otherwise(""))
    return t("orders").select("o_orderkey", T.cite_keys(tex).alias("keys"), T.prose_citations(prose).alias("cited"))


@query("""SELECT lang, source, count(*) AS n, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang, source""")
def token_estimates(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query("""SELECT page_id, CASE WHEN h LIKE '%.example.net' OR h = 'example.net' THEN 'net' WHEN h LIKE '%.example.com' OR h = 'example.com' THEN 'com' ELSE 'other' END AS cohort, true AS valid
FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS h FROM pages)""")
def url_cohorts(t):
    return t("pages").select("page_id", T.url_cohort(F.col("url"), {"example.net": "net", "example.com": "com"}).alias("cohort"), T.valid_http_url(F.col("url")).alias("valid"))


@query("""SELECT d.doc_id, b.item_id, round(CAST(len(list_intersect(b.w, d.w)) AS DOUBLE) / len(b.w), 9) AS overlap
FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text[1:1500]), '[a-z0-9]+')) AS w FROM documents) d
JOIN (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4)) AS w, count(*) OVER () AS n FROM benchmark) b
ON b.item_id = d.doc_id % b.n WHERE len(b.w) > 0""")
def title_overlaps(t):
    items = t("benchmark").select("item_id", F.col("text").alias("title"))
    n = items.agg(F.count("*").alias("n"))
    docs = t("documents").select("doc_id", "text").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    return docs.join(items, "item_id").select("doc_id", "item_id", F.round(T.title_overlap(F.col("title"), F.col("text")), 9).alias("overlap")).where("overlap IS NOT NULL")


@query("""SELECT a.p_partkey, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(a.w || b.w)) END, 9) AS jaccard
FROM (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part) a
JOIN (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part) b ON b.p_partkey = a.p_partkey + 1""")
def title_jaccards(t):
    p = t("part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select("p_partkey", F.round(T.title_jaccard(F.col("p_name"), F.col("other")), 9).alias("jaccard"))


@query("""SELECT o_orderkey, sha256('{"cust":"' || o_custkey || '","order":"' || o_orderkey || '","status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def payload_digests(t):
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("order"), F.col("o_orderkey").cast("string"), F.lit("cust"), F.col("o_custkey").cast("string"))
    return t("orders").select("o_orderkey", T.payload_digest(m).alias("digest"))


@query("""SELECT key, round(score, 9) AS score FROM (SELECT doc_id AS key, CAST(len(list_intersect(['the', 'and', 'attion', 'entre'], list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS DOUBLE) / 4 AS score FROM documents)
WHERE score > 0""")
def keyword_overlaps(t):
    from lectern.operators.ranking import keyword_overlap

    docs = t("documents").select(F.col("doc_id").alias("key"), "text")
    return keyword_overlap(docs, F.lit("the and attion entre the"), F.col("text")).select("key", F.round("score", 9).alias("score"))


@query("""SELECT doc_id, nullif(CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'paper/d' || doc_id END, '') IS NOT NULL AS has_path, CASE WHEN doc_id % 7 <> 0 THEN 'd' || doc_id END AS key FROM documents""")
def paper_keys(t):
    path = F.when(F.col("doc_id") % 7 == 0, F.lit("web/x/y")).otherwise(F.concat(F.lit("paper/d"), F.col("doc_id").cast("string")))
    return t("documents").select("doc_id", (F.col("doc_id") % 7 != 0).alias("has_path"), T.paper_key(path).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 500 AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey % 50 AS DOUBLE) ELSE 0.0 END AS wait FROM orders""")
def retry_afters(t):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    later = F.concat(F.lit("Mon, "), F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + c % 50), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    value = F.when(o % 3 == 0, (c % 500).cast("string")).when(o % 3 == 1, later).otherwise("Sun, 31 Dec 2023 00:00:00 GMT")
    return t("orders").select("o_orderkey", T.retry_after_seconds(value, now).alias("wait"))


@query("""SELECT 'search' AS rule, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 OR year(o_orderdate) BETWEEN 1995 AND 1996
UNION ALL SELECT 'library', count(*) FROM orders WHERE o_orderkey % 5 <> 0 AND year(o_orderdate) BETWEEN 1995 AND 1996""")
def year_rules(t):
    rows = t("orders").withColumn("year", F.when(F.col("o_orderkey") % 5 != 0, F.year("o_orderdate")))
    a = rows.where(R.year_window(F.col("year"), 1995, 1996)).agg(F.lit("search").alias("rule"), F.count("*").alias("n"))
    return a.union(R.library_filter(rows, 1995, 1996).agg(F.lit("library").alias("rule"), F.count("*").alias("n")))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'conference_abstract' WHEN p_size % 5 = 1 THEN 'non_paper' WHEN p_size % 5 = 2 THEN 'anonymous_author' ELSE '' END AS reason,
p_size % 5 < 3 OR p_size % 7 = 0 OR p_size % 11 = 0 AS excluded FROM part""")
def garbage_reasons(t):
    s = F.col("p_size")
    doi = F.when((s % 5 == 0) & (s % 2 == 0), F.lit("10.5194/EGUSPHERE-EGU23-1")).otherwise("10.1/x")
    venue = F.when((s % 5 == 0) & (s % 2 == 1), F.lit("AGU  Fall Meeting 2020")).otherwise(F.col("p_type"))
    types = F.when(s % 5 == 1, F.array(F.lit("Article"), F.lit("DataSet"))).otherwise(F.array(F.lit("article")))
    authors = F.when(s % 5 == 2, F.array(F.lit(" Anonymous"))).otherwise(F.array("p_brand"))
    reason = R.garbage_reason(doi, venue, types, authors)
    policy = F.when(s % 7 == 0, "EXCLUDED").when(s % 3 == 0, "UNKNOWN").otherwise("CLEAR")
    return t("part").select("p_partkey", reason.alias("reason"), R.serving_excluded(F.lit(None).cast("string"), s % 11 == 0, policy, reason).alias("excluded"))


@query("""SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN '' WHEN p_size % 2 = 0 THEN 'domain_unjudged_or_rejected' WHEN p_size % 3 = 0 THEN 'non_paper' WHEN p_size % 5 = 0 THEN 'no_identifier' ELSE '' END AS reason FROM part""")
def registration_gate(t):
    s = F.col("p_size")
    types = F.when(s % 3 == 0, F.array(F.lit("book"))).otherwise(F.array().cast("array<string>"))
    reason = R.registration_rejection(F.when(s % 13 == 0, "k"), s % 4 != 0, F.when(s % 2 == 1, "core"), ["core", "edge"], F.lit(""), F.col("p_type"), types, F.lit(True), s % 5 != 0, F.lit(False))
    return t("part").select("p_partkey", reason.alias("reason"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 3 = 0 WHEN o_orderkey % 4 = 1 THEN o_custkey % 2 = 0 ELSE false END AS allowed,
CASE WHEN o_orderkey % 4 = 3 OR o_custkey % 4 = 3 THEN 'UNKNOWN' WHEN o_orderkey % 4 = 2 OR o_custkey % 4 = 2 THEN 'EXCLUDED' WHEN o_orderkey % 4 = 1 OR o_custkey % 4 = 1 THEN 'OVERRIDE' ELSE 'CLEAR' END AS merged FROM orders""")
def policies(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*map(F.lit, ("CLEAR", "OVERRIDE", "EXCLUDED")))
    policy = F.when(o % 4 < 3, F.get(names, (o % 4).cast("int")))
    reasons = F.when((o % 4 == 0) & (c % 3 == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("license"), F.lit("scope")))
    grant = F.struct(o.alias("key"), (c % 2).alias("revision"), F.array(F.lit("scope"), F.lit("license"), F.lit("x")).alias("reasons"))
    other = F.when(c % 4 < 3, F.get(names, (c % 4).cast("int")))
    return t("orders").select("o_orderkey", R.policy_allows(policy, reasons, grant, o, F.lit(0)).alias("allowed"), R.merged_policy(policy, other).alias("merged"))


@query("""SELECT route, tier, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'TERMINAL' WHEN l_returnflag = 'A' THEN 'TERMINAL' WHEN l_linestatus = 'F' THEN 'EXTRACT' WHEN l_quantity < 10 OR l_tax = 0 THEN 'TERMINAL' ELSE 'DOWNLOAD' END AS route,
CASE WHEN l_discount = 0 THEN 'F' WHEN l_quantity * 100 < 2000 THEN 'G' WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END AS tier FROM lineitem) GROUP BY route, tier""")
def routes(t):
    q = F.col("l_quantity")
    route = R.route(F.col("l_linenumber") == 7, F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", q < 10, F.col("l_tax") != 0)
    tier = R.extract_tier(q * 100, F.col("l_returnflag") == "A", F.col("l_discount") == 0)
    return t("lineitem").select(route.alias("route"), tier.alias("tier")).groupBy("route", "tier").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}\\p{M}_])(the|les|und)([^\\p{L}\\p{N}\\p{M}_]|$)') AS named FROM documents""")
def named_entities(t):
    return t("documents").select("doc_id", R.names_entity(F.col("text"), ["the", "les", "und"]).alias("named"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1990 + c_custkey % 30 END AS year, c_custkey % 4 = 0 AS is_review, CASE WHEN c_custkey % 2 = 0 THEN '10.1234/a' || c_custkey ELSE '' END AS doi FROM customer""")
def hit_normaliser(t):
    c = F.col("c_custkey")
    rows = t("customer").select("c_custkey", F.when(c % 4 == 0, "A Review of X").otherwise("Preview of X").alias("title"), F.when(c % 3 == 0, "n.d.").otherwise((1990 + c % 30).cast("string")).alias("year"),
                                F.when(c % 2 == 0, F.concat(F.lit("doi:10.1234/A"), c.cast("string"))).otherwise("x").alias("doi"), F.lit("").alias("arxiv_id"), F.lit(None).cast("boolean").alias("is_review"))
    return normalise_hits(rows).select("c_custkey", F.col("year").cast("long").alias("year"), "is_review", "doi")


@query("""SELECT p_partkey, '@article{p' || p_partkey || ',' || chr(10) || '  title = {' || p_name || '\\& more},' || chr(10) || '  author = {' || p_brand || ' and X},' || chr(10) || '  year = {2001}' || chr(10) || '}' || chr(10) AS value
FROM (SELECT p_partkey, p_name, replace(p_brand, '#', '\\#') AS p_brand FROM part)""")
def bibtex_entries(t):
    rows = t("part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.concat("p_name", F.lit("& more")).alias("title"), F.array(F.regexp_replace("p_brand", "#", "#"), F.lit("X")).alias("authors"), F.lit(2001).alias("year"), F.lit("").alias("venue"), F.lit(None).cast("string").alias("doi"))
    out = bibtex(rows)
    return out.select(F.regexp_extract("value", r"\{p([0-9]+),", 1).cast("long").alias("p_partkey"), "value")


@query()
def sentence_chunks(t):
    return P.chunked(t("documents").select("doc_id", "text"), "text", 400, 40)


@query()
def heading_sections(t):
    titled = F.concat(F.lit("# Head\n\n"), F.regexp_replace("text", "\n", "\n\n## Part\n\n"))
    return P.sectioned(t("documents").select("doc_id", titled.alias("text")), "text", 500)


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '(?i)(references|bibliography|#)', 'x', 'g'), concat(' ', chr(9), chr(10), chr(13))) AS body FROM documents),
c AS (SELECT doc_id, body || chr(10) || chr(10) || '## 5. Acknowledgements' || chr(10) || 'We thank all.' || chr(10) || chr(10) || '## Appendix' || chr(10) || 'More.' AS whole, trim(body || chr(10) || chr(10) || '## Appendix' || chr(10) || 'More.', concat(' ', chr(9), chr(10), chr(13))) AS less FROM t)
SELECT doc_id, CASE WHEN 2 * length(less) >= length(whole) THEN less ELSE whole END AS text FROM c""")
def cleaned_extracts(t):
    body = F.regexp_replace(F.regexp_replace(F.col("text"), "(?i)(references|bibliography|#)", "x"), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    tail = F.lit("\n\n## 5. Acknowledgements\nWe thank all.\n\n## Appendix\nMore.\n\n# References\n[1] A. B.")
    return t("documents").select("doc_id", P.clean_extract(F.concat(body, tail)).alias("text"))


@query()
def links_of_pages(t):
    return page_links(t("pages"))


# Said over rendered pages, so that SQL knows every fact: documents give titles, authors (several tags of one name) and files.
@query("""WITH d AS (SELECT doc_id, lang, source, n_chars FROM documents), m AS (SELECT doc_id, 'citation_author' AS name, unnest(range(doc_id % 4)) AS pos, 'Author ' || (doc_id + pos) || ' & Co' AS content FROM d UNION ALL SELECT doc_id, 'og:site', 0, source FROM d UNION ALL SELECT doc_id, 'citation_pdf_url', 0, '/f/' || doc_id || '.pdf' FROM d WHERE doc_id % 3 = 0)
SELECT doc_id AS page_id, 'Doc ' || doc_id AS title, lang, CASE WHEN doc_id % 3 = 0 THEN 'http://x.org/f/' || doc_id || '.pdf' WHEN doc_id % 3 = 1 THEN 'http://x.org/a/g' || doc_id || '.PDF?v=1' END AS pdf_url, name, CAST(pos AS INTEGER) AS pos, content FROM d JOIN m USING (doc_id)""")
def facts_of_pages(t):
    i = F.col("doc_id").cast("string")
    authors = F.array_join(F.transform(F.when(F.col("doc_id") % 4 > 0, F.sequence(F.lit(0), (F.col("doc_id") % 4 - 1).cast("int"))), lambda k: F.concat(F.lit('<meta name="Citation_Author" content="Author '), (F.col("doc_id") + k).cast("string"), F.lit(' &amp; Co">'))), "")
    file = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<meta name="citation_pdf_url" content="/f/'), i, F.lit('.pdf">'))).otherwise("")
    link = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit('<a href="g'), i, F.lit('.PDF?v=1">file</a>'))).otherwise("")
    html = F.concat(F.lit('<html lang="'), "lang", F.lit('"><head><title> Doc '), i, F.lit('</title><meta property="og:site" content="'), "source", F.lit('">'), F.coalesce(authors, F.lit("")), file, F.lit("</head><body>"), link, F.lit("</body></html>"))
    return page_meta(t("documents").select(F.col("doc_id").alias("page_id"), F.lit("http://x.org/a/b").alias("url"), html.alias("html")))


@query("""SELECT lang, status, n FROM (SELECT lang, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2)""")
def census(t):
    status = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 1, "good").otherwise("bad")
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("lang", status.alias("status")).agg(F.count("*").alias("n"))
