"""Answers of search services, landed as raw text, to rows of one shape.

A landed table has (term_idx, payload), a row for each answer. parsed() gives a row for each hit: term_idx,
rank (its place in the answer), title, authors, year, abstract, venue, doi, arxiv_id, paper_id,
citation_count, url, types. A payload that cannot be read gives no hit; a field that is missing or of
another type is null, '' or empty as the target has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize_arxiv, normalize_doi

_TEXTS = "array<string>"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"\s*\n\s*", " "))


def _names(c: Column, field: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array()), lambda x: F.trim(_text(field(x)))), lambda x: x != "")


def _year(c: Column) -> Column:
    return F.when(F.trim(c.cast("string")).rlike("^[0-9]+$"), F.trim(c.cast("string")).try_cast("int"))


def _count(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(0))


def _arxiv_of(*places: Column) -> Column:
    """The first arXiv id in a DOI or address."""
    found = [F.regexp_extract(_text(p), r"(?i)(?:arxiv\.org/(?:abs|pdf)/|10\.48550/arxiv\.)([a-z-]+(?:\.[a-z]{2})?/[0-9]{7}|[0-9]{4}\.[0-9]{4,5})", 1) for p in places]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))


def _first(c: Column) -> Column:
    return _text(F.get(c, F.lit(0)))


def _hits(answers: DataFrame, items: Column) -> DataFrame:
    return answers.select("term_idx", F.posexplode(items).alias("rank", "h"))


def _shaped(hits: DataFrame, title: Column, authors: Column, year: Column, abstract: Column, venue: Column, doi: Column, arxiv_id: Column, paper_id: Column, citations: Column, url: Column, types: Column | None = None) -> DataFrame:
    none = F.array().cast(_TEXTS)
    return hits.select(
        "term_idx", "rank", _flat(title).alias("title"), F.coalesce(authors, none).alias("authors"), year.alias("year"), _flat(abstract).alias("abstract"), _flat(venue).alias("venue"),
        F.coalesce(normalize_doi(doi), F.lit("")).alias("doi"), F.coalesce(normalize_arxiv(arxiv_id), F.lit("")).alias("arxiv_id"), _text(paper_id).alias("paper_id"), citations.alias("citation_count"), _text(url).alias("url"), F.coalesce(types, none).alias("types") if types is not None else none.alias("types"),
    )


def arxiv(answers: DataFrame) -> DataFrame:
    """An Atom feed; entries without a title or a date are none, and keep their place."""
    author = "struct<name:string>"
    entry = f"struct<id:string,title:string,summary:string,published:string,author:array<{author}>,`arxiv:doi`:string>"
    feed = F.from_xml(F.col("payload"), f"struct<entry:array<{entry}>>", {"rowTag": "feed"})
    hits = _hits(answers, feed["entry"]).where("h.title IS NOT NULL AND h.published IS NOT NULL")
    h = F.col("h")
    ident = F.regexp_extract(h["id"], "/abs/(.*)$", 1)
    return _shaped(hits, h["title"], _names(h["author"], lambda a: a["name"]), _year(F.substring(h["published"], 1, 4)), h["summary"], F.lit(""), h["arxiv:doi"], ident, ident, F.lit(0), F.trim(h["id"]))


def ads(answers: DataFrame) -> DataFrame:
    doc = f"struct<title:{_TEXTS},author:{_TEXTS},year:string,abstract:string,doi:{_TEXTS},identifier:{_TEXTS},bibcode:string,pub:string,citation_count:string>"
    hits = _hits(answers, F.from_json("payload", f"response struct<docs:array<{doc}>>")["response"]["docs"])
    h = F.col("h")
    named = F.filter(F.transform(F.coalesce(h["identifier"], F.array().cast(_TEXTS)), lambda x: F.regexp_extract(x, r"(?i)^(?:arxiv:)?([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})$", 1)), lambda x: x != "")
    doi = _first(h["doi"])
    url = F.when(_text(h["bibcode"]) != "", F.concat(F.lit("https://ui.adsabs.harvard.edu/abs/"), h["bibcode"], F.lit("/abstract"))).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")
    known = F.when(F.size(named) > 0, F.get(named, F.lit(0))).otherwise(_arxiv_of(doi, url))
    return _shaped(hits, _first(h["title"]), F.filter(h["author"], lambda x: x.isNotNull()), _year(h["year"]), h["abstract"], h["pub"], doi, known, h["bibcode"], _count(h["citation_count"]), url)


def semantic_scholar(answers: DataFrame) -> DataFrame:
    paper = f"struct<title:string,authors:array<struct<name:string>>,abstract:string,year:string,citationCount:string,externalIds:struct<DOI:string,ArXiv:string>,paperId:string,venue:string,publicationVenue:struct<name:string>,publicationTypes:{_TEXTS},url:string>"
    hits = _hits(answers, F.from_json("payload", f"data array<{paper}>")["data"])
    h = F.col("h")
    venue = F.when(_text(h["venue"]) != "", h["venue"]).otherwise(h["publicationVenue"]["name"])
    return _shaped(hits, h["title"], _names(h["authors"], lambda a: a["name"]), _year(h["year"]), h["abstract"], venue, h["externalIds"]["DOI"], h["externalIds"]["ArXiv"], h["paperId"], _count(h["citationCount"]), h["url"], h["publicationTypes"])


def openalex(answers: DataFrame) -> DataFrame:
    """Works; their abstracts come as words with places and are put together again."""
    work = "struct<id:string,title:string,authorships:array<struct<author:struct<display_name:string>>>,publication_year:string,abstract_inverted_index:map<string,array<int>>,cited_by_count:string,doi:string,type:string,primary_location:struct<source:struct<display_name:string>,landing_page_url:string,pdf_url:string>,host_venue:struct<display_name:string>,open_access:struct<oa_url:string>>"
    hits = _hits(answers, F.from_json("payload", f"results array<{work}>")["results"]).where(F.trim(F.coalesce("h.title", F.lit(""))) != "")
    h = F.col("h")
    placed = F.flatten(F.transform(F.map_entries(h["abstract_inverted_index"]), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    abstract = F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
    place = h["primary_location"]
    venue = F.when(F.trim(_text(place["source"]["display_name"])) != "", place["source"]["display_name"]).otherwise(h["host_venue"]["display_name"])
    ident = F.regexp_extract(_text(h["id"]), "([^/]*)$", 1)
    url = F.when(_text(h["doi"]) != "", h["doi"]).otherwise(h["id"])
    return _shaped(hits, h["title"], _names(h["authorships"], lambda a: a["author"]["display_name"]), _year(h["publication_year"]), abstract, venue, h["doi"], _arxiv_of(h["doi"], h["id"], place["landing_page_url"], place["pdf_url"], h["open_access"]["oa_url"]), ident, _count(h["cited_by_count"]), url, F.array(_text(h["type"])))


def inspire(answers: DataFrame) -> DataFrame:
    meta = "struct<control_number:string,titles:array<struct<title:string>>,authors:array<struct<full_name:string>>,abstracts:array<struct<value:string>>,dois:array<struct<value:string>>,arxiv_eprints:array<struct<value:string>>,publication_info:array<struct<journal_title:string,year:string>>,earliest_date:string,citation_count:string,document_type:array<string>>"
    hits = _hits(answers, F.from_json("payload", f"hits struct<hits:array<struct<id:string,metadata:{meta}>>>")["hits"]["hits"])
    m = F.col("h.metadata")

    def first(c: Column, field: str) -> Column:
        return _text(F.get(c, F.lit(0))[field])

    year = F.coalesce(_year(first(m["publication_info"], "year")), _year(F.substring(m["earliest_date"], 1, 4)))
    ident = F.coalesce(m["control_number"], F.col("h.id"))
    return _shaped(hits, first(m["titles"], "title"), _names(m["authors"], lambda a: a["full_name"]), year, first(m["abstracts"], "value"), first(m["publication_info"], "journal_title"), first(m["dois"], "value"), first(m["arxiv_eprints"], "value"), ident, _count(m["citation_count"]), F.concat(F.lit("https://inspirehep.net/literature/"), ident), m["document_type"])


def core(answers: DataFrame) -> DataFrame:
    work = f"struct<id:string,title:string,authors:array<struct<name:string>>,abstract:string,yearPublished:string,doi:string,arxivId:string,journals:array<struct<title:string>>,publisher:string,downloadUrl:string,sourceFulltextUrls:{_TEXTS},citationCount:string>"
    hits = _hits(answers, F.from_json("payload", f"results array<{work}>")["results"])
    h = F.col("h")
    journal = _text(F.get(h["journals"], F.lit(0))["title"])
    url = F.when(_text(h["downloadUrl"]) != "", h["downloadUrl"]).otherwise(_first(h["sourceFulltextUrls"]))
    known = F.when(_text(h["arxivId"]).rlike(r"^(?i:arxiv:)?([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})(v[0-9]+)?$"), h["arxivId"]).otherwise(_arxiv_of(h["doi"], url))
    return _shaped(hits, h["title"], _names(h["authors"], lambda a: a["name"]), _year(h["yearPublished"]), h["abstract"], F.when(journal != "", journal).otherwise(h["publisher"]), h["doi"], known, h["id"], _count(h["citationCount"]), url)


PARSERS = {"arxiv": arxiv, "ads": ads, "semantic_scholar": semantic_scholar, "openalex": openalex, "inspire": inspire, "core": core}


def parsed(answers: DataFrame) -> DataFrame:
    """Hits of all services: (backend, term_idx, rank, ...). answers: (backend, term_idx, payload)."""
    out = None
    for name, parse in PARSERS.items():
        one = parse(answers.where(F.col("backend") == name)).select(F.lit(name).alias("backend"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def references_of(edges: DataFrame, papers: DataFrame, cited_by: bool = False) -> DataFrame:
    """(key, other): what each paper cites, or what cites it, each once. edges: (citing, cited); papers: (key)."""
    a, b = ("cited", "citing") if cited_by else ("citing", "cited")
    return edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).join(papers.select(F.col("key").alias(a)).distinct(), a, "left_semi").select(F.col(a).alias("key"), F.col(b).alias("other")).distinct()
