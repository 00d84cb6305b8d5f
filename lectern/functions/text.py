"""Text keys, identifiers and digests as built-in expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI = r"10\.[0-9]{4,9}/\S+"
ARXIV = r"(?i)(?:arxiv:|https?://arxiv\.org/(?:abs|pdf)/)?([0-9]{4}\.[0-9]{4,5}|[a-z.-]+/[0-9]{7})(?:v[0-9]+)?"


def tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric tokens; other scripts give none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_title(text: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def compact_title(text: Column) -> Column:
    """The other title key: no separators at all. Not interchangeable with normalize_title."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def normalize_doi(text: Column) -> Column:
    """Without doi: or resolver prefix; of several tokens the first, if it is a DOI."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^(?:doi:\s*)?(?:https?://(?:dx\.)?doi\.org/)?", ""))
    first = F.regexp_replace(F.get(F.split(bare, r"\s+"), F.lit(0)), "[,;]+$", "")
    return F.when(bare.rlike(r"\s") & first.rlike(f"^{DOI}$"), first).otherwise(bare)


def canonical_doi(text: Column) -> Column:
    """Lower-cased DOI, or '' if the text is none."""
    doi = F.lower(normalize_doi(text))
    return F.when(doi.rlike(f"^{DOI}$"), doi).otherwise(F.lit(""))


def normalize_arxiv(text: Column) -> Column:
    """The identifier without prefix, .pdf and version; other text trimmed."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.pdf$", "")
    found = F.regexp_extract(bare, f"^{ARXIV}$", 1)
    return F.when(found != "", found).otherwise(F.trim(F.coalesce(text, F.lit(""))))


def valid_arxiv(text: Column) -> Column:
    """Whether the identifier's year and month can be: old style from 1991 to 2007, new style from April 2007."""
    bare = F.regexp_extract(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.pdf$", ""), f"^{ARXIV}$", 1)
    date = F.regexp_extract(bare, r"([0-9]{4})[0-9.]*$", 1)
    year, month = F.substring(date, 1, 2).try_cast("int"), F.substring(date, 3, 2).try_cast("int")
    old = bare.contains("/")
    right = F.when(old, (year >= 91) | (year <= 7)).otherwise((year > 7) | ((year == 7) & (month >= 4)))
    return F.coalesce((bare != "") & month.between(1, 12) & right, F.lit(False))


def surname(name: Column) -> Column:
    """Last word of a name, or of what stands before its comma, lower-cased without .,; at its ends."""
    before = F.trim(F.get(F.split(F.trim(F.coalesce(name, F.lit(""))), ","), F.lit(0)))
    return F.regexp_replace(F.lower(F.regexp_extract(before, r"(\S+)$", 1)), "^[.,;]+|[.,;]+$", "")


def last_token_surname(name: Column) -> Column:
    """The simpler rule of the twin matcher: the last token, commas or not."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(F.coalesce(name, F.lit(""))), r"(\S+)$", 1)), "^[.,;]+|[.,;]+$", "")


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def title_jaccard(a: Column, b: Column) -> Column:
    def words(t: Column) -> Column:
        return F.filter(F.split(normalize_title(t), " "), lambda x: x != "")

    return set_jaccard(words(a), words(b))


def fingerprint(text: Column) -> Column:
    """sha256 of the text with white space collapsed; null for blank text."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(flat != "", F.sha2(flat, 256))


def metadata_fingerprint(text: Column, abstract_doc: Column) -> Column:
    """Content digest, else ABSTRACT: and that of the abstract document, else META."""
    return F.coalesce(fingerprint(text), F.concat(F.lit("ABSTRACT:"), fingerprint(abstract_doc)), F.lit("META"))


def canonical_json(fields: Column) -> Column:
    """A map as JSON with its keys in order, for digests."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def payload_digest(fields: Column) -> Column:
    return F.sha2(canonical_json(fields), 256)


def cite_keys(text: Column) -> Column:
    r"""Keys of LaTeX \cite commands, in order, repeats kept."""
    inside = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(inside, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")


def prose_citations(text: Column) -> Column:
    """Distinct [key] tokens of two characters or more that are no numbers, by first appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([^\[\]\s]{2,})\]"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("^[0-9]+$")))


def paper_key(path: Column) -> Column:
    """The key of 'paper/<key>' or of a bare key; null for any other path."""
    bare = F.regexp_replace(path, "^paper/", "")
    return F.when((bare != "") & ~bare.contains("/"), bare)


def token_estimate(text: Column) -> Column:
    """Tokens where no tokenizer is at hand: a quarter of the characters, rounded up."""
    return F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def bibtex_escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([&%$#_{}])", r"\\$1")


def url_cohort(url: Column, cohorts: dict[str, str], default: str = "other") -> Column:
    """Cohort of a URL by the longest listed host suffix."""
    host = F.lower(F.coalesce(F.expr("null"), F.try_parse_url(url, F.lit("HOST"))))
    out = F.lit(default)
    for suffix, name in sorted(cohorts.items(), key=lambda x: len(x[0])):
        out = F.when((host == suffix) | host.endswith("." + suffix), F.lit(name)).otherwise(out)
    return out


def valid_http_url(url: Column) -> Column:
    """http or https, a host, no user, and a port up to 65535 if any."""
    host, user = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("USERINFO"))
    port = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), ":([0-9]+)$", 1)
    return F.coalesce(url.rlike("(?i)^https?://") & host.isNotNull() & user.isNull() & ((port == "") | (port.try_cast("int") <= 65535)), F.lit(False))


def title_overlap(title: Column, text: Column, head: int = 1500) -> Column:
    """Share of the title's tokens of four or more characters in the first `head` characters; null without such tokens."""
    words = F.array_distinct(F.filter(tokens(title), lambda x: F.length(x) >= 4))
    there = F.array_distinct(tokens(F.substring(text, 1, head)))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, there)) / F.size(words))


def entity_surface_key(name: Column) -> Column:
    """Lower case without white space, hyphens and underscores; equal to the Unicode key for ASCII names."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s\-_]+", "")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After value, be it a number or an HTTP date; never below 0."""
    at = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]+,\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(F.trim(value).rlike(r"^[0-9]+$"), F.trim(value).try_cast("double")), F.greatest(F.lit(0.0), (at.cast("double") - now.cast("double"))))


def harmonic(a: Column, b: Column) -> Column:
    a, b = F.greatest(F.lit(0.0), a), F.greatest(F.lit(0.0), b)
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))
