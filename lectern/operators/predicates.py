"""Filters, ordered reason ladders and fail-closed predicates as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Publication types that make a record a paper, and those that rule it out.
PAPER_TYPES = "article book-chapter booksection casereport clinicaltrial conference conferencepaper dissertation journal-article journalarticle letter lettersandcomments metaanalysis posted-content preprint proceedings-article review study thesis".split()
OTHER_TYPES = "book component dataset editorial erratum grant monograph news paratext peer-review peerreview retraction software supplementary-material supplementary-materials".split()
#: Venues that print conference abstracts, and author names that stand for none.
ABSTRACT_VENUES = r"agu fall meeting|agu spring meeting|meeting abstract|conference abstract|cospar scientific assembly|egu general assembly|aas meeting|aps .* meeting abstract|bulletin of the american astronomical society|bulletin of the american physical society"
NOBODY = ("anon", "anon.", "anonymous", "unknown")


def year_window(year: Column, low: int | None, high: int | None) -> Column:
    """Search's rule: rows without a year stay."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (year >= low)
    if high is not None:
        ok = ok & (year <= high)
    return year.isNull() | ok


def library_filter(rows: DataFrame, year_min: int | None = None, year_max: int | None = None, review: bool | None = None, extract: bool | None = None, min_citations: int | None = None) -> DataFrame:
    """The library's rule: a bound on the year drops rows without one."""
    if year_min is not None:
        rows = rows.where(F.col("year") >= year_min)
    if year_max is not None:
        rows = rows.where(F.col("year") <= year_max)
    if review is not None:
        rows = rows.where(F.coalesce("is_review", F.lit(False)) == review)
    if extract is not None:
        rows = rows.where(F.col("extract_path").isNotNull() == extract)
    if min_citations is not None:
        rows = rows.where(F.coalesce("citation_count", F.lit(0)) >= min_citations)
    return rows


def is_paper(types: Column) -> Column:
    """False if any type rules a paper out, true if any makes one, else null."""
    lowered = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.when(F.arrays_overlap(lowered, F.array(*map(F.lit, OTHER_TYPES))), False).when(F.arrays_overlap(lowered, F.array(*map(F.lit, PAPER_TYPES))), True)


def _conference_abstract(doi: Column, venue: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(venue, F.lit(""))), r"\s+", " "))
    return F.lower(F.coalesce(doi, F.lit(""))).rlike(r"^10\.5194/egusphere-egu[0-9]") | flat.rlike(ABSTRACT_VENUES)


def garbage_reason(doi: Column, venue: Column, types: Column, authors: Column) -> Column:
    """conference_abstract, non_paper, anonymous_author or '', the first that holds."""
    first = F.lower(F.trim(F.get(authors, F.lit(0))))
    return (
        F.when(_conference_abstract(doi, venue), "conference_abstract")
        .when(F.coalesce(~is_paper(types), F.lit(False)), "non_paper")
        .when(F.coalesce(first.isin(*NOBODY), F.lit(False)), "anonymous_author")
        .otherwise("")
    )


def serving_excluded(domain_status: Column, quarantine: Column, policy: Column, garbage: Column) -> Column:
    """Any of four reasons; an unknown policy is none."""
    return (F.coalesce(domain_status, F.lit("")) != "") | F.coalesce(quarantine, F.lit(False)) | F.coalesce(policy == "EXCLUDED", F.lit(False)) | (garbage != "")


def clean_view(rows: DataFrame, hidden: bool = False) -> DataFrame:
    """Rows neither quarantined nor aliased, or all of them."""
    return rows if hidden else rows.where(~F.coalesce("quarantine", F.lit(False)) & F.col("alias_key").isNull())


def registration_rejection(known_key: Column, ingest_ok: Column, tier: Column, tiers: Iterable[str], doi: Column, venue: Column, types: Column, llm_is_paper: Column, identified: Column, known_identity: Column) -> Column:
    """The first failing reason of the registration gate, '' if none fails."""
    paper = F.coalesce(is_paper(types), llm_is_paper, F.lit(False))
    judged = F.coalesce(ingest_ok, F.lit(False)) & F.coalesce(tier.isin(*tiers), F.lit(False))
    return (
        F.when(F.coalesce(known_key, F.lit("")) != "", "")
        .when(~judged, "domain_unjudged_or_rejected")
        .when(_conference_abstract(doi, venue), "conference_abstract")
        .when(~paper, "non_paper")
        .when(~F.coalesce(identified, F.lit(False)) & ~F.coalesce(known_identity, F.lit(False)), "no_identifier")
        .otherwise("")
    )


def phantom_reason(title: Column, authors: Column) -> Column:
    """Why a record's metadata cannot be a paper's: blank_title, short_title, no_letters or blank_authors; else ''."""
    t = F.trim(F.coalesce(title, F.lit("")))
    named = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    return F.when(t == "", "blank_title").when(F.length(t) < 5, "short_title").when(~t.rlike(r"\p{L}"), "no_letters").when((F.size(authors) > 0) & (F.size(named) == 0), "blank_authors").otherwise("")


def admission(*conditions: Column) -> Column:
    """All conditions, each null one failing."""
    ok = F.lit(True)
    for c in conditions:
        ok = ok & F.coalesce(c, F.lit(False))
    return ok


def policy_allows(policy: Column, reasons: Column, grant: Column, key: Column, revision: Column) -> Column:
    """Clear and without reasons, or overridden by a grant for this key and revision that names every reason.

    grant: struct<key, revision, reasons>. Missing evidence denies.
    """
    none = F.array().cast("array<string>")
    clear = (policy == "CLEAR") & (F.size(F.coalesce(reasons, none)) == 0)
    covered = F.forall(F.coalesce(reasons, none), lambda r: F.array_contains(grant["reasons"], r))
    granted = (policy == "OVERRIDE") & (grant["key"] == key) & (grant["revision"] == revision) & covered
    return F.coalesce(clear, F.lit(False)) | F.coalesce(granted, F.lit(False))


_SEVERITY = ("CLEAR", "OVERRIDE", "EXCLUDED", "UNKNOWN")


def merged_policy(a: Column, b: Column) -> Column:
    """The more severe of two policies: UNKNOWN over EXCLUDED over OVERRIDE over CLEAR; null counts as UNKNOWN."""
    levels = F.array(*map(F.lit, _SEVERITY))

    def level(x: Column) -> Column:
        at = F.array_position(levels, x)
        return F.when(at > 0, at).otherwise(F.lit(len(_SEVERITY)))

    return F.element_at(levels, F.greatest(level(a), level(b)).cast("int"))


def merged_reasons(a: Column, b: Column) -> Column:
    """Reasons of both, each once, in order."""
    return F.array_distinct(F.concat(a, b))


def legacy_status(status: Column) -> Column:
    """struct<retrieval, policy> of an old one-word status."""
    return F.struct(
        F.when(status.isin("ok", "success"), "AVAILABLE").when(status.isin("failed", "not_found"), "FAILED").when(status == "pending", "PENDING").otherwise("UNKNOWN").alias("retrieval"),
        F.when(status == "excluded", "EXCLUDED").when(status.isNull(), "UNKNOWN").otherwise("CLEAR").alias("policy"),
    )


def route(excluded: Column, has_extract: Column, has_pdf: Column, terminal: Column, identified: Column) -> Column:
    """DOWNLOAD, EXTRACT or TERMINAL; total and exclusive, tested in this order."""
    return (
        F.when(F.coalesce(excluded, F.lit(True)), "TERMINAL")
        .when(F.coalesce(has_extract, F.lit(False)), "TERMINAL")
        .when(F.coalesce(has_pdf, F.lit(False)), "EXTRACT")
        .when(F.coalesce(terminal, F.lit(False)) | ~F.coalesce(identified, F.lit(False)), "TERMINAL")
        .otherwise("DOWNLOAD")
    )


def reopenable(state: Column, attempts: Column, cap: int) -> Column:
    return F.coalesce(state.isin("FAILED", "PENDING") & (attempts < cap), F.lit(False))


def extract_tier(chars: Column, has_markdown: Column, broken: Column) -> Column:
    """A: long Markdown; B: long plain text; G: short; F: broken or none."""
    return F.when(F.coalesce(broken, F.lit(False)) | (F.coalesce(chars, F.lit(0)) == 0), "F").when(chars < 2000, "G").when(F.coalesce(has_markdown, F.lit(False)), "A").otherwise("B")


def retry_filter(rows: DataFrame, spec: str) -> DataFrame:
    """has-arxiv, has-doi or doi:<prefix>; anything else raises."""
    if spec == "has-arxiv":
        return rows.where(F.coalesce("arxiv_id", F.lit("")) != "")
    if spec == "has-doi":
        return rows.where(F.coalesce("doi", F.lit("")) != "")
    if spec.startswith("doi:") and len(spec) > 4:
        return rows.where(F.lower("doi").startswith(spec[4:].lower()))
    raise ValueError(f"unknown filter {spec!r}")


def needs(rows: DataFrame, what: str) -> DataFrame:
    """Rows that lack an abstract, a DOI (but have a title) or any enrichment."""
    def blank(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    tests = {"abstract": blank("abstract"), "doi": blank("doi") & ~blank("title"), "enrich": blank("abstract") | blank("doi") | F.col("year").isNull()}
    return rows.where(tests[what])


def names_entity(text: Column, aliases: Iterable[str]) -> Column:
    """Whether a text holds one of the names as whole words, in any case."""
    import re

    quoted = "|".join(re.escape(a) for a in aliases)
    return F.coalesce(text, F.lit("")).rlike(rf"(?iU)(?<!\w)(?:{quoted})(?!\w)") if quoted else F.lit(False)


def coerced_flag(value: Column) -> Column:
    """A judge's flag: true unless false, 0, '' or the string 'false'; null fails."""
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce(~text.isin("false", "0", "", "no"), F.lit(False))
