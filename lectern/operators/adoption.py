"""Identifiers verified late: which record a contested one goes to, and where a stub goes whose DOI is another record's.

Claims are worked off in the order of their positions, first come, first served. A record takes at most one value of a
name and a value has at most one owner, so what the loop over claims leaves is the greedy matching in that order. It is
found in rounds: a claim that is the first left both for its record and for its value is granted, and all others for
either of them are out. The first claim of all is granted in every round, and each round takes whole claims away at
once, so rounds grow with the longest chain of claims that block each other, not with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize_arxiv, normalize_doi
from lectern.operators.lineage import saved

NAMES = ("doi", "arxiv_id", "inspire_record_id", "paper_id")
# fixed values: the namespace of a source's own ids
NAMESPACES = {"arxiv": "arxiv:paper", "ads": "ads:bibcode", "semantic_scholar": "semantic_scholar:paper", "openalex": "openalex:work", "inspire": "inspire:literature", "core": "core:work"}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def identifier_token(name: Column, value: Column, source: Column) -> Column:
    """The form in which values of an identifier are compared; '' if the value is none, null for an unknown name.

    DOIs in lower case without prefix; arXiv ids without prefix and version; INSPIRE numbers above 0 without leading zeros;
    a source's own ids behind the namespace of the first source known, or else behind all that `source` says.
    """
    spaces = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    known = F.filter(F.split(F.lower(F.trim(_text(source))), r"[\s,;+|]+"), lambda s: F.map_contains_key(spaces, s))
    space = F.coalesce(F.try_element_at(spaces, F.get(known, F.lit(0))), _text(source))
    own, digits = F.trim(_text(value)), F.regexp_replace(F.trim(_text(value)), "^0+", "")
    return (
        F.when(name == "doi", F.lower(normalize_doi(value.cast("string")))).when(name == "arxiv_id", normalize_arxiv(value.cast("string")))
        .when(name == "inspire_record_id", F.when(own.rlike("^[0-9]+$"), digits).otherwise(""))
        .when(name == "paper_id", F.when((own != "") & (space != ""), F.concat(space, F.lit(":"), own)).otherwise(""))
    )


def _held(records: DataFrame) -> DataFrame:
    """(key, ord, stands, name, value, token): what records hold, and the record that stands for each."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), _text(F.col(n)).alias("value")) for n in NAMES])
    rows = records.select("key", "ord", F.coalesce("canonical", "key").alias("stands"), "source", F.inline(each)).where("value <> ''")
    return rows.select("key", "ord", "stands", "name", "value", identifier_token(F.col("name"), F.col("value"), F.col("source")).alias("token"))


def _owners(held: DataFrame, *by: str) -> DataFrame:
    """(name, token, owner): the first record to hold a token, or the one that stands for it."""
    return held.where("token <> ''").groupBy(*by).agg(F.min_by("stands", "ord").alias("owner"))


def granted(claims: DataFrame) -> DataFrame:
    """(name, key, token, pos) of the claims (name, key, token, pos) that the order grants: the greedy matching of keys and tokens.

    Firsts are aggregates joined back, so a token that a third of all claims want is one row on its side of the join.
    """
    left = saved(claims.groupBy("name", "key", "token").agg(F.min("pos").alias("pos")), "claims")
    out = None
    while not left.isEmpty():
        own = left.groupBy("name", "key").agg(F.min("pos").alias("pos"))
        wanted = left.groupBy("name", "token").agg(F.min("pos").alias("pos"))
        won = saved(left.join(own, ["name", "key", "pos"]).join(wanted, ["name", "token", "pos"]).select("name", "key", "token", "pos"), "granted")
        out = won if out is None else out.unionByName(won)
        left = saved(left.join(won.select("name", "key"), ["name", "key"], "left_anti").join(won.select("name", "token"), ["name", "token"], "left_anti"), "claims")
    return left if out is None else out


def adopted(claims: DataFrame, records: DataFrame, reservations: DataFrame) -> DataFrame:
    """(id, pos, key, name, value, token, outcome, holder): each claim of a verified identifier, granted or refused.

    claims: (id, pos, key, name, value, completing), in order of pos, then id; records: (key, ord, source, canonical,
    blocked, doi, arxiv_id, inspire_record_id, paper_id), ord distinct, `canonical` the record that stands for an absorbed
    one, else null; reservations: (name, token, key). The first that holds decides: refused-missing; refused-blocked (a record
    that is merging or absorbed, unless the claim completes a dispatched attempt of one that is not absorbed);
    refused-empty; refused-reserved (for another record); refused-held-by-other, with the holder; already-mine;
    refused-existing (the record has another value); else adopted. Nothing held is overwritten, and no identifier gets a second
    owner. A claim without a key is refused-missing, one of another name than NAMES refused-empty.
    """
    blank = F.lit(None).cast(records.schema["key"].dataType)
    own = records.select("key", F.lit(True).alias("_there"), "source", F.coalesce("canonical", "key").alias("_stands"), F.coalesce("blocked", F.lit(False)).alias("_blocked"))
    rows = claims.select("id", F.col("pos").cast("long").alias("pos"), "key", "name", _text(F.col("value")).alias("value"), F.coalesce("completing", F.lit(False)).alias("_completing")).join(own, "key", "left")
    rows = rows.withColumn("token", F.coalesce(identifier_token(F.col("name"), F.col("value"), F.col("source")), F.lit("")))
    held = _held(records)
    mine = held.select("key", "name", F.col("token").alias("_mine"))
    kept = reservations.groupBy("name", "token").agg(F.min("key").alias("_r1"), F.max("key").alias("_r2"))
    rows = rows.join(mine, ["key", "name"], "left").join(_owners(held, "name", "token"), ["name", "token"], "left").join(kept, ["name", "token"], "left")
    absorbed = F.col("_stands") != F.col("key")
    early = (
        F.when(F.col("_there").isNull(), "refused-missing").when(absorbed | F.col("_blocked") & ~F.col("_completing"), "refused-blocked")
        .when(F.col("token") == "", "refused-empty").when((F.col("_r1") != F.col("key")) | (F.col("_r2") != F.col("key")), "refused-reserved")
        .when(F.col("owner") != F.col("key"), "refused-held-by-other").when(F.col("_mine") == F.col("token"), "already-mine")
    )
    rows = saved(rows.withColumns({"_early": early, "_at": F.struct("pos", "id")}), "claims")
    won = granted(rows.where("_early IS NULL AND _mine IS NULL").select("name", "key", "token", F.col("_at").alias("pos")))
    by_token = won.select("name", "token", F.col("key").alias("_to"), F.col("pos").alias("_to_pos"))
    by_key = won.select("name", "key", F.col("token").alias("_got"), F.col("pos").alias("_got_pos"))
    rows = rows.join(by_token, ["name", "token"], "left").join(by_key, ["name", "key"], "left")
    taken = (F.col("_to") != F.col("key")) & (F.col("_to_pos") < F.col("_at"))
    late = F.when(taken, "refused-held-by-other").when(F.col("_mine").isNotNull(), "refused-existing").when(F.col("_got_pos") == F.col("_at"), "adopted").when(F.col("_got") == F.col("token"), "already-mine").otherwise("refused-existing")
    outcome = F.coalesce("_early", late)
    holder = F.when(outcome == "refused-held-by-other", F.coalesce("owner", "_to")).otherwise(blank)
    return rows.select("id", "pos", "key", "name", "value", "token", outcome.alias("outcome"), holder.alias("holder"))


def adopted_records(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """The records with the values that adopted() granted in their blanks."""
    got = decisions.where("outcome = 'adopted'").groupBy("key").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"_{n}") for n in NAMES])
    filled = {n: F.coalesce(f"_{n}", n) for n in NAMES}
    return records.join(got, "key", "left").select(*[filled[c].alias(c) if c in filled else c for c in records.columns])


def dois_resolved(claims: DataFrame, records: DataFrame) -> DataFrame:
    """(id, pos, key, doi, outcome, detail): DOIs found by title for stubs without one, in the order of pos.

    claims: (id, pos, key, doi), in order of pos, then id; records: (key, ord, doi, canonical, merging). The first that holds decides:
    no_paper; alias (the record is absorbed, detail the one that stands for it); merge_waiting (its merge is under way);
    has_doi (never overwritten, detail the DOI); no_paper with detail 'empty doi'; merge_waiting with the holder, whose
    merge is under way; collision with another holder, which absorbs the stub; else set. A record that stands for others
    is taken to hold a DOI if one of them does, as blanks are filled when they merge.

    A stub is decided by its first claim that does not wait: it then has a DOI or is absorbed. A holder is never
    absorbed, as only stubs without a DOI are. So the first stub claim of a DOI without a holder sets it, and no rounds
    are needed.
    """
    stub = records.select("key", F.lit(True).alias("_there"), F.coalesce("canonical", "key").alias("_stands"), F.coalesce("merging", F.lit(False)).alias("_merging"), F.trim(_text(F.col("doi"))).alias("_doi"))
    rows = claims.select("id", F.col("pos").cast("long").alias("pos"), "key", F.trim(_text(F.col("doi"))).alias("doi")).withColumn("_token", F.lower(normalize_doi(F.col("doi")))).join(stub, "key", "left")
    held = records.select("ord", F.coalesce("canonical", "key").alias("stands"), F.lower(normalize_doi(F.col("doi"))).alias("token"))
    owners = _owners(held, "token").join(records.select(F.col("key").alias("owner"), F.coalesce("merging", F.lit(False)).alias("_waits")), "owner", "left").select(F.col("token").alias("_token"), "owner", "_waits")
    rows = rows.join(owners, "_token", "left")
    free = F.col("_there") & (F.col("_stands") == F.col("key")) & ~F.col("_merging") & (F.col("_doi") == "")
    other = F.col("owner").isNotNull() & (F.col("owner") != F.col("key"))
    acts = F.coalesce(free & (F.col("doi") != "") & ~(other & F.coalesce("_waits", F.lit(False))), F.lit(False))
    rows = saved(rows.withColumns({"_acts": acts, "_order": F.struct("pos", "id")}), "claims")
    first = rows.where("_acts").groupBy("key").agg(F.min(F.struct(F.col("_order").alias("pos"), "doi", "_token", "owner")).alias("f"))
    setters = first.where("f.owner IS NULL").groupBy("f._token").agg(F.min(F.struct(F.col("f.pos").alias("pos"), "key")).alias("s"))
    fate = first.join(setters, F.col("f._token") == F.col("_token"), "left").select("key", F.col("f.pos").alias("_at"), F.col("f.doi").alias("_set"), F.coalesce("f.owner", "s.key").alias("_to"))
    rows = rows.join(fate, "key", "left")
    after, kept = F.col("_order") > F.col("_at"), F.col("_to") == F.col("key")
    cases = [
        (F.col("_there").isNull(), "no_paper", F.lit("")), (F.col("_stands") != F.col("key"), "alias", F.col("_stands")), (F.col("_merging"), "merge_waiting", F.lit("")),
        (F.col("_doi") != "", "has_doi", F.col("_doi")), (after & kept, "has_doi", F.col("_set")), (after, "alias", F.col("_to")),
        (F.col("doi") == "", "no_paper", F.lit("empty doi")), (~F.col("_acts"), "merge_waiting", F.col("owner")), (kept, "set", F.col("doi")),
    ]
    outcome, detail = F.lit("collision"), F.col("_to").cast("string")
    for test, name, told in reversed(cases):
        outcome, detail = F.when(test, name).otherwise(outcome), F.when(test, told.cast("string")).otherwise(detail)
    return rows.select("id", "pos", "key", "doi", outcome.alias("outcome"), detail.alias("detail"))


def resolved_records(records: DataFrame, decisions: DataFrame, fills: tuple[str, ...] = ()) -> DataFrame:
    """The records after dois_resolved(): DOIs set, stubs that collided standing under their holder, which takes from them, in order, what it lacks of `fills`."""
    put = decisions.where("outcome = 'set'").select("key", F.col("doi").alias("_doi"))
    gone = decisions.where("outcome = 'collision'").select("key", "pos", F.col("detail").alias("_to"))
    kinds = {f.name: f.dataType for f in records.schema.fields}
    gone = gone.withColumn("_to", F.col("_to").cast(kinds["key"]))
    brought = gone.join(records.select("key", *fills), "key").groupBy(F.col("_to").alias("key")).agg(F.lit(True).alias("_takes"), *[F.min_by(f, F.when(_text(F.col(f)) != "", F.col("pos"))).alias(f"_{f}") for f in fills])
    rows = records.join(put, "key", "left").join(gone.select("key", "_to"), "key", "left").join(brought, "key", "left")
    new = {"doi": F.coalesce("_doi", "doi"), "canonical": F.coalesce("_to", "canonical")} | {f: F.when(_text(F.col(f)) != "", F.col(f)).otherwise(F.coalesce(f"_{f}", f)) for f in fills}
    return rows.select(*[new[c].alias(c) if c in new else c for c in records.columns])
