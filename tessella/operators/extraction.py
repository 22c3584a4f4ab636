"""Typed mentions and relations from normalized documents, by rules of each source, as column expressions.

A document becomes an array of assertions (src, rel, dst with their types); every mention of a document hangs off at
least one assertion or stands alone with rel null. Exploding that array gives both tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.sources import documents as D

#: The organization whose own addresses make nobody external, and that accounts are customers of.
HOME = "home"
# Words that decide what kind of thing a surface form is.
ROLES = (
    "ae", "se", "pm", "em", "sre", "csm", "am", "swe", "ta", "tam", "support", "oncall", "on-call", "runtime oncall", "sales", "security", "eng",
    "engineering", "ops", "legal", "finance", "procurement",
)
BOT = r"(?i)(?:^|[-_ ])bot\b|bot$|incidentbot|opsplaybot"
ORGANIZATION = r"(?i)\b(labs?|bank|inc|inc\.|llc|ltd|corp|co|group|systems?|health|technologies|tech|ai|software|solutions|partners|capital|financial|security|networks?|cloud|data|analytics|robotics|bio|pharma)\b"
JUNK = (
    "recent activity", "recent", "activity", "timeline", "profile", "customer", "customers", "team", "attendees", "unknown", "n/a", "na", "tbd", "someone",
    "everyone", "all", "here", "channel", "thread", "auto-summary",
)
PERSON_NAME = r"^[A-Z][A-Za-z.'\-]+(?:\s+[A-Z][A-Za-z.'\-]+){0,3}$"
HANDLE = r"^[a-z][\w.\-]{1,30}$"
OWNER, TEAM_OWNER = r"[Oo]wner:\s*([A-Z][A-Za-z.'\- ]{1,40})", r"[Oo]wner:\s*([A-Za-z][\w\- ]{1,40})"
FIXES = r"(?i)(?:fix(?:es|ed)?|close[sd]?|resolve[sd]?)\s+((?:SUP|TRACK|OPS|DOC|ENG|INFRA|SEC)-\d+)"

RELATIONS = tuple("SENT RECEIVED WORKS_FOR POSTED_IN MEMBER_OF MENTIONS HAS_ROLE PART_OF REFERENCES RELATES_TO OWNS RESOLVES ABOUT INVOLVES PARTICIPATED_IN ACTION_ITEM CUSTOMER_OF".split())
_ASSERTION = "array<struct<src:string,src_type:string,rel:string,dst:string,dst_type:string,evidence:string>>"


def classify(surface: Column, people: bool = True) -> Column:
    """The entity type of a surface form, or null."""
    t = F.trim(F.coalesce(surface, F.lit("")))
    low = F.lower(t)
    junk = low.isin(*JUNK, *D.LABELS) | (F.length(low) < 2)
    out = F.when(junk, F.lit(None).cast("string")).when(t.rlike(f"^{T.EMAIL}$"), "alias").when(low.rlike(BOT), "bot").when(low.isin(*ROLES), "role")
    out = out.when((F.size(F.split(t, r"\s+")) >= 2) & t.rlike(ORGANIZATION), "organization")
    return out.when(t.rlike(PERSON_NAME) | t.rlike(HANDLE), "person") if people else out


def is_name(surface: Column) -> Column:
    low = F.lower(surface)
    return surface.rlike(PERSON_NAME) & ~low.isin(*JUNK, *D.LABELS, *ROLES)


def _one(src: Column, src_type: Column | str, rel: str | Column | None, dst: Column | None, dst_type: Column | str | None, evidence: Column | str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(src.alias("src"), lit(src_type).alias("src_type"), lit(rel).alias("rel"), lit(dst).alias("dst"), lit(dst_type).alias("dst_type"), F.substring(lit(evidence), 1, 300).alias("evidence"))


def _all(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all("body", F.lit(pattern), F.lit(group))


def _cat(*parts: Column) -> Column:
    return F.concat(*(p.cast(_ASSERTION) for p in parts))


def _references(doc: Column) -> Column:
    """Tickets with their projects, pull requests and meetings that a document names."""
    blob = F.concat_ws("\n", F.col("raw_metadata")["cross_refs"], F.col("raw_metadata")["slug"], "body")
    tickets = F.flatten(F.transform(T.ticket_ids(blob), lambda t: F.array(_one(doc, "document", "REFERENCES", t, "ticket", F.concat(F.lit("cross-ref "), t)), _one(t, "ticket", "PART_OF", T.project_of(t), "project"))))

    def named(ids: Column, kind: str) -> Column:
        return F.transform(ids, lambda x: _one(doc, "document", "REFERENCES", x, kind, F.concat(F.lit("cross-ref "), x)))

    return _cat(tickets, named(T.pull_request_ids(blob), "pull_request"), named(T.meeting_ids(blob), "meeting"))


def _roles(rel: str | None, to: Column | None, to_type: str | None) -> Column:
    """People and roles of `X (Y):` and `Name (ROLE)`; each person also stands in rel to something, if given."""
    pair = lambda p: F.arrays_zip(_all(p, 1).alias("x"), _all(p, 2).alias("y"))
    trimmed = F.transform(pair(D.PAREN), lambda p: F.struct(F.trim(p["x"]).alias("x"), F.trim(p["y"]).alias("y")))
    swap = lambda p: is_name(p["y"]) & ~is_name(p["x"])
    chosen = F.transform(F.filter(trimmed, lambda p: is_name(p["x"]) | is_name(p["y"])), lambda p: F.struct(F.when(swap(p), p["y"]).otherwise(p["x"]).alias("who"), F.when(swap(p), p["x"]).otherwise(p["y"]).alias("role")))
    kept = F.transform(chosen, lambda p: F.struct(p["who"].alias("who"), F.when(F.lower(p["role"]).isin(*ROLES), p["role"]).alias("role")))
    inline = F.transform(pair(D.INLINE_ROLE), lambda p: F.struct(F.trim(p["x"]).alias("who"), F.trim(p["y"]).alias("role")))
    people = F.concat(kept, inline)
    out = F.transform(people, lambda p: _one(p["who"], "person", F.when(p["role"].isNotNull(), "HAS_ROLE"), p["role"], F.when(p["role"].isNotNull(), "role"), F.concat(p["who"], F.lit(" ("), p["role"], F.lit(")"))))
    return _cat(out, F.transform(people, lambda p: _one(p["who"], "person", rel, to, to_type))) if rel else out


def _mail(doc: Column) -> Column:
    def of(field: str, rel: str) -> list[Column]:
        value = F.coalesce(F.col("raw_metadata")[field], F.lit(""))
        name, addr, bare = (F.regexp_extract_all(value, F.lit(D.ADDRESS), F.lit(i)) for i in (1, 2, 3))
        who = F.transform(F.arrays_zip(name.alias("n"), addr.alias("a"), bare.alias("b")), lambda x: F.struct(_header_name(F.coalesce(F.nullif(F.trim(x["n"]), F.lit("")), F.nullif(F.trim(x["a"]), F.lit("")), F.trim(x["b"]))).alias("name"), F.trim(F.concat(x["a"], x["b"])).alias("mail")))
        who = F.filter(who, lambda x: x["name"] != "")
        outside = F.filter(who, lambda x: (x["mail"] != "") & ~T.email_domain(x["mail"]).contains(HOME))
        return [F.transform(who, lambda x: _one(x["name"], "person", rel, doc, "document", field)), F.transform(outside, lambda x: _one(x["name"], "person", "WORKS_FOR", T.organization_of(x["mail"]), "organization", x["mail"]))]

    return _cat(*of("from", "SENT"), *of("to", "RECEIVED"), *of("cc", "RECEIVED"))


def _header_name(name: Column) -> Column:
    flat = F.regexp_replace(name, r"\\[nrt]|[\n\r\t]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"(?i)^\s*(?:from|to|cc|bcc)\s*:\s*", ""), r"(?i)\s+(?:from|to|cc|bcc)\s*:.*$", ""))


def _chat(doc: Column) -> Column:
    channel = F.coalesce(F.col("raw_metadata")["channel"], F.col("title"))
    kind = lambda n: F.when(F.lower(n).rlike(BOT), "bot").otherwise("person")
    lines = F.transform(F.arrays_zip(_all(D.SPEAKER, 1).alias("who"), _all(D.SPEAKER, 2).alias("team")), lambda x: F.struct(F.trim(x["who"]).alias("who"), F.trim(x["team"]).alias("team")))
    posted = F.transform(F.array_distinct(F.transform(lines, lambda x: x["who"])), lambda n: _one(n, kind(n), "POSTED_IN", channel, "channel"))
    member = F.transform(F.filter(lines, lambda x: (x["team"] != "") & (kind(x["who"]) == "person")), lambda x: _one(x["who"], "person", "MEMBER_OF", x["team"], "team", F.concat(x["who"], F.lit(" ("), x["team"], F.lit(")"))))
    named = F.transform(F.array_distinct(_all(T.MENTION)), lambda h: _one(doc, "document", "MENTIONS", h, kind(h), F.concat(F.lit("@"), h)))
    return _cat(F.array(_one(channel, "channel", None, None, None)), posted, member, named)


def _own(slug: Column) -> Column:
    return T.ticket_ids(F.coalesce(slug, F.lit("")))


def _work_item(doc: Column, rel_of) -> Column:
    """The tickets that a document is (by its slug), their projects, and how the last of them relates to others it names."""
    own = _own(F.col("raw_metadata")["slug"])
    mine = F.transform(own, lambda t: _one(t, "ticket", "PART_OF", T.project_of(t), "project"))
    anchor = F.try_element_at(own, F.lit(-1))
    blob = F.concat_ws("\n", F.col("raw_metadata")["cross_refs"], F.col("raw_metadata")["slug"], "body")
    others = F.when(anchor.isNotNull(), F.transform(F.array_except(T.ticket_ids(blob), own), lambda t: _one(anchor, "ticket", rel_of(t), t, "ticket", t))).otherwise(F.array().cast(_ASSERTION))
    return _cat(mine, others)


def _organizations(src: Column, src_type: str, rel: str) -> Column:
    named = F.filter(F.coalesce("mention_refs", F.array().cast("array<string>")), lambda r: classify(r) == "organization")
    return F.transform(named, lambda o: _one(src, src_type, rel, o, "organization"))


def _issues(doc: Column) -> Column:
    anchor = F.try_element_at(_own(F.col("raw_metadata")["slug"]), F.lit(-1))
    owners = F.when(anchor.isNotNull(), F.transform(_all(OWNER), lambda o: _one(F.trim(o), "person", "OWNS", anchor, "ticket", F.concat(F.lit("owner: "), F.trim(o))))).otherwise(F.array().cast(_ASSERTION))
    return _cat(_work_item(doc, lambda t: "RELATES_TO"), _references(doc), _roles(None, None, None), owners, _organizations(doc, "document", "MENTIONS"))


def _tasks(doc: Column) -> Column:
    return _cat(_work_item(doc, lambda t: "RELATES_TO"), _references(doc))


def _changes(doc: Column) -> Column:
    number = F.regexp_extract(F.coalesce(F.col("raw_metadata")["slug"], F.lit("")), r"(?i)pr[-#]?(\d+)", 1)
    pull = F.concat(F.lit("PR#"), number)
    blob = F.concat_ws("\n", F.col("raw_metadata")["cross_refs"], F.col("raw_metadata")["slug"], "body")
    fixed = _all(FIXES)
    touched = F.transform(T.ticket_ids(blob), lambda t: _one(pull, "pull_request", F.when(F.array_contains(fixed, t), "RESOLVES").otherwise("RELATES_TO"), t, "ticket", t))
    return _cat(_references(doc), F.when(number != "", touched).otherwise(F.array().cast(_ASSERTION)))


def _meetings(doc: Column) -> Column:
    meeting = F.col("doc_id").cast("string")
    acts = F.arrays_zip(_all(D.ACTION, 1).alias("org"), _all(D.ACTION, 2).alias("who"))
    items = F.transform(acts, lambda a: _one(F.trim(a["who"]), "person", "ACTION_ITEM", doc, "document", F.concat_ws(" ", a["org"], a["who"])))
    orgs = F.transform(acts, lambda a: _one(meeting, "meeting", "INVOLVES", F.trim(a["org"]), "organization"))
    return _cat(F.array(_one(doc, "document", "ABOUT", meeting, "meeting")), _organizations(meeting, "meeting", "INVOLVES"), _roles("PARTICIPATED_IN", meeting, "meeting"), items, orgs)


def _accounts(doc: Column) -> Column:
    account = F.trim(F.regexp_replace("title", r"(?i)^\s*company\s+", ""))
    return _cat(F.array(_one(doc, "document", "ABOUT", account, "organization"), _one(account, "organization", "CUSTOMER_OF", F.lit(HOME), "organization")), _roles("WORKS_FOR", account, "organization"), _references(doc))


def _pages(doc: Column) -> Column:
    return _cat(F.transform(_all(TEAM_OWNER), lambda o: _one(F.trim(o), "team", "OWNS", doc, "document", F.concat(F.lit("Owner: "), F.trim(o)))), _references(doc))


RULES = {"gmail": _mail, "slack": _chat, "jira": _issues, "linear": _tasks, "github": _changes, "fireflies": _meetings, "hubspot": _accounts, "confluence": _pages, "google_drive": _pages}


def assertions(docs: DataFrame) -> DataFrame:
    """doc_id, source_type, timestamp, ord and an assertion for each that the rules of a document's source find.

    ord orders assertions by source, document and place. Documents of other sources give their own mention alone.
    """
    doc = F.coalesce(F.nullif("title", F.lit("")), F.col("doc_id").cast("string"))
    by_source = reduce(lambda out, kv: out.when(F.col("source_type") == kv[0], kv[1](doc).cast(_ASSERTION)), RULES.items(), F.when(F.lit(False), F.array().cast(_ASSERTION)))
    every = F.concat(F.array(_one(doc, "document", None, None, None, F.substring("title", 1, 120))).cast(_ASSERTION), F.coalesce(by_source, F.array().cast(_ASSERTION)))
    flat = docs.select("doc_id", "source_type", "timestamp", F.posexplode(every).alias("place", "a")).select("doc_id", "source_type", "timestamp", "place", "a.*")
    ordinal = F.concat_ws("\x1f", "source_type", F.col("doc_id").cast("string"), F.lpad(F.col("place").cast("string"), 8, "0"))
    return flat.where("src IS NOT NULL AND trim(src) <> ''").withColumn("ord", ordinal)


def mention_id(doc_id: Column, kind: Column, surface: Column) -> Column:
    return T.mint_id("m", doc_id, kind, surface)


def mentions(found: DataFrame) -> DataFrame:
    """mention_id, doc_id, source_type, surface_form, entity_type, timestamp, ord: a bag, as often as it is asserted."""
    ends = [found.select("doc_id", "source_type", "timestamp", F.trim(s).alias("surface_form"), F.col(f"{s}_type").alias("entity_type"), F.concat("ord", F.lit(k)).alias("ord")) for k, s in (("0", "src"), ("1", "dst"))]
    both = ends[0].unionByName(ends[1]).where("surface_form <> '' AND entity_type IS NOT NULL")
    return both.withColumn("mention_id", mention_id(F.col("doc_id"), F.col("entity_type"), F.col("surface_form")))


def relations(found: DataFrame) -> DataFrame:
    """relation_id, src_mention_id, dst_mention_id, rel, doc_id, source, stated_at, evidence, confidence, ord."""
    linked = found.where(F.col("rel").isin(*RELATIONS) & F.col("dst").isNotNull() & (F.trim("dst") != ""))
    src, dst = (mention_id(F.col("doc_id"), F.col(f"{s}_type"), F.trim(s)) for s in ("src", "dst"))
    return linked.select(T.mint_id("r", src, F.col("rel"), dst).alias("relation_id"), src.alias("src_mention_id"), dst.alias("dst_mention_id"), "rel", "doc_id", F.col("source_type").alias("source"), F.col("timestamp").alias("stated_at"), "evidence", F.lit(1.0).alias("confidence"), "ord")
