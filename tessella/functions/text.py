"""Text, identifier and date expressions; all of them stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide which surface forms are found.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
TICKET = r"\b((?:SUP|TRACK|OPS|DOC|ENG|INFRA|SEC)-\d+)\b"
PULL_REQUEST = r"(?i)\bPR\s*#(\d+)\b"
MEETING = r"\b(ff_\d{8}_[0-9a-f]+)\b"
LOOSE_MEETING = r"\b(ff_\d{6,8}_[0-9a-f]+)\b"
ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::\d{2})?)?Z?\b"
MENTION = r"(?<![\w@])@([A-Za-z][\w.\-]{1,30})"
DOC_FILE = r"(?i)^(dsid_[0-9a-f]{32})__(.+)\.txt$"
QUERY_TERM = r"[A-Za-z0-9][A-Za-z0-9_.-]*"
WORD = r"[\p{L}\p{N}]+"

# Words that carry no meaning in a query; rankings depend on them.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were", "be", "been", "what", "which", "who", "whom", "whose",
    "when", "where", "why", "how", "did", "does", "do", "with", "that", "this", "it", "at", "by", "from", "as", "we", "our", "us",
)

#: Latin letters with marks and what is left of them without, by decomposition.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if len(b := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1 and b != c]
_PLAIN = "".join("".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in _MARKED)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ordered_distinct(values: Column, limit: int = 200) -> Column:
    """Trimmed, not empty, each once, in order, `limit` at most (a cap on references that is part of the format)."""
    trimmed = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(trimmed), 1, limit)


def emails(text: Column) -> Column:
    return _all(text, EMAIL)


def email_local(text: Column) -> Column:
    """The part before the @ of the first address, lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(text, r"([\w.+-]+)@[\w-]+\.[\w.-]+", 1)), F.lit(""))


def email_domain(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"@([\w.\-]+)", 1))


def title_case(text: Column) -> Column:
    """A capital after every non-letter, other letters lower."""
    parts = _all(F.lower(text), r"[a-z]+|[^a-z]+")
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def organization_of(address: Column) -> Column:
    """The first label of an address's domain as a name."""
    return title_case(F.substring_index(email_domain(address), ".", 1))


def plain_latin(text: Column) -> Column:
    """Latin letters without their marks, and no combining marks."""
    return F.regexp_replace(F.translate(text, "".join(_MARKED), _PLAIN), r"\p{M}+", "")


def normalize_name(text: Column) -> Column:
    """Lower case without marks; other than letters, digits and @._+- are one space."""
    return F.trim(F.regexp_replace(F.lower(plain_latin(F.coalesce(text, F.lit("")))), r"[^a-z0-9@._+\-]+", " "))


def surname(name: Column) -> Column:
    """The last word of a normalized name; null if empty."""
    return F.nullif(F.element_at(F.split(name, " "), -1), F.lit(""))


def handle_stem(text: Column) -> Column:
    """The first word of a handle without @ or what follows ( or :; dots separate words; null if empty."""
    bare = F.regexp_extract(F.regexp_replace(F.trim(text), "^@+", ""), r"^([^(:]*)", 1)
    return F.nullif(F.substring_index(F.trim(F.translate(normalize_name(bare), ".", " ")), " ", 1), F.lit(""))


def name_locals(name: Column) -> Column:
    """The local parts that a name of two or more words suggests."""
    words = F.split(name, " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    made = F.array(F.concat(first, F.lit("."), last), F.concat(first, F.lit("_"), last), F.concat(first, last), F.concat(F.substring(first, 1, 1), last), F.concat(first, F.substring(last, 1, 1)))
    return F.when(F.size(words) >= 2, made).otherwise(F.array().cast("array<string>"))


def mint_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the sha1 of the parts, joined by U+001F; a null part is empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 16))


def surrogate_id(text: Column) -> Column:
    """A stable 62-bit number, never negative."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("decimal(20,0)") % F.lit(1 << 62).cast("decimal(20,0)")


def first_date(text: Column) -> Column:
    """The first ISO date, with hours and minutes if given; null if it is no date."""
    day, clock = F.regexp_extract(text, ISO_DATE, 1), F.regexp_extract(text, ISO_DATE, 2)
    stamp = F.concat(day, F.lit(" "), F.when(clock == "", "00:00").otherwise(clock))
    return F.when(day != "", stamp).try_cast("timestamp_ntz")


def header_date(value: Column) -> Column:
    """A mail header's date as wall-clock time: weekday and zone are dropped."""
    bare = F.regexp_extract(value, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?)", 1)
    full = F.when(bare.rlike(r":\d{2}:"), bare).otherwise(F.concat(bare, F.lit(":00")))
    return F.when(bare != "", F.try_to_timestamp(full, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz"))


def cross_references(text: Column, limit: int = 60) -> Column:
    """Tickets, pull requests and meetings named in a text, in that order, as one string."""
    pulls = F.transform(_all(text, PULL_REQUEST, 1), lambda n: F.concat(F.lit("PR#"), n))
    return F.array_join(ordered_distinct(F.concat(_all(text, TICKET, 1), pulls, _all(text, MEETING, 1)), limit), ",")


def ticket_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, TICKET, 1)))


def pull_request_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(text, PULL_REQUEST, 1), lambda n: F.concat(F.lit("PR#"), n))))


def meeting_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, LOOSE_MEETING, 1)))


def project_of(ticket: Column) -> Column:
    return F.upper(F.substring_index(ticket, "-", 1))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return _all(F.lower(F.coalesce(text, F.lit(""))), WORD)


def query_terms(text: Column) -> Column:
    """A query's distinct terms in order: lower case, without stop words and single characters, unless nothing else is there."""
    found = F.transform(_all(F.coalesce(text, F.lit("")), QUERY_TERM), lambda t: F.lower(t))
    useful = F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))
    return F.array_distinct(F.when(F.size(useful) > 0, useful).otherwise(found))


def match_expression(text: Column) -> Column:
    """The quoted terms of a query, any of which may match."""
    return F.array_join(F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def is_identifier(text: Column) -> Column:
    """Safe as a label."""
    return F.coalesce(text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def caption(text: Column, width: int) -> Column:
    """At most `width` characters, cut back to a whole word, with an ellipsis if cut."""
    cut = F.regexp_replace(F.substring(text, 1, width), r"\s+\S*$", "")
    return F.when(F.length(text) <= width, text).otherwise(F.concat(cut, F.lit("…")))


def json_inside(text: Column) -> Column:
    """The first {…} or […] of a text with fences or talk around it; null if none."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("–")).otherwise(F.format_string("%.1f%%", 100 * value))
