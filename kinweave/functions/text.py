"""Native column expressions for keys, labels and normalised text. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The legal suffixes that end a company name.
COMPANY_SUFFIXES = [
    "inc",
    "incorporated",
    "llc",
    "l.l.c",
    "ltd",
    "limited",
    "corp",
    "corporation",
    "co",
    "company",
    "gmbh",
    "plc",
    "lp",
    "llp",
    "sa",
    "ag",
]

# Addresses that no person reads.
NON_HUMAN_SUBSTRINGS = [
    "no-reply",
    "noreply",
    "no.reply",
    "donotreply",
    "do-not-reply",
    "do_not_reply",
    "mailer-daemon",
    "mailerdaemon",
    "postmaster",
    "bounce",
    "notifications",
    "notification",
    "automated",
    "auto-confirm",
    "listserv",
    "majordomo",
    "+unsubscribe",
    "-unsubscribe",
    "-request",
]
NON_HUMAN_PREFIXES = ["calendar-", "calendar+", "calendar."]
NON_HUMAN_EXACT = ["calendar", "mailer-daemon", "postmaster"]
NON_HUMAN_DOMAIN_PREFIXES = ["bounce.", "bounces.", "mailer."]

# Java's \s and trim() know fewer blanks than the sources contain, so the class is spelt out.
BLANK = r"[\s\x1c-\x1f]"

KEY_SEPARATOR = "#"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quoted(words: list[str]) -> str:
    return "|".join("\\Q" + w + "\\E" for w in words)


def strip(c: Column | str) -> Column:
    """Without the blanks around it. A text between two visible ASCII characters has none, which needs no pattern."""
    text = _col(c)
    inked = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(inked, text).otherwise(F.regexp_replace(text, f"(?U)^{BLANK}+|{BLANK}+$", ""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def normalize_email(email: Column | str) -> Column:
    return blank_to_null(F.lower(strip(email)))


def is_non_human(email: Column | str, own: Column | None = None) -> Column:
    """True for automated, list and own addresses; an absent address is not one of them.

    ``own`` is an optional boolean column saying that the address is the mailbox owner's.
    """
    address = normalize_email(email)
    local = F.substring_index(address, "@", 1)
    domain = _after_at(address)
    starts = _quoted(NON_HUMAN_PREFIXES)
    inside = _quoted(NON_HUMAN_SUBSTRINGS)
    verdict = (
        local.isin(NON_HUMAN_EXACT)
        | local.rlike(f"^(?:{starts})|(?:{inside})")
        | domain.rlike(f"^(?:{_quoted(NON_HUMAN_DOMAIN_PREFIXES)})")
    )
    if own is not None:
        verdict = F.coalesce(own, F.lit(False)) | verdict
    return F.coalesce(verdict, F.lit(False))


def _after_at(address: Column) -> Column:
    """What follows the first @, '' when there is none."""
    return F.regexp_replace(address, "^[^@]*@?", "")


def normalize_name(name: Column | str) -> Column:
    """Lower-case words joined by single blanks; '' for NULL. Visible ASCII needs no Unicode classes."""
    lower = F.lower(_col(name))
    plain = F.regexp_replace(lower, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", " ")
    ascii_only = F.trim(F.regexp_replace(lower, "[^a-z0-9_]+", " "))
    any_text = strip(F.regexp_replace(plain, f"(?U){BLANK}+", " "))
    return F.coalesce(F.when(lower.rlike("[^ -~]"), any_text).otherwise(ascii_only), F.lit(""))


def normalize_company(company: Column | str) -> Column:
    ending = f"(?:(?:^| )(?:{_quoted(COMPANY_SUFFIXES)}))+$"
    return F.regexp_replace(normalize_name(company), ending, "")


def participant_key(base_id: Column | str, participant: Column | str) -> Column:
    return F.concat_ws(KEY_SEPARATOR, _col(base_id), _col(participant))


def stable_id(url: Column | str, full_name: Column | str, company: Column | str) -> Column:
    seed = F.lower(F.concat(F.coalesce(_col(full_name), F.lit("")), F.lit("|"), F.coalesce(_col(company), F.lit(""))))
    hashed = F.concat(F.lit("linkedin:"), F.substring(F.sha2(seed, 256), 1, 16))
    return F.coalesce(blank_to_null(strip(url)), hashed)


def content_hash(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def headline(name: Column | str, title: Column | str, company: Column | str, email: Column | str) -> Column:
    """``name — title — company`` without the missing parts, else the address, else ''."""
    parts = F.concat_ws(" — ", *[blank_to_null(c) for c in (name, title, company)])
    return F.coalesce(blank_to_null(parts), _col(email), F.lit(""))


def touch_text(kind: str, subject: Column | str, name: Column | str, email: Column | str) -> Column:
    """``Email 'subject' with Name``; ``kind`` is the leading word."""
    who = F.coalesce(blank_to_null(name), _col(email))
    return F.concat(F.lit(f"{kind} '"), _col(subject), F.lit("' with "), who)


def failure_reason(error_type: Column | str, message: Column | str, limit: int = 300) -> Column:
    """Exception type and a cut, one-line message; the record's own text never enters."""
    flat = F.coalesce(strip(F.regexp_replace(_col(message), "\n", " ")), F.lit(""))
    cut = F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)
    return F.concat_ws(": ", _col(error_type), blank_to_null(cut))


def millis_to_timestamp(ms: Column | str) -> Column:
    value = _col(ms).try_cast("bigint")
    in_range = value.between(-62135596800000, 253402300799999)
    return F.timestamp_millis(F.when(in_range, value))


def event_start(start: Column | str) -> Column:
    """dateTime, else date; a bare date is midnight UTC, unreadable text is NULL."""
    node = _col(start)
    raw = F.coalesce(blank_to_null(node["dateTime"]), blank_to_null(node["date"]))
    iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d.*)?$")
    return F.try_to_timestamp(F.when(iso, raw))


def primary_email(emails: Column | str) -> Column:
    """Value of the first entry flagged primary (even a NULL one), else the first value there is."""
    entries = _col(emails)

    def flagged(e: Column) -> Column:
        return F.coalesce(e["metadata"]["primary"], F.lit(False))

    return F.when(
        F.exists(entries, flagged), F.get(F.filter(entries, flagged), F.lit(0))["value"]
    ).otherwise(F.get(F.filter(entries, lambda e: e["value"].isNotNull()), F.lit(0))["value"])


def header_value(headers: Column | str, name: str) -> Column:
    """Value of a header by case-insensitive name; the last duplicate wins."""
    same = F.filter(_col(headers), lambda h: F.lower(F.coalesce(h["name"], F.lit(""))) == name)
    return F.try_element_at(same, F.lit(-1))["value"]


def age_label(then: Column | str, as_of: Column) -> Column:
    seconds = F.unix_micros(as_of.cast("timestamp")) / F.lit(1e6) - F.unix_micros(
        _col(then).cast("timestamp")
    ) / F.lit(1e6)

    def units(size: int, suffix: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(suffix))

    return (
        F.when(seconds.isNull(), "")
        .when(seconds < 90, "just now")
        .when(seconds < 3600, units(60, "m ago"))
        .when(seconds < 86400, units(3600, "h ago"))
        .otherwise(units(86400, "d ago"))
    )


def company_snippet(name: Column | str, title: Column | str, company: Column | str) -> Column:
    return F.concat(
        F.coalesce(blank_to_null(name), F.lit("Unknown")),
        F.lit(" — "),
        F.coalesce(blank_to_null(title), F.lit("role unknown")),
        F.lit(" at "),
        F.coalesce(_col(company), F.lit("None")),
    )


def interaction_snippet(kind: Column | str, occurred_at: Column | str, subject: Column | str) -> Column:
    day = F.coalesce(F.date_format(_col(occurred_at), "yyyy-MM-dd"), F.lit("unknown date"))
    return strip(F.concat(_col(kind), F.lit(" on "), day, F.lit(": "), F.coalesce(_col(subject), F.lit(""))))


def contains_text(column: Column | str, part: Column | str) -> Column:
    """Case-insensitive containment without wildcard meaning in ``part``."""
    return F.contains(F.lower(_col(column)), F.lower(_col(part)))
