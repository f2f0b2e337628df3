"""Text functions on columns.

White space means the wide class of the web's scripting language (it includes no-break spaces
and the byte order mark). Word boundaries are ASCII boundaries. Both are spelt out, so that
the results do not depend on the engine's defaults.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the wide white-space class.
SPACE = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Legal forms at the end of a company's name.
LEGAL_FORMS = ("limited", "ltd", "incorporated", "inc", "llc", "plc", "corporation", "corp", "company", "co")
#: Words that carry no meaning in a query.
STOP_WORDS = ("a", "an", "and", "are", "at", "currently", "find", "for", "in", "of", "on", "or", "the", "to", "with")
#: Phrases of a signal that says the opposite.
NEGATIVE_PHRASES = ("not hiring", "no longer hiring", "position filled", "applications closed", "hiring freeze", "hiring paused")
#: Phrases of pages that withhold their content.
RESTRICTED_PHRASES = ("captcha", "verify you are human", "access denied", "sign in to continue", "subscribe to continue", "disable your ad blocker")
#: Words of evidence that speak of hiring.
HIRING_VERBS = ("hiring", "hire", "seeking", "recruiting", "opening", "vacancy", "apply")


def word(alternatives: tuple[str, ...]) -> str:
    """A pattern for whole words, with ASCII boundaries."""
    return f"(?<![A-Za-z0-9_])(?:{'|'.join(alternatives)})(?![A-Za-z0-9_])"


def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else v if v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def nfkc(column: Column) -> Column:
    """Unicode form NFKC. ASCII values never leave the JVM's result: Python sees the others only."""
    plain = column.rlike(r"^\p{ASCII}*$")
    return F.when(column.isNull() | plain, column).otherwise(F.arrow_udf(_nfkc, "string")(F.when(~plain, column)))


def trimmed(column: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(column, f"^{SPACE}+|{SPACE}+$", "")


def squeezed(column: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(column, f"{SPACE}+", " "))


def collapsed(column: Column) -> Column:
    """NFKC, then squeezed."""
    return squeezed(nfkc(column))


def matching(column: Column) -> Column:
    """The form in which values are compared: lower case, letters, numbers and + # . apart by one space."""
    lower = F.lower(collapsed(column))
    return F.trim(F.regexp_replace(F.regexp_replace(lower, "&", " and "), r"[^\p{L}\p{N}+#.]+", " "))


def company_name(column: Column) -> Column:
    """Comparable company name without its legal forms."""
    base = F.trim(F.regexp_replace(matching(column), r" and company$", ""))
    return F.trim(F.regexp_replace(base, rf"(?: *{word(LEGAL_FORMS)}\.? *)+$", ""))


def role_name(column: Column) -> Column:
    """Comparable role: ranks spelt out, the spellings of backend engineers joined; null is empty."""
    base = F.regexp_replace(matching(column), word(("sr", "snr")), "senior")
    base = F.regexp_replace(F.regexp_replace(base, word(("jr",)), "junior"), word(("back end",)), "backend")
    rank = F.regexp_extract(base, f"({word(('senior', 'junior', 'lead', 'principal'))})", 1)
    backend = base.rlike(word(("backend",))) & base.rlike(word(("developer", "software engineer", "engineer")))
    return F.when(column.isNull(), "").when(backend, F.trim(F.concat(rank, F.lit(" backend engineer")))).otherwise(base)


def place_name(column: Column) -> Column:
    """Comparable location; null is empty."""
    return F.coalesce(matching(column), F.lit(""))


def tokens(column: Column) -> Column:
    """Distinct words of two characters or more that are no stop words, in order."""
    parts = F.split(F.lower(nfkc(column)), r"[^\p{L}\p{N}+#.]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS)))


def jaccard(left: Column, right: Column) -> Column:
    """Shared words of two comparable texts by all their words; two empty texts are equal."""
    a = F.filter(F.split(left, " "), lambda t: t != "")
    b = F.filter(F.split(right, " "), lambda t: t != "")
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def negative(signal: Column) -> Column:
    """Whether a comparable signal says that nobody is hired."""
    return signal.rlike(word(NEGATIVE_PHRASES))


def restricted(text: Column) -> Column:
    """Whether a page withholds its content."""
    return text.rlike("(?i)" + word(RESTRICTED_PHRASES))


def meaningful(text: Column, least: int = 200) -> Column:
    """Whether a text has at least ``least`` characters that are no white space."""
    return utf16_length(F.regexp_replace(text, SPACE, "")) >= least


def readable(text: Column) -> Column:
    """Lines squeezed, without empty ones and without repetitions (case aside), the first of each kept in order."""
    lines = F.filter(F.transform(F.split(text, r"\n+"), squeezed), lambda x: x != "")
    # a one-element array binds the lines to a name, so that no line is made twice
    bound = F.transform(F.array(lines), lambda ls: F.struct(ls.alias("lines"), F.transform(ls, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("i"))).alias("keys")))

    def first_ones(b: Column) -> Column:
        # sorted by key and then by place, the first of each key differs from the one before: n log n, not each with each
        by_key = F.transform(F.array(F.array_sort(b["keys"])), lambda ks: F.filter(ks, lambda s, k: (k == 0) | (F.get(ks, k - 1)["key"] != s["key"])))
        places = F.array_sort(F.transform(F.get(by_key, F.lit(0)), lambda s: s["i"]))
        return F.array_join(F.transform(places, lambda i: F.get(b["lines"], i)), "\n")

    return F.get(F.transform(bound, first_ones), F.lit(0))


def csv_field(column: Column) -> Column:
    """A CSV field: formulas are disarmed, quotes doubled where quoting is needed; null is empty."""
    value = F.coalesce(column.cast("string"), F.lit(""))
    safe = F.when(value.rlike("^[\\t \\r]*[=+\\-@]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(safe.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def media_type(column: Column) -> Column:
    """A content type without its parameters."""
    return F.lower(trimmed(F.split_part(column, F.lit(";"), F.lit(1))))


def listed(column: Column) -> Column:
    """Entries of a list typed with commas or line ends."""
    return F.filter(F.transform(F.split(column, r"\r?\n|,"), trimmed), lambda v: v != "")


def attribute_escaped(column: Column) -> Column:
    """Text inside an HTML attribute."""
    out = column
    for sign, name in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def iso_time(column: Column) -> Column:
    """A time in UTC as ISO text with milliseconds."""
    return F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utf16_length(column: Column) -> Column:
    """Length in UTF-16 units: signs beyond the basic plane count twice."""
    return F.shiftright(F.octet_length(F.encode(column, "UTF-16BE")), 1)


def with_base(html: Column, url: Column) -> Column:
    """A page with a base tag at the start of its head, or in front of it where it has none."""
    tag = F.concat(F.lit('<base href="'), attribute_escaped(url), F.lit('">'))
    at = F.regexp_instr(html, F.lit(r"(?i)<head(?:\s[^>]*)?>"))
    head = F.regexp_extract(html, r"(?i)(<head(?:\s[^>]*)?>)", 1)
    return F.when(at > 0, F.concat(F.left(html, at + F.length(head) - 1), tag, F.substr(html, at + F.length(head)))).otherwise(F.concat(tag, html))
