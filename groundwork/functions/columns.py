"""Column expressions that several jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as documents have it: ASCII white space, no-break space, ideographic space, BOM.
SPACE = "[\\s\u00a0\u3000\ufeff]"

# fixed values: query parameters that carry tracking or credentials
DROPPED_PARAMETERS = r"(?i)^(utm_|fbclid$|gclid$|ref$|api[_-]?key$|token$|x-amz-|x-goog-)|signature|credential|authorization"
# fixed values: secrets that a report must not repeat
SECRET_PAIR = r"(?i)(access_token|appsecret|secret|token|key)=([^&\s]+)"
SECRET_TOKEN = r"(?<![a-zA-Z0-9_])(?:xox[baprs]-[\w-]+|xapp-[\w-]+|sk-[\w-]{12,})"
NUMBER = r"(?<!\d)[-+]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:[eE][-+]?\d+)?"
PLAIN_NUMBER = r"\d+(?:\.\d+)?"


def collapsed(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def _no_dots(path: Column) -> Column:
    """The path without the segments . and .., which step back over the one before."""
    start = F.expr("array()").cast("array<string>")
    back = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))
    step = lambda a, x: F.when(x == ".", a).when(x == "..", back(a)).otherwise(F.concat(a, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), start, step, lambda a: F.array_join(a, "/"))
    ends = path.rlike(r"/\.\.?$")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(parts, F.when(ends, F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking or credential parameters; null for what
    is not public http(s)."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    part = lambda i: F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(?:\?(.*))?$", i)
    kept = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike(DROPPED_PARAMETERS)), "&")
    path = F.when(part(3) == "", F.lit("/")).otherwise(_no_dots(part(3)))
    port = F.when(F.lower(part(1)) == "https", F.lit(":443$")).otherwise(F.lit(":80$"))
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.regexp_replace(F.lower(part(2)), port, F.lit("")), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(F.lower(part(1)).isin("http", "https") & (part(2) != "") & ~part(2).contains("@"), whole)


def day_or_instant(text: Column) -> Column:
    """(at, precision): an instant where the text has a zone, else its calendar day; null for months,
    years and impossible days."""
    t = F.trim(text)
    day = F.try_to_date(F.regexp_replace(F.regexp_extract(t, r"^(\d{4}[-/]\d{2}[-/]\d{2})", 1), "/", "-"), "yyyy-MM-dd")
    zoned = t.rlike(r"(?i)(?:Z|[+-]\d{2}:?\d{2}|GMT|UTC)$")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]+,\s*", ""), r"(?i)(?:GMT|UTC|Z)$", "+0000"), r"([+-]\d{2}):(\d{2})$", "$1$2")
    named = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    # a zoned instant on an impossible day is no date at all
    instant = F.when(zoned, F.when(t.rlike(r"^\d{4}"), F.when(day.isNotNull(), F.try_to_timestamp(t))).otherwise(named))
    return F.when(instant.isNotNull(), F.struct(instant.alias("at"), F.lit("instant").alias("precision"))).when(day.isNotNull() & ~zoned, F.struct(day.cast("timestamp").alias("at"), F.lit("day").alias("precision")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))


# fixed values: addresses of preprints
ARXIV = r"(?i)^https?://(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5}|[a-z.-]+/\d{7})(v\d+)?(?:\.pdf)?$"


def arxiv_identity(url: Column) -> Column:
    """(base_id, version) of an arXiv abs, pdf or html link; null otherwise."""
    return F.when(url.rlike(ARXIV), F.struct(F.regexp_extract(url, ARXIV, 1).alias("base_id"), F.regexp_extract(url, ARXIV, 2).alias("version")))


def event_identity(url: Column, event_id: Column, doi: Column) -> Column:
    """Identity of an event: arXiv base and version, else the supplied id, else the DOI, else the
    hash of the canonical URL."""
    arxiv = arxiv_identity(url)
    bare = F.regexp_replace(F.lower(doi), r"^https?://(?:dx\.)?doi\.org/", "")
    return F.coalesce(
        F.when(arxiv.isNotNull(), F.concat(F.lit("arxiv:"), arxiv["base_id"], arxiv["version"])), F.when(event_id != "", event_id),
        F.when(bare != "", F.concat(F.lit("doi:"), bare)), F.concat(F.lit("url:"), F.sha2(url, 256)),
    )


# fixed values: number words and months
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_NO_WORD, _NO_MORE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_YEAR = r"(?<!\d)(?:19|20)\d\d(?!\d)"
#: Text within a sentence: no line break, and no white space after a stop.
_WITHIN = r"(?:(?![.!?]\s)[^\n])"


def _coded(found: Column, names: tuple[str, ...], first: int) -> Column:
    """The place of each name in ``names``, counted from ``first``, as text."""
    known = F.create_map(*[F.lit(x) for i, w in enumerate(names) for x in (w.lower(), str(i + first))])
    return F.transform(found, lambda x: F.element_at(known, F.lower(x)))


def month_tokens(text: Column) -> Column:
    """Numbers of months in dates: a month with a year, or with a day and a year near it in the same
    sentence (up to 24 characters before, up to 48 after)."""
    any_case = "|".join(MONTHS)
    cased = "|".join(f"{m}|{m.upper()}" for m in MONTHS)
    begins = "(?=[JFMASOND])"  # told by one character before longer tests are made
    day = r"(?:[12]\d|3[01]|0?[1-9])(?:st|nd|rd|th)?"
    with_year = F.regexp_extract_all(text, F.lit(rf"(?i){begins}{_NO_WORD}({any_case})\s*,?\s+(?:19|20)\d\d{_NO_MORE}"), F.lit(1))
    before_day = F.regexp_extract_all(text, F.lit(rf"{begins}{_NO_WORD}({cased})\s+{day}{_NO_MORE}(?={_WITHIN}{{0,44}}{_YEAR})"), F.lit(1))
    back_day = F.regexp_extract_all(text, F.lit(rf"{begins}{_NO_WORD}(?=(?:{cased})\s+\d)(?<={_YEAR}{_WITHIN}{{0,20}})({cased})\s+{day}{_NO_MORE}(?!{_WITHIN}{{0,44}}{_YEAR})"), F.lit(1))
    after_day = F.regexp_extract_all(text, F.lit(rf"{_NO_WORD}{day}\s+({cased}){_NO_MORE}(?={_WITHIN}{{0,44}}{_YEAR})"), F.lit(1))
    # most texts have no month beside a number, which one test tells
    dated = rf"(?i)(?=[JFMASOND0-9])(?:(?:{any_case})\s*,?\s+\d|\d(?:st|nd|rd|th)?\s+(?:{any_case}))"
    none = F.array().cast("array<string>")
    return F.when(text.rlike(dated), _coded(F.concat(with_year, before_day, back_day, after_day), MONTHS, 1)).otherwise(none)


def numeric_tokens(text: Column) -> Column:
    """Numbers of a text as tokens: thousands separators dropped, minus signs kept, number words and
    months of dates as numbers."""
    found = F.regexp_extract_all(F.replace(text, F.lit("−"), F.lit("-")), F.lit(f"({NUMBER})"), F.lit(1))
    digits = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"^\+", ""))
    spelled = F.regexp_extract_all(text, F.lit(rf"(?i)(?=[zotfsen]){_NO_WORD}({'|'.join((*NUMBER_WORDS, 'single'))}){_NO_MORE}"), F.lit(1))
    words = _coded(F.transform(spelled, lambda x: F.when(F.lower(x) == "single", F.lit("one")).otherwise(x)), NUMBER_WORDS, 0)
    return F.concat(digits, words, month_tokens(text))


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SECRET_PAIR, "$1=[REDACTED]"), SECRET_TOKEN, "[REDACTED]")
