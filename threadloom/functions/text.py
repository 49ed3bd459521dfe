"""Column expressions for parsing, normalising and measuring message texts. All run inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://\S+|www\.\S+"
WORD = r"[\p{L}\p{N}_]+(?:'+[\p{L}\p{N}_]+)*"
#: Words that say nothing about content, besides the name of the brand.
STOP_WORDS = "a about and are at be can do for from have how i in is it let me more my of on or please tell that the this to us what when which with you your".split()
#: Phrases of questions that fit any request.
GENERIC_QUESTIONS = (
    "what's happening", "what is happening", "tell us more", "give us more detail", "give us more info",
    "what you need", "how we can assist", "what you're looking for", "what issues are you having",
)
#: What a question may ask for, and what in a request shows that it is known.
KNOWN_CONTEXT = (
    (("device", "phone", "model"), ("iphone", "ipad", "android", "samsung", "windows", "mac", "ps4", "playstation", "bmw")),
    (("operating system", " os", "ios", "android version"), ("ios", "android", "windows", "macos")),
    (("app version", "version are you", "version you're"), ("version", "latest", "8.")),
    (("error message", "error messages"), ("error", "no error")),
    (("playlists",), ("playlist", "playlists")),
)


def any_contains(text: Column, terms: list[str]) -> Column:
    """Whether any of the terms is a substring."""
    return reduce(or_, (F.contains(text, F.lit(t)) for t in terms), F.lit(False))


def parse_inbound(raw: Column) -> Column:
    """True, false or null from the usual spellings of a flag."""
    value = F.lower(F.trim(raw))
    return F.when(value.isin("true", "t", "1", "yes", "y"), True).when(value.isin("false", "f", "0", "no", "n"), False)


def invalid_inbound(raw: Column) -> Column:
    """A flag that is there but cannot be read."""
    return F.coalesce(F.trim(raw) != "", F.lit(False)) & parse_inbound(raw).isNull()


def id_items(raw: Column) -> Column:
    """The items of a list of ids: JSON, bracketed or comma-separated; blanks and words for null are none."""
    value = F.trim(raw)
    plain = F.split(F.regexp_replace(value, r"^\[|\]$", ""), ",")
    items = F.coalesce(F.from_json(F.when(value.startswith("["), value), "array<string>"), plain)
    tidy = F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^["']+|["']+$""", "")), lambda x: x != "")
    return F.when(value.isNull() | (value == "") | F.lower(value).isin("nan", "none", "null"), F.array().cast("array<string>")).otherwise(tidy)


def id_values(raw: Column) -> Column:
    return F.filter(id_items(raw), lambda x: x.rlike("^[0-9]+$"))


def id_malformed(raw: Column) -> Column:
    return F.filter(id_items(raw), lambda x: ~x.rlike("^[0-9]+$"))


def parse_parent(raw: Column) -> Column:
    """The parent id; several are none at all."""
    return F.when(F.size(id_values(raw)) == 1, id_values(raw)[0])


def parse_single_id(raw: Column) -> Column:
    """An id, if the value is one id and nothing else."""
    return F.when((F.size(id_values(raw)) == 1) & (F.size(id_malformed(raw)) == 0), id_values(raw)[0])


def parse_timestamp(raw: Column) -> Column:
    """ISO 8601, or the day-name form of social exports; null if neither."""
    return F.coalesce(raw.try_cast("timestamp"), F.try_to_timestamp(F.substr(raw, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy")))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_reply(text: Column) -> Column:
    """Lower case, with links and handles as placeholders."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(text), URL, "<url>"), "@[a-z0-9_]+", "<mention>"))


def numbers_masked(normalized: Column) -> Column:
    """A normalised reply with long numbers as placeholders."""
    return collapse(F.regexp_replace(normalized, r"\b[0-9]{5,}\b", "<number>"))


def normalize_for_leakage(text: Column) -> Column:
    return numbers_masked(normalized_reply(text))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint")


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)))


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is its own; an empty one has none. One walk over the text: a substring by place would begin
    at its start each time."""

    def of(flat: Column) -> Column:
        grams = F.when(F.length(flat) >= n, F.regexp_extract_all(flat, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))).otherwise(F.array(flat))
        return F.when(F.length(flat) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))

    return F.transform(F.array(collapse(text)), of)[0]  # the text is normalised once, not for every position


def jaccard(a: Column, b: Column) -> Column:
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / (F.size(a) + F.size(b) - same))


def sanitize_public(text: Column) -> Column:
    """Links, addresses, handles and long numbers as placeholders, in this order."""
    for pattern, mark in ((URL, "<URL>"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"), ("@[A-Za-z0-9_]+", "<HANDLE>"), (r"[0-9]{7,}", "<NUMBER>")):
        text = F.regexp_replace(text, pattern, mark)
    return collapse(text)


def sanitize_reply(text: Column) -> Column:
    """A reply without links, placeholders, handles, addresses, long numbers, an agent's initials and the name after a greeting."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    for pattern, new in (
        (URL + "|<(?:url|email|mention|number)>", " "), ("@[A-Za-z0-9_]+", " "), (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}", " "),
        (r"\b[0-9]{7,}\b", " "), (r"(^|\s)/[A-Z]{1,3}(\s|$|[.!?])", "$1$2"), (r"\s+", " "), ("^[ -]+|[ -]+$", ""),
        (r"^(Hey|Hi|Hello)\s+[A-Z][a-z]{1,24}([!.])", "$1$2"), (r"\s+([,.!?])", "$1"), ("^[ -]+|[ -]+$", ""),
    ):
        text = F.regexp_replace(text, pattern, new)
    return text


def without_greeting(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)^(?:hey|hi|hello)(?: there)?[,.!]*\s*", ""))


def clean_exploration(text: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), URL, " "), "@[a-z0-9_]+", " "), r"\b[0-9]+\b", " "))


def content_tokens(text: Column) -> Column:
    return F.array_except(F.filter(plain_tokens(text), lambda w: F.length(w) > 2), F.array(*map(F.lit, STOP_WORDS)))


def plain_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z']+"), F.lit(0)))


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def generic_question(text: Column) -> Column:
    return any_contains(F.lower(text), list(GENERIC_QUESTIONS))


def asks_for_known(question: Column, customer: Column) -> Column:
    """Whether a question asks for what the customer has already said."""
    q, c = F.lower(question), F.lower(customer)
    return reduce(or_, (any_contains(q, list(ask)) & any_contains(c, list(known)) for ask, known in KNOWN_CONTEXT))


def question_only(text: Column) -> Column:
    own = sentences(text)
    return (F.size(own) > 0) & F.forall(own, lambda x: x.endswith("?"))


def coverage_failure(reply: Column, customer: Column) -> Column:
    """A reply of questions alone that asks for what is known, or of generic ones although the customer was specific."""
    own = sentences(reply)
    known = F.exists(own, lambda x: asks_for_known(x, customer))
    bland = (F.size(content_tokens(customer)) >= 4) & F.forall(own, generic_question)
    return question_only(reply) & (known | bland)


def joined_context(parts: Column) -> Column:
    """Parts as one context, divided by two bars. Bars and backslashes in a part get a backslash before them."""
    return F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, r"([|\\])", r"\\$1")), " || ")


def customer_parts(context: Column) -> Column:
    """What the customer said in a context of parts such as CUSTOMER: text, divided by two bars (``joined_context``)."""
    mine = F.filter(F.split(context, r" \|\| "), lambda x: x.startswith("CUSTOMER: "))
    return F.transform(mine, lambda x: F.regexp_replace(F.substr(x, F.lit(11)), r"\\([|\\])", "$1"))


def customer_only(context: Column, message: Column) -> Column:
    """The customer's parts joined, or the message where there are none."""
    own = customer_parts(context)
    return F.when(F.size(own) > 0, F.array_join(own, " ")).otherwise(message)


def customer_context(context: Column, message: Column) -> Column:
    """The customer's parts, each once and without the message itself."""
    return F.filter(F.array_distinct(customer_parts(context)), lambda x: x != message)


def split_context(clip: Column, message: Column) -> Column:
    """What a clipped context has beyond the message that it begins with."""
    return F.when(clip.startswith(message), F.trim(F.substr(clip, F.length(message) + 1))).otherwise(clip)


def plain_form(text: Column) -> Column:
    """Lower case, letters and digits with single spaces: the form in which extracts are recognised."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def provider_message(text: Column, most: int = 300) -> Column:
    """An error message without keys and links, clipped."""
    hidden = F.regexp_replace(F.regexp_replace(text, r"(?i)(key|token|bearer)[=: ]+\S+", "$1 <hidden>"), URL, "<url>")
    return F.substr(collapse(hidden), F.lit(1), F.lit(most))


def daily_quota(text: Column) -> Column:
    """Whether an error message says that a day's tokens are used up, so that asking again the same day is no use."""
    return F.coalesce(text.rlike(r"(?i)tokens per day|\bTPD\b"), F.lit(False))


def transient_failure(status: Column, text: Column) -> Column:
    """Whether a rejected request may succeed when repeated: its answer could not be parsed or generated."""
    return F.coalesce((status == 400) & text.rlike("(?i)parsing failed|failed_generation"), F.lit(False))


def retry_seconds(text: Column) -> Column:
    """The wait that an error message asks for, in seconds; null without one."""
    found = F.regexp_extract(text, r"(?i)(?:retry|try again)[a-z ]*(?:after|in)[ :]+([0-9.]+(?:ms|s|m|h)?[0-9.]*s?)", 1)
    return F.when(found == "", None).when(found.rlike(r"^[0-9.]+$"), found.try_cast("double")).otherwise(duration_seconds(found))


def signal_present(text: Column, signal: str) -> Column:
    """The signal with no letter or digit on either side."""
    return F.lower(text).rlike(rf"(^|[^a-z0-9])\Q{signal}\E($|[^a-z0-9])")


def hash_rank(*parts: Column | str) -> Column:
    """A fixed pseudo-random order: SHA-256 over the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def hash_unit(hexed: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.conv(F.substr(hexed, F.lit(1), F.lit(16)), 16, 10).cast("double") / F.lit(2.0**64)


def thread_key(root: Column, prefix: str = "t") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substr(F.sha2(F.concat(F.lit("thread:"), root.cast("string")), 256), F.lit(1), F.lit(20)))


def clipped(text: Column, n: int) -> Column:
    return F.trim(F.substr(sanitize_public(text), F.lit(1), F.lit(n)))


def duration_seconds(raw: Column) -> Column:
    """Seconds in strings such as 1m2.5s or 300ms."""
    def unit(name: str, factor: float) -> Column:
        found = F.regexp_extract_all(raw, F.lit(rf"([0-9.]+){name}(?![a-z])"), F.lit(1))
        return F.aggregate(F.transform(found, lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b) * factor

    return unit("h", 3600.0) + unit("m", 60.0) + unit("s", 1.0) + unit("ms", 0.001)


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def wait_seconds(attempt: Column, asked: Column | None = None, most: float = 600.0) -> Column:
    """How long to wait before trying again: doubling, or a little more than what was asked for, within a bound."""
    doubled = F.pow(F.lit(2.0), attempt)
    return F.least(F.greatest(doubled, F.coalesce(asked + 0.5, F.lit(0.0))) if asked is not None else doubled, F.lit(most))


def bucket(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "LOW").when(value < high, "MEDIUM").otherwise("HIGH")
