"""Text rules as column expressions. Lengths and slices count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: letters and marks that are unified, and words that carry no meaning
JOINERS = "‌‏‎"
ARABIC_LETTERS, PERSIAN_LETTERS = "يكۀة", "یکهه"
STOPWORDS_FA = (
    "از به با را که در این آن است هست بود شد برای یا و تا می های ها کرد کند شود شده هم نیز اگر اما ولی"
    " چون زیرا پس بر هر چه دیگر بین روی زیر کنار طبق حتی"
).split()
STOPWORDS_EN = (
    "the a an is are was were be been of to in on and or for with that this it as by at from we our us you"
    " your they their he she his her its not no but if then"
).split()
HEADING_WORDS = ("فصل", "بخش", "ماده", "بند")
EXPERIENCE_LABELS = {
    "title": "عنوان: ",
    "subject": "موضوع: ",
    "problem_description": "مسئله (Problem): ",
    "root_cause": "علت ریشه‌ای (Root Cause): ",
    "actions_taken": "اقدامات انجام‌شده (Actions Taken): ",
    "results": "نتایج (Results): ",
    "lessons_learned": "درس آموخته (Lesson Learned): ",
    "suggestion": "پیشنهاد: ",
}
#: White space as the reference's patterns and its trimming have it: with the byte order mark,
#: without U+0085 and the information separators.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
TAGS_LABEL, TAG_JOINER = "برچسب‌ها: ", "، "
# ---- end of fixed values

MOST_TERMS, EXCERPT_CHARS = 12, 300


_SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def trim_space(text: Column) -> Column:
    """text without white space at its ends."""
    return F.btrim(text, F.lit(SPACE))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{_SPACE}+", " "))


def normalize_query(text: Column) -> Column:
    return collapse(F.translate(text, JOINERS, " " * len(JOINERS)))


def normalize_persian(text: Column) -> Column:
    return normalize_query(F.translate(text, ARABIC_LETTERS, PERSIAN_LETTERS))


def normalize_whitespace(text: Column) -> Column:
    """CRLF to LF, runs of blanks and tabs to one space, three or more newlines to two."""
    unix = F.regexp_replace(text, "\r\n", "\n")
    narrow = F.regexp_replace(F.regexp_replace(unix, "[ \t]+", " "), "\n{3,}", "\n\n")
    return trim_space(narrow)


def nfkc(text: Column) -> Column:
    """Unicode NFKC by the ICU library that Spark ships; ASCII texts skip it."""
    composed = F.call_function(
        "java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True)
    )
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def tokenize(text: Column) -> Column:
    """Lower-cased, unified words of two or more characters that are not stop-words."""
    unified = F.translate(nfkc(F.lower(text)), ARABIC_LETTERS + JOINERS, PERSIAN_LETTERS + " " * len(JOINERS))
    words = F.regexp_extract_all(unified, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOPWORDS_FA + STOPWORDS_EN))
    return F.filter(words, lambda w: (F.char_length(w) > 1) & ~F.array_contains(stop, w))


def or_terms(text: Column) -> Column:
    """The first twelve space-separated terms of two or more characters."""
    return F.slice(F.filter(F.split(normalize_query(text), " "), lambda t: F.char_length(t) > 1), 1, MOST_TERMS)


def posting_terms(text: Column) -> Column:
    """Lower-cased words as the keyword index holds them: no stop-words, no stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 3).cast("int")


def detect_heading(paragraph: Column) -> Column:
    """The heading that a paragraph is, or null."""
    line = trim_space(paragraph)
    is_heading = (
        line.rlike("^#{1,6}" + _SPACE)
        | line.rlike(rf"^[0-9]+[.)]{_SPACE}")
        | ((line == F.upper(line)) & line.rlike("[A-Za-z]"))
        | line.rlike(rf"^({'|'.join(HEADING_WORDS)}){_SPACE}")
    )
    fits = F.char_length(line).between(1, 120)
    return F.when(fits & is_heading, F.regexp_replace(line, "^#{1,6}" + _SPACE, ""))


def strip_markup(xml: Column) -> Column:
    """Tags to spaces, then four entities in this order, then collapsed."""
    text = F.regexp_replace(xml, "<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


def file_extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.substring_index(F.lower(name), ".", -1)).otherwise("")


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def client_ip(forwarded: Column, real: Column) -> Column:
    """First address of x-forwarded-for, else x-real-ip, else null."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.when(first != "", first), F.when(real != "", real))


def limiter_key(ip: Column, suffix: Column) -> Column:
    return F.concat(F.coalesce(ip, F.lit("unknown")), F.lit(":"), suffix)


def experience_text(row: dict[str, Column], tags: Column) -> Column:
    """Fields of a lesson, each after its label, empty optional ones skipped."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    parts = [part(EXPERIENCE_LABELS[name], row[name]) for name in EXPERIENCE_LABELS if name in row]
    joined = F.when(F.size(tags) > 0, F.concat(F.lit(TAGS_LABEL), F.array_join(tags, TAG_JOINER)))
    return F.concat_ws("\n\n", *parts, joined)


def experience_embedding_text(row: dict[str, Column], published: bool) -> Column:
    """What the vector of a lesson is made of: all fields in order when it is published, at
    first its title, problem, lessons and actions only; without labels and tags."""
    names = list(EXPERIENCE_LABELS) if published else ["title", "problem_description", "lessons_learned", "actions_taken"]
    return F.concat_ws("\n\n" if published else "\n", *(F.when(row[n] != "", row[n]) for n in names if n in row))


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def truncate(text: Column, chars: int) -> Column:
    short = F.concat(F.substring(text, 1, chars - 3), F.lit("..."))
    return F.when(F.char_length(text) <= chars, text).otherwise(short)


def typed_setting(value: Column, default: float) -> Column:
    """A JSON value, if it is a number; else the default."""
    number = value.rlike(r"^\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?\s*$")
    return F.coalesce(F.when(number, F.trim(value).cast("double")), F.lit(float(default)))


def event_metadata(**fields: Column) -> Column:
    """A JSON object of the fields that are not null."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))


def read_metadata(metadata: Column, field: str) -> Column:
    return F.get_json_object(metadata, f"$.{field}")


def file_size_label(size: Column) -> Column:
    unit = lambda power, name: F.format_string(f"%.1f {name}", size / float(1024**power))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, unit(1, "KB"))
        .when(size < 1024**3, unit(2, "MB"))
        .otherwise(unit(3, "GB"))
    )


def ingest_progress(done: Column, total: Column, kind: Column) -> Column:
    """Percent shown while chunks are indexed: documents from 40 to 95, lessons 10 to 95."""
    share = done / total
    return F.when(kind == "document", 40 + F.floor(55 * share + 0.5)).otherwise(10 + F.floor(85 * share + 0.5)).cast("int")


def embedding_input(text: Column, kind: str) -> Column:
    """kind: query or passage."""
    return F.concat(F.lit(f"{kind}: "), text)


def valid_uuid(value: Column) -> Column:
    return value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
