"""Text expressions: markup, words, keys, slugs, quotes, citations. All run inside the JVM unless a name ends in _full."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Entities that are replaced inside the JVM ('&amp;' last, so that '&amp;lt;' becomes '&lt;').
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©",
    "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&",
}

# Glyphs that count as a quote mark or a dash, and words without weight in titles.
QUOTE_GLYPHS = "«»“”„‟‘’‹›\"'`"
DASHES = "‐‑‒–—―"
STOP_WORDS = ("the", "a", "an", "of", "and", "to", "in", "on", "for", "book", "summary", "notes")

# Limits.
SPARSE_CHARS, SLUG_CHARS, KEY_CHARS, LEAST_FRAGMENT, TASK_SLUG_CHARS = 2000, 40, 200, 16, 80


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    """regexp_replace, one pattern after the other."""
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def _without_tags(markup: Column) -> Column:
    return replaced(
        markup,
        (r"(?is)<(script|style)\b.*?</\1>", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(?:p|div|h[1-6]|li|tr|blockquote|section)>", "\n\n"),
        (r"<[^>]+>", ""),
    )


def _tidy(text: Column) -> Column:
    return trimmed(replaced(text, ("[ \t ]+", " "), (r"\n{3,}", "\n\n")))


def trimmed(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return replaced(text, (r"(?U)^\s+|\s+\z", ""))


def strip_html(markup: Column) -> Column:
    """Plain text of markup, with the entities of ENTITIES."""
    text = _without_tags(markup)
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return _tidy(text)


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def _unescape_closed(text: pd.Series) -> pd.Series:
    known = lambda m: html.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0]
    return text.map(lambda t: _CLOSED.sub(known, t), na_action="ignore")


def strip_html_full(markup: Column, closed: bool = False) -> Column:
    """strip_html with every entity of HTML 5; an Arrow function runs on the rows that have any.

    closed: only entities that end with ';', as in XML. HTML 5 also reads some that don't, so of an '&amp;' that was
    cut off in '&amp' it makes '&'.
    """
    text = _without_tags(markup)
    return _tidy(F.when(F.contains(text, F.lit("&")), (_unescape_closed if closed else _unescape)(text)).otherwise(text))


def split_words(text: Column) -> Column:
    """The white-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def extraction_note(text: Column) -> Column:
    """'sparse' for text so short that its extraction has probably failed."""
    return F.when(F.length(text) < SPARSE_CHARS, F.lit("sparse"))


def slug(text: Column, chars: int = SLUG_CHARS) -> Column:
    """File-name form: words joined by '-', cut, 'section' if nothing is left."""
    bare = F.lower(trimmed(replaced(text, (r"(?U)[^\w\s-]", ""))))
    joined = replaced(bare, (r"(?U)[\s_-]+", "-"))
    return F.coalesce(F.nullif(replaced(F.substring(joined, 1, chars), (r"-+$", "")), F.lit("")), F.lit("section"))


def text_key(text: Column) -> Column:
    """Lower-case words and spaces only; what two wordings must share to be equal."""
    return trimmed(replaced(F.lower(F.coalesce(text, F.lit(""))), (r"(?U)[^\w\s]", " "), (r"(?U)\s+", " ")))


def tokens(text: Column) -> Column:
    """The distinct words of text_key."""
    return F.array_distinct(split_words(replaced(F.lower(F.coalesce(text, F.lit(""))), (r"(?U)[^\w\s]", " "))))


def title_tokens(*texts: Column) -> Column:
    """The distinct words of several texts, without STOP_WORDS."""
    return F.array_except(tokens(F.concat_ws(" ", *texts)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def title_matches(candidate: Column, title: Column, author: Column | None = None, least: float = 0.6) -> Column:
    """Whether a candidate heading names a title: one contains the other, or enough of its words are there.

    An empty title matches everything; an author who isn't mentioned only rules out matches by words.
    """
    c, t = text_key(candidate), text_key(title)
    inside = F.contains(c, t) | F.contains(t, c)
    want = F.array_distinct(split_words(t))
    shared = F.size(F.array_intersect(split_words(c), want)) / F.size(want) >= least
    if author is not None:
        names = split_words(text_key(author))
        shared = shared & ((F.size(names) == 0) | F.exists(names, lambda n: F.contains(c, n)))
    return (t == "") | inside | shared


def located(meta: Column) -> Column:
    """'Location 12-15' or 'page iv' out of a clipping's second line; '' without."""
    low = F.lower(meta)
    place, page = F.regexp_extract(low, r"location\s+([0-9\-]+)", 1), F.regexp_extract(low, r"page\s+([0-9ivxlc\-]+)", 1)
    return F.when(place != "", F.concat(F.lit("Location "), place)).when(page != "", F.concat(F.lit("page "), page)).otherwise("")


_LINKED, _PLAIN = r"(?U)\s*\(\[([^\]]+)\]\([^)]*\)\)\s*$", r"(?U)\s*\(([^()]{1,40})\)\s*$"


def cited(item: Column) -> Column:
    """struct(text, location): a list item without its closing citation, linked or (with a digit) in plain brackets."""
    linked, plain = F.regexp_extract(item, _LINKED, 1), F.regexp_extract(item, _PLAIN, 1)
    is_linked, is_plain = linked != "", plain.rlike(r"\d")
    return F.struct(
        F.when(is_linked, trimmed(replaced(item, (_LINKED, "")))).when(is_plain, trimmed(replaced(item, (_PLAIN, "")))).otherwise(item).alias("text"),
        F.when(is_linked, trimmed(linked)).when(is_plain, trimmed(plain)).otherwise("").alias("location"),
    )


def capitalized(text: Column) -> Column:
    """First letter upper, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def typed_location(kind: Column, location: Column) -> Column:
    """A location with its type before it; 'Location' where the type isn't given."""
    place, word = F.trim(F.coalesce(location, F.lit(""))), F.lower(F.trim(F.coalesce(F.nullif(kind, F.lit("")), F.lit("location"))))
    return F.when((place != "") & (word != ""), F.concat_ws(" ", capitalized(word), place)).otherwise(place)


def quote_key(text: Column) -> Column:
    """Wording without typography: one kind of dash, of quote mark and of space, lower case."""
    same = F.translate(text, DASHES + QUOTE_GLYPHS, "-" * len(DASHES) + "'" * len(QUOTE_GLYPHS))
    return F.lower(trimmed(replaced(same, (r"(?U)\s+", " "))))


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(text: Column) -> Column:
    """Unicode's compatibility composition, which only text beyond ASCII needs."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _compatible(text)).otherwise(text)


def quote_key_full(text: Column) -> Column:
    """quote_key after compatibility composition."""
    return quote_key(compatible(text))


_ATTRIBUTION, _ELISION = r"(?U)\s+[—–-]{1,2}\s+[^—–]*$", r"\[\s*(?:\.\.\.|…)\s*\]|\.\.\.|…"


def quote_core(quote: Column) -> Column:
    """A quote without its attribution and the marks around it."""
    return F.btrim(trimmed(replaced(quote, (_ATTRIBUTION, ""))), F.lit(QUOTE_GLYPHS + " "))


def fragments(quote: Column) -> Column:
    """The wordings between a quote's elisions, without punctuation at their ends; empty ones are left out."""
    parts = F.transform(F.split(quote, _ELISION), lambda p: F.btrim(quote_key(p), F.lit(".,;:!?¡¿ ")))
    return F.filter(parts, lambda p: p != "")


def checkable(parts: Column, least: int = LEAST_FRAGMENT) -> Column:
    """The fragments that are long enough to be looked for."""
    return F.filter(parts, lambda p: F.length(p) >= least)


def shown(text: Column, chars: int = 70) -> Column:
    """Text cut for display."""
    return F.when(F.length(text) > chars + 1, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def year_from(text: Column) -> Column:
    """The first year from 1500 to 2099."""
    return F.nullif(F.regexp_extract(text, r"(1[5-9]\d\d|20\d\d)", 1), F.lit("")).cast("int")


def inline_list(value: Column) -> Column:
    """The items of '[a, \"b\"]', without quote marks; null if it isn't of that form."""
    bare = F.trim(value)
    items = F.transform(F.split(F.substring(bare, F.lit(2), F.length(bare) - 2), ","), lambda x: F.btrim(F.trim(x), F.lit("'\"")))
    return F.when(bare.startswith("[") & bare.endswith("]"), F.filter(items, lambda x: x != ""))


def tag(value: Column, prefix: str = "book/") -> Column:
    """A tag in lower case without its prefix."""
    low = F.lower(F.trim(value))
    return F.when(low.startswith(prefix), F.substring(low, len(prefix) + 1, 1 << 30)).otherwise(low)


def tags(*lists: Column, prefix: str = "book/") -> Column:
    """Sorted distinct tags of several lists."""
    one = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_sort(F.array_distinct(F.filter(F.transform(one, lambda t: tag(t, prefix)), lambda t: t != "")))


def lesson_key(text: Column) -> Column:
    """Trimmed, lower case, single spaces."""
    return replaced(F.lower(trimmed(F.coalesce(text, F.lit("")))), (r"(?U)\s+", " "))


def lesson_tokens(text: Column) -> Column:
    """Distinct words of letters, digits and dots with two characters or more."""
    return F.array_distinct(F.filter(F.split(lesson_key(text), r"[^\p{L}\p{N}.]+"), lambda t: F.length(t) > 1))


def scope_key(scope: Column) -> Column:
    """A scope as a sorted set of keys."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(scope, F.array().cast("array<string>")), lesson_key), lambda x: x != "")))


@F.pandas_udf(StringType())
def _base_letters(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"), na_action="ignore")


def task_slug(text: Column) -> Column:
    """ASCII file-name form of a task; letters lose their marks. Only text beyond ASCII leaves the JVM."""
    given = F.coalesce(text, F.lit(""))
    plain = F.lower(F.when(given.rlike(r"[^\x00-\x7F]"), _base_letters(given)).otherwise(given))
    dashed = replaced(plain, (r"[^a-z0-9]+", "-"), (r"^-+|-+$", ""))
    short = replaced(F.substring(dashed, 1, TASK_SLUG_CHARS), (r"-+$", ""))
    return F.when((short == "") | short.rlike("^[a-f0-9]{64}$"), "task").otherwise(short)


def ticket_key(value: Column) -> Column:
    """PROJECT-123 in upper case, else null."""
    key = F.upper(trimmed(F.coalesce(value, F.lit(""))))
    return F.when(key.rlike(r"^[A-Z][A-Z0-9_]*-[0-9]+$"), key)


def label(key: Column) -> Column:
    """A field name in words."""
    spaced = replaced(key, (r"([a-z])([A-Z])", "$1 $2"), (r"[_-]+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def visible(text: Column) -> Column:
    """Text without digests and control characters."""
    return trimmed(replaced(F.coalesce(text, F.lit("")), (r"(?i)\b[a-f0-9]{64}\b", "[internal digest omitted]"), (r"[\x00-\x1f\x7f]", " ")))


def safe_stem(name: Column) -> Column:
    """A name without the characters that file systems forbid."""
    return trimmed(replaced(name, (r'[/\\:*?"<>|]', "")))


def image_kind(content: Column) -> Column:
    """jpg or png by the first bytes; jpg where they tell nothing."""
    return F.when(F.hex(F.substring(content, 1, 4)) == "89504E47", "png").otherwise("jpg")
