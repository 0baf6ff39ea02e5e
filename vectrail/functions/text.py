"""Token estimates, cleaners and text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators, as in Python's str.split().
SPACE = r"[\s\x1c-\x1f]"
SPACES = rf"(?U){SPACE}+"
# The same characters one by one.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Accepted language names and codes.
LANGUAGE_CODES = {
    "en": "en", "english": "en", "simple": "simple", "es": "es", "spanish": "es",
    "fr": "fr", "french": "fr", "de": "de", "german": "de", "it": "it", "italian": "it",
    "pt": "pt", "portuguese": "pt", "ru": "ru", "russian": "ru", "ja": "ja", "japanese": "ja",
    "zh": "zh", "chinese": "zh",
}
DEFAULT_LANGUAGE = "en"

# Words that mark a chunk as technical.
TECHNICAL_WORDS = ("algorithm", "network", "system", "computer")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst may inline a projected column into a lambda and then evaluate it once per
    element; a one-element transform pins it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


# --- token estimates -------------------------------------------------------------
def estimate_tokens(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.shiftright(F.length(F.coalesce(text, F.lit(""))), 2)


def estimate_tokens_min1(text: Column) -> Column:
    """Like P1, but any non-empty text counts at least one."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(
        F.greatest(F.lit(1), estimate_tokens(text))
    )


def kb_to_tokens(kb: Column) -> Column:
    """1024 bytes per KB, four characters per token, truncated."""
    return (kb * 1024 / 4).cast("int")


# --- cleaners ---------------------------------------------------------------------
def clean_latex(text: Column) -> Column:
    """Collapse white space, unwrap ``\\cmd{x}``, drop the backslash of ``\\a``."""
    out = collapse_spaces(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"\\[a-zA-Z]+\{([^}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\([a-zA-Z])", "$1")
    return F.trim(out)


def clean_wiki(text: Column) -> Column:
    """P5: strip encyclopedia markup.

    White space is collapsed first, so the other patterns need to know blanks only, a
    heading can only be the whole text, and removals may leave double blanks behind.
    """
    out = collapse_spaces(F.coalesce(text, F.lit("")))
    # The markup that is removed, in this order.
    for pattern, replacement in (
        (r"\{\{[^}]*\}\}", ""),                    # templates
        (r"\[\[([^|\]]*\|)?([^\]]*)\]\]", "$2"),  # page links, keep the label
        (r"\[http[^ \]]* *([^\]]*)\]", "$1"),      # web links
        (r"<!--.*?-->", ""),                         # comments
        (r"'{2,}", ""),                              # bold and italic marks
        (r"\A *=+ *(.+?) *=+ *\z", "$1"),            # headings
    ):
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def language_code(name: Column) -> Column:
    """Known names and codes to a code, everything else to English."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(strip(name))), F.lit(DEFAULT_LANGUAGE))


def compose_document(title: Column, body: Column) -> Column:
    """Title and body parted by a blank line; null when both are empty.

    Null counts as missing here (a deliberate deviation: the word "None" is not text).
    """
    empty = F.lit("")
    joined = F.concat_ws("\n\n", F.nullif(title, empty), F.nullif(body, empty))
    return F.nullif(joined, empty)


# --- previews and features -----------------------------------------------------------
def preview(text: Column, width: int = 100, always_dots: bool = False) -> Column:
    """The first ``width`` characters; dots always, or only when something was cut."""
    head = F.substring(text, 1, width)
    dots = F.lit("...") if always_dots else F.when(F.length(text) > width, "...").otherwise("")
    return F.concat(head, dots)


def chunk_features(text: Column) -> dict[str, Column]:
    """Counts and flags of one chunk."""
    low = F.lower(text)
    technical = F.lit(False)
    for word in TECHNICAL_WORDS:
        technical = technical | low.contains(word)
    return {
        "token_count": estimate_tokens(text),
        "word_count": F.size(words(text)),
        "char_count": F.length(text),
        "has_math": text.contains("$") | low.contains("equation"),
        "has_links": low.contains("http") | low.contains("www"),
        "is_technical": technical,
    }


def has_title_line(text: Column) -> Column:
    """The first line is short and does not end like a sentence."""
    line = F.substring_index(text, "\n", 1)
    return (F.length(line) < 100) & ~line.endswith(".")
