"""Names, handles, addresses and words of containers as Column expressions: normal forms, shapes, stems."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract_all

# Shapes, words that name nobody, words of roles, and words that identify no container.
VALID_EMAIL = r"^[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+$"
NOT_A_PERSON = (
    r"^(?:the|team|group|all|everyone|here|channel|room|meeting|header|attendees|participants|action|items?|notes?|agenda"
    r"|summary|update|re|fwd|hi|hey|thanks|regards|best|cheers|unknown|tbd|n/?a)$"
)
ROLE_WORDS = [
    "admin", "approvals", "billing", "compliance", "contracts", "customer", "engineering", "finance", "help", "incident", "internal", "lead", "legal", "onboarding", "operations", "ops",
    "platform", "policy", "procurement", "response", "runner", "security", "service", "support", "team", "unavailable", "vendor",
]
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were",
    "what", "when", "where", "which", "who", "whose", "why", "with",
]
CONTAINER_NOUNS = ["board", "channel", "directory", "drive", "folder", "inbox", "page", "project", "repo", "repository", "site", "space", "team", "thread", "workspace"]
WORD = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"
SLUG = r"[a-z0-9]+(?:[-_][a-z0-9]+)+"


def _plain_letters() -> tuple[str, str]:
    """Letters with marks and the ASCII letters below them, for Latin's blocks."""
    marked, plain = "", ""
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            marked, plain = marked + chr(code), plain + base
    return marked, plain


MARKED, PLAIN = _plain_letters()


def fold(token: Column) -> Column:
    """Lower case without marks, so that a name and the address made of it are equal; 'ß' is 'ss'."""
    bare = F.regexp_replace(F.translate(token, MARKED, PLAIN), r"\p{M}+", "")
    return F.lower(F.replace(bare, F.lit("ß"), F.lit("ss")))


def without(tokens: Column, qualifiers: Column | None, fewest: int) -> Column:
    """Tokens that are no qualifiers, if at least ``fewest`` of them remain; else all."""
    if qualifiers is None:
        return tokens
    left = F.filter(tokens, lambda t: ~F.array_contains(qualifiers, t))
    return F.when(F.size(left) >= fewest, left).otherwise(tokens)


def name_tokens(raw: Column, qualifiers: Column | None = None) -> Column:
    """A person's name in comparable tokens: no parentheses or punctuation, one kind of apostrophe, no qualifiers if two tokens survive."""
    text = F.regexp_replace(F.regexp_replace(raw, r"\([^)]*\)", " "), r"[^\p{L}\p{N}_\s'’-]+", " ")
    text = F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), r"\s+", " "))
    return without(F.filter(F.split(text, " "), lambda t: t != ""), qualifiers, 2)


def norm_name(raw: Column, qualifiers: Column | None = None) -> Column:
    return F.array_join(name_tokens(raw, qualifiers), " ")


def handle_tokens(raw: Column, qualifiers: Column | None = None) -> Column:
    """A handle or the local part of an address: digits dropped, split at . _ - and spaces, no qualifiers if any token survives."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(raw), "[0-9]+", ""), r"[._\-\s]+"), lambda t: t != "")
    return without(tokens, qualifiers, 1)


def is_email(value: Column) -> Column:
    return value.rlike(VALID_EMAIL)


def looks_like_handle(raw: Column) -> Column:
    """One word of at most 40 characters with a letter."""
    value = F.trim(raw)
    return (value != "") & ~F.contains(value, F.lit(" ")) & (F.length(value) <= 40) & value.rlike(r"\p{L}")


def looks_like_person_name(raw: Column, qualifiers: Column | None = None) -> Column:
    """Two to four tokens of letters, apostrophes and hyphens that begin with a letter, none of which is a word that names nobody."""
    tokens = name_tokens(raw, qualifiers)
    return F.size(tokens).between(2, 4) & F.forall(tokens, lambda t: t.rlike(r"^\p{L}[\p{L}'-]*$") & ~t.rlike(NOT_A_PERSON))


def role_alias(phrase: Column) -> Column:
    words = F.split(phrase, " ")
    return (F.size(words) > 1) & F.arrays_overlap(words, F.array(*map(F.lit, ROLE_WORDS)))


def words(text: Column) -> Column:
    """Words split at separators and at changes of case, lowered."""
    return F.transform(extract_all(F.coalesce(text, F.lit("")), WORD), F.lower)


def stem(word: Column) -> Column:
    """Without a plural s, unless that would cut 'ss', 'us', 'is' or 'os'."""
    plural = (F.length(word) >= 4) & word.rlike("s$") & ~word.rlike("(ss|us|is|os)$")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def content_words(text: Column) -> Column:
    """The stems that identify a container, in order and with repeats: no function words, no nouns for containers."""
    empty = F.array(*map(F.lit, [*STOP_WORDS, *CONTAINER_NOUNS]))
    stems = F.transform(words(text), stem)
    return F.filter(stems, lambda w: ~F.array_contains(empty, w) & ~F.array_contains(empty, stem(w)) & (F.length(w) >= 2))


def slugs(text: Column) -> Column:
    return F.array_distinct(extract_all(F.lower(text), SLUG))


def normal_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
