"""Regular expressions of the engine, once, with the spelling each dialect needs.

Spark's regular expressions are Java's: ``\\w``, ``\\s`` and ``\\b`` are ASCII there unless the pattern begins with
``(?U)``. :func:`java` adds that; :func:`re2` gives the spelling for engines with ASCII classes and no lookaround.
"""

from __future__ import annotations

# The alternatives of the custom tokenizer, tried from the first on at each position.
TOKEN_RULES = (
    r"https?://\S+[^\s.,;:)]",
    r"www\.\S+[^\s.,;:)]",
    r"[\w-]+\.(?:org|gov|com|uk|int)\b",
    r"1-8\d\d-\d{3}-\d{4}",
    r"\d+(?:\.\d+){2,}",
    r"\d+(?:\.\d+)?[–-]\d+(?:\.\d+)?",
    r"[A-Za-z]+-?(?:\d+|[IVX]+\b)",
    r"\d+-[a-z]+(?:-[a-z]+)*",
    r"[A-Za-z]+(?:-[A-Za-z]+)+",
    r"[A-Za-z]+/[A-Za-z]+",
    r"(?:e\.g|i\.e|etc)\.",
    r"\d+(?:[.,]\d+)*(?:%|st|nd|rd|th|s)?",
    r"[A-Za-z]+(?:'[a-z]+)?",
    r"[^\w\s]",
)
TOKEN = "|".join(TOKEN_RULES)
# The same matches in the same order, without going back over a word for each rule that it doesn't fit (Java only). Rules
# that begin with a digit and with a letter never compete; a run of letters that ends in I, V or X is a token of rule 7.
_FAST_RULES = (
    *TOKEN_RULES[:2],
    r"[\w-]++\.(?:org|gov|com|uk|int)\b",
    r"(?=\d)(?:" + "|".join(TOKEN_RULES[i] for i in (3, 4, 5, 7, 11)) + ")",
    r"[A-Za-z]++(?:-?\d+|-[IVX]++\b)",
    r"[A-Za-z]{2,}+(?<=[IVX])\b",
    TOKEN_RULES[10],
    r"[A-Za-z]++(?:(?:-[A-Za-z]++)++|/[A-Za-z]++|'[a-z]++)?+",
)
FAST_TOKEN = "|".join((*_FAST_RULES, TOKEN_RULES[-1]))
# Only tokens with a letter or digit: of single signs those that are numbers (letters are word characters).
_NUMBER_SIGN = r"[\p{N}&&[^\w\s]]"
FAST_CONTENT = "|".join((*_FAST_RULES, _NUMBER_SIGN))
# Texts without any of this have no numbers to drop and nothing to normalise, and only these two rules can fit.
NOT_PLAIN = r"['‑/\-\p{Nd}]|\.(?:org|gov|com|uk|int)|www\."
PLAIN_CONTENT = "|".join((TOKEN_RULES[10], r"[A-Za-z]++", _NUMBER_SIGN))

_MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
# Categories of numbers and their patterns.
NUMBER_CATEGORIES = {
    "dose": r"\b\d+(?:\.\d+)?\s?(?:mg|ml|micrograms?|mcg|g)\b",
    "duration": r"\b\d+(?:\.\d+)?(?:\s?(?:–|-|to)\s?\d+)?\s?(?:days?|weeks?|months?|years?|hours?|minutes?)\b(?!\s+old)",
    "age": r"\b(?:aged?|ages)\s+\d+(?:\s?(?:–|-|to)\s?\d+)?|\b\d+(?:–\d+)?[- ]year[- ]olds?\b|\b\d+\s+years?\s+old\b",
    "sessions / frequency": r"\b\d+(?:\s?(?:–|-|to)\s?\d+)?\s+(?:sessions?|times)\b",
    "percentage": r"\b\d+(?:\.\d+)?\s?%",
    "helpline number": r"\b1-8\d\d-\d{3}-\d{4}\b|\b(?:988|111|999)\b|\b116 ?123\b",
    "NICE year tag": r"\[\d{4}(?:, amended \d{4})?\]",
    "calendar date": rf"\b\d{{1,2}} {_MONTHS} \d{{4}}\b|\b{_MONTHS} \d{{1,2}}, \d{{4}}\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b",
    "year": r"\b(?:19|20)\d{2}\b",
    "recommendation ID": r"\b\d+\.\d+\.\d+\b",
    "statistical value": r"(?<![\w.])-?0\.\d+\b(?!\s?(?:mg|ml|g|%))",
}
# Categories that the number policy drops, in this order, and those counted without regard to case.
DROPPED_CATEGORIES = ("NICE year tag", "calendar date", "year", "recommendation ID", "statistical value")
CASELESS_CATEGORIES = ("dose", "duration")

# Tokenization problems of the domain.
DOMAIN_PROBLEMS = {
    "P1": r"\b[A-Za-z]+(?:-[A-Za-z]+)+\b",
    "P2": r"\S*‑\S*",
    "P3": r"(?<![\d-])\d{1,3}(?:\.\d+)?[–-]\d{1,3}(?:\.\d+)?(?![\d-])",
    "P4": r"\b\d+\.\d+\.\d+\b",
    "P5": r"\b[A-Z]{2,}(?:-?\d+|-[IVX]+)\b",
    "P6": r"https?://\S+[^\s.,;:)]|www\.\S+[^\s.,;:)]|\b[\w-]+\.(?:org|gov|com|uk|int)\b",
    "P7": r"\b1-8\d\d-\d{3}-\d{4}\b",
    "P8": r"\b\w+n't\b",
    "P9": r"(?<![./\w])[A-Za-z]+/[A-Za-z]+\b(?!/)",
    "P10": r"\b(?:e\.g|i\.e|etc)\.",
}
# What token categories look at.
URL_SHAPE = r"^(https?://|www\.)|\.(org|com|gov|uk|int|in)\b"
UNUSUAL_DASHES = "‐‑‒–—－"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Lines that cleaning drops.
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?\s*$"
TOC_LINE = r"(?i)(\.\s?){4,}\s*\d+\s*$|…{2,}\s*\d+\s*$|^\s*(table of\s+)?contents\s*$"
REFERENCES_HEADING = r"(?i)^\s*(\d+(\.\d+)*\.?\s+)?(references|bibliography|reference list|works cited|literature cited)\s*:?\s*$"
BOILERPLATE_LINES = (
    r"^skip to (main )?content$",
    r"^back to top$",
    r"^(share|print)( this page)?$",
    r"^.*\bcookies?\b.*$",
    r"^accept( all)?( cookies)?$",
    r"^next review due:.*$",
    r"^was this (page|information) (useful|helpful)\??$",
    r"^report a problem.*$",
    r"^(follow us|sign up).*$",
    r"^.*\(opens in (a )?new (tab|window)\)$",
)
LAST_REVIEWED = r"(?im)^page last reviewed:\s*(.+)$"


def java(pattern: str) -> str:
    """The pattern with Unicode classes, as this engine's expressions use it."""
    return "(?U)" + pattern


def re2(pattern: str) -> str:
    """The pattern for engines with ASCII classes; only for patterns without lookaround."""
    return pattern.replace(r"[^\w\s]", r"[^\p{L}\p{N}_\s]").replace(r"[\w-]", r"[\p{L}\p{N}_-]").replace(r"\w+n't", r"[\p{L}\p{N}_]+n't")
