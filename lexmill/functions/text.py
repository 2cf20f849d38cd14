"""Text operators as Column expressions: sentences, tokens, terms, number policy, stop words, light stemming, cleaning.

Everything here is built-in functions, so plans stay in the JVM and in whole-stage code.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import lexicon, patterns
from lexmill.functions.patterns import java


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def matches(text: Column | str, pattern: str) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(_col(text), F.lit(java(pattern)), F.lit(0))


# Sentences


def split_on_dot(text) -> Column:
    """Pieces between dots, trimmed; empty ones dropped."""
    return F.filter(F.transform(F.split(_col(text), r"\."), lambda x: F.trim(x)), lambda x: x != "")


def lines(text) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(_col(text), "\n"), lambda x: x.rlike(r"\S"))


#: After these a dot ends no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "vs.", "No.")
_GUARD = r"(?<!\b(?:" + "|".join(a[:-1].replace(".", r"\.") for a in ABBREVIATIONS) + r")\.)"


def split_by_rule(text) -> Column:
    """Sentences end at a run of ``.!?`` (and a closing quote or bracket) before white space and a capital, digit or quote."""
    return F.filter(F.split(_col(text), java(r"(?=\s)(?<=[.!?][\"')\]]?)" + _GUARD + r"\s+(?=[\"'(\[]?[\p{Lu}\p{N}])")), lambda x: x.rlike(r"\S"))


def sentences(text) -> Column:
    """Line first, then the sentence rule within each line, so headings and list items stay apart."""
    return F.flatten(F.transform(lines(text), split_by_rule))


SPLITTERS = {"dot": split_on_dot, "rule": split_by_rule, "line + rule": sentences, "line": lines}


# Tokens and terms


def whitespace_tokens(text) -> Column:
    return F.filter(F.split(_col(text), java(r"\s+")), lambda x: x != "")


def normalise(text) -> Column:
    """One kind of hyphen, and negative contractions written out."""
    t = F.replace(_col(text), F.lit("‑"), F.lit("-"))
    t = F.regexp_replace(t, r"(?U)(?i)\bcan't\b", "can not")
    t = F.regexp_replace(t, r"(?U)(?i)\bwon't\b", "will not")
    return F.regexp_replace(t, r"(?U)n't\b", " not")


def tokens(text) -> Column:
    """The custom tokenizer. Its word rules are ASCII: other letters are dropped and split words."""
    return matches(normalise(text), patterns.FAST_TOKEN)


def treebank_tokens(text) -> Column:
    """The published Treebank conventions: punctuation apart, contractions split."""
    t = _col(text)
    for p, r in (
        (r'^"', "`` "), (r'([ (\[{<])"', "$1 `` "), (r"\.\.\.", " ... "), (r"([,;:@#$%&])", " $1 "), (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3"),
        (r"([?!])", " $1 "), (r"([\]\[(){}<>])", " $1 "), (r"--", " -- "), (r'"', " '' "), (r"(?i)('s|'m|'d|'ll|'re|'ve)\b", " $1"), (r"(?i)(n't)\b", " $1"),
    ):
        t = F.regexp_replace(t, java(p), r)
    return whitespace_tokens(t)


TOKENIZERS = {"whitespace": whitespace_tokens, "treebank": treebank_tokens, "custom": tokens}
_STRIP = "[" + "".join("\\" + c for c in patterns.ASCII_PUNCTUATION) + "]+"
_ALNUM = r"[\p{L}\p{N}]"


def has_alnum(token) -> Column:
    return _col(token).rlike(_ALNUM)


def to_term(token) -> Column:
    """Lower-cased, without punctuation at both ends; null without letter or digit."""
    t = F.regexp_replace(F.lower(_col(token)), f"^{_STRIP}|{_STRIP}$", "")
    return F.when(t.rlike(_ALNUM), t)


def terms(words: Column) -> Column:
    return F.filter(F.transform(words, to_term), lambda x: x.isNotNull())


def token_category(token) -> Column:
    """One of ten categories; the first that fits."""
    t = _col(token)
    stripped = F.regexp_replace(t, f"^{_STRIP}|{_STRIP}$", "")
    return (
        F.when(~t.rlike(_ALNUM), "punctuation only")
        .when(t.rlike("(?i)" + patterns.URL_SHAPE), "URL / web address")
        .when(t.rlike(f"[{patterns.UNUSUAL_DASHES}]"), "unusual dash")
        .when(t != stripped, "punctuation attached")
        .when(t.rlike(r"^\p{L}+$"), "plain word")
        .when(~t.rlike(r"\p{L}"), "number")
        .when(t.contains("-"), "hyphenated")
        .when(t.contains("/"), "contains /")
        .when(t.rlike(r"\p{Nd}"), "letters + digits")
        .otherwise("other")
    )


def number_policy(text) -> Column:
    """Puts a blank for each number of a dropped category, category after category."""
    t = _col(text)
    for c in patterns.DROPPED_CATEGORIES:
        t = F.regexp_replace(t, java(patterns.NUMBER_CATEGORIES[c]), " ")
    return t


def content_tokens(text) -> Column:
    """Number policy, custom tokens, lower case, only those with a letter or digit."""
    t = _col(text)
    found = F.when(t.rlike(patterns.NOT_PLAIN), matches(normalise(number_policy(t)), patterns.FAST_CONTENT)).otherwise(matches(t, patterns.PLAIN_CONTENT))
    return F.transform(found, F.lower)


def without(words: Column, stop: tuple[str, ...]) -> Column:
    """Drops stop words by surface form."""
    return F.filter(words, lambda x: ~x.isin(*stop))


# Stemming that expressions can say


def regexp_stem(word) -> Column:
    w = _col(word)
    return F.when(F.length(w) >= 4, F.regexp_replace(w, "ing$|ed$|ly$|es$|s$", "")).otherwise(w)


def light_stem(word) -> Column:
    """Takes off inflections only, from words of letters that are longer than four."""
    w = _col(word)
    less = lambda n: F.left(w, F.length(w) - n)
    return (
        F.when((F.length(w) <= 4) | ~w.rlike(r"^\p{L}+$"), w)
        .when(w.rlike("(ss|us|is)$"), w)
        .when(w.endswith("ies"), F.concat(less(3), F.lit("y")))
        .when(w.rlike("(sses|ches|shes|xes)$"), less(2))
        .when(w.endswith("ing") & (F.length(w) >= 7), less(3))
        .when(w.endswith("ed") & (F.length(w) >= 6), less(2))
        .when(w.endswith("s") & (F.length(w) >= 5), less(1))
        .otherwise(w)
    )


def may_stem(word) -> Column:
    """Has one of the endings that :func:`light_stem` takes off."""
    w = _col(word)
    return w.endswith("s") | w.endswith("ed") | w.endswith("ing")


def rule_lemma(word) -> Column:
    """Deterministic lemma: exceptions and irregular forms, else the light stem. Stands in for a statistical model.

    A plural acronym (two capitals or more, then s) loses its s; other words are taken as lower-cased already.
    """
    w = _col(word)
    w = F.when(w.rlike("^[A-Z]{2,}s$"), F.lower(F.left(w, F.length(w) - 1))).otherwise(w)
    table = lexicon.IRREGULAR_LEMMAS | lexicon.LEMMA_EXCEPTIONS
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, w), light_stem(w))


# N-grams


def ngrams(words: Column, n: int) -> Column:
    """Every n neighbours, as arrays."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(words, i, n))).otherwise(F.array().cast("array<array<string>>"))


# Cleaning


def clean_characters(text) -> Column:
    """Ligatures, quotes, special blanks, invisible and control characters, bullets and line ends in one form. (Text is taken as composed.)"""
    # Characters and what stands for them.
    ligatures = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
    t = F.regexp_replace(_col(text), "\r\n?", "\n")
    for a, b in ligatures.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, "\u2018\u2019\u201a\u201b\u2032\u201c\u201d\u201e\u2033", "'''''" + '"' * 4)
    t = F.translate(t, "\u00a0\u2002\u2003\u2009\u200a\u202f\u3000", " " * 7)
    t = F.translate(t, "\u00ad\u200b\u200c\u200d\u2060\ufeff", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[•‣⁃∙▪▫●○■□◦➢►▶✓✔·][ \t]*|(?m)^[ \t]*y[ \t]+(?=\S)", "• ")
    return F.regexp_replace(t, r"[\x{E000}-\x{F8FF}]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def drop_lines(text, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(_col(text), "\n"), lambda x: ~F.trim(x).rlike(pattern)), "\n")


def drop_boilerplate(text) -> Column:
    return drop_lines(text, "(?i)" + "|".join(f"(?:{p})" for p in patterns.BOILERPLATE_LINES))


def last_reviewed(text) -> Column:
    return F.regexp_extract(_col(text), patterns.LAST_REVIEWED, 1)


def drop_toc(text) -> Column:
    return F.array_join(F.filter(F.split(_col(text), "\n"), lambda x: ~x.rlike(patterns.TOC_LINE)), "\n")


def cut_references(text, least: float = 0.6) -> Column:
    """Text before the first references heading that begins in the last part of it. One running sum over the lines."""
    rows, size = F.split(_col(text), "\n"), F.length(_col(text))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), none.alias("cut"))

    def step(s, line):
        hit = s["cut"].isNull() & (s["at"] >= least * size) & line.rlike(patterns.REFERENCES_HEADING)
        return F.struct((s["i"] + 1).alias("i"), (s["at"] + F.length(line) + 1).alias("at"), F.when(hit, s["i"]).otherwise(s["cut"]).alias("cut"))

    # Most texts have no such line, and need no sum.
    cut = F.when(_col(text).rlike("(?im)" + patterns.REFERENCES_HEADING.removeprefix("(?i)")), F.aggregate(rows, start, step)["cut"])
    return F.when(cut.isNotNull(), F.array_join(F.slice(rows, 1, cut), "\n")).otherwise(_col(text))


#: First parts that keep their hyphen.
HYPHEN_PREFIXES = tuple(
    "self non well long short first second third follow high low one two three peer age evidence person family short-term long-term post pre co re ex".split()
)


def join_hyphens(text) -> Column:
    """Words cut at a line's end are put together at the end of that line; what follows begins the next.

    The hyphen stays after certain first parts, or where this text has the hyphenated form more often than the joined one.
    Which is right depends on counts in the same text, so this is a loop over texts in Arrow batches.
    """
    cut, word = re.compile(r"\b([A-Za-z]+)-\n[ \t]*([a-z][A-Za-z]*)"), re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)*")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None or "-\n" not in t:
                return t
            forms = Counter(word.findall(t.lower()))

            def whole(m):
                first, rest = m.groups()
                kept, joined = f"{first}-{rest}", first + rest
                return (kept if first.lower() in HYPHEN_PREFIXES or forms[kept.lower()] > forms[joined.lower()] else joined) + "\n"

            return cut.sub(whole, t)

        return texts.map(one)

    return run(_col(text))


def drop_bullets(text) -> Column:
    return F.regexp_replace(_col(text), r"(?m)^[ \t]*• ?", "")


def unwrap_lines(text) -> Column:
    """Joins a line that goes on in lower case to an unfinished one before; then bullets' marks go."""
    joined = F.aggregate(
        F.split(_col(text), "\n"),
        F.array().cast("array<string>"),
        lambda done, x: F.when(
            x.rlike(r"^[a-z(]") & (F.size(done) > 0) & ~F.coalesce(F.try_element_at(done, F.lit(-1)).rlike(r"^\s*$|[.!?:;]\s*$"), F.lit(True)),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.lit(" "), x))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return drop_bullets(F.array_join(joined, "\n"))


def clean_whitespace(text) -> Column:
    t = F.array_join(F.transform(F.split(_col(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    return F.concat(F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"\A\s+|\s+\z", ""), F.lit("\n"))


#: Rules in order: name, the format they are for (None: all), rule, and what stands in for it in other formats.
CLEANERS = (
    ("normalise_characters", None, clean_characters, None),
    ("html_boilerplate", "html", drop_boilerplate, None),
    ("toc_lines", None, drop_toc, None),
    ("reference_section", None, cut_references, None),
    ("hyphenated_linebreaks", "pdf", join_hyphens, None),
    ("unwrap_lines", "pdf", unwrap_lines, drop_bullets),
    ("whitespace", None, clean_whitespace, None),
)


def clean(text, kind: str = "txt") -> tuple[Column, Column]:
    """The cleaned text of a document of one format, and a log: rule, change in characters and whether it was for this format, in order.

    Running headers and footers are found over the pages of a document (:func:`lexmill.operators.sections`) before this.
    """
    t, log = _col(text), []
    for name, only, rule, other in CLEANERS:
        mine = only in (None, kind)
        new = rule(t) if mine else other(t) if other else t
        log.append(F.struct(F.lit(name).alias("rule"), (F.length(new) - F.length(t)).alias("chars_delta"), F.lit(mine).alias("applied")))
        t = new
    return t, F.array(*log)
