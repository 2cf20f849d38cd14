"""Porter2 (Snowball English), Porter and Lancaster stemmers, written from their published descriptions.

They are loops over one word, so they run on distinct words only (:func:`stem_table`) and join back.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Porter2's exceptional forms.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STAYS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes of Porter2's steps 2, 3 and 4.
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, begin: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    m = re.search(r"[aeiouy][^aeiouy]", word[begin:])
    return begin + m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"(^|[^aeiouy])[aeiouy][^aeiouywxY]$", word)) if len(word) > 2 else bool(re.fullmatch(r"[aeiouy][^aeiouy]", word))


@lru_cache(200_000)
def porter2(word: str) -> str:
    w = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w)
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):  # step 0
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):  # step 1a
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif not w.endswith(("us", "ss")) and w.endswith("s") and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _STAYS:
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):  # step 1b
        if w.endswith(s):
            if s in ("eedly", "eed"):
                w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
            elif re.search("[aeiouy]", w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:  # step 1c
        w = w[:-1] + "i"
    for s, r in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ogi" or w[at - 1 : at] == "l") and (s != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + r
            break
    for s, r in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + r
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):  # step 5
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def _measure(stem: str) -> int:
    """Porter's measure: how often vowels are followed by consonants."""
    return len(re.findall("vc", re.sub("c+", "c", re.sub("v+", "v", _shape(stem)))))


def _shape(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


# Suffixes of the original Porter algorithm's steps 2 to 4.
_P2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_P3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_P4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(200_000)
def porter(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    more = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        w, more = w[:-2], True
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        w, more = w[:-3], True
    cvc = lambda s: len(s) > 2 and _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"
    if more:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_P2, _P3):
        for s, r in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(s):
                w = w[: -len(s)] + r if _measure(w[: -len(s)]) > 0 else w
                break
    for s in sorted(_P4, key=lambda x: -len(x)):
        if w.endswith(s):
            if _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# The published Lancaster rules: reversed ending, * for untouched words only, letters to remove, to append, > on or . end.
_LANCASTER = """ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2.
hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1.
lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1.
re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3>
tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2>
ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s.""".split()
_RULE = re.compile(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])")
_RULES = [(m[1][::-1], bool(m[2]), int(m[3]), m[4], m[5]) for m in map(_RULE.fullmatch, _LANCASTER) if m]


@lru_cache(200_000)
def lancaster(word: str) -> str:
    w = whole = word.lower()
    on = True
    while on:
        on = False
        for end, whole_only, cut, add, go in _RULES:
            if not w.endswith(end) or whole_only and w != whole:
                continue
            rest = w[: len(w) - cut] + add
            # What stays must be pronounceable: two letters after a vowel, or three with a vowel.
            if cut and not (len(rest) >= 2 if w[0] in "aeiou" else len(rest) >= 3 and re.search("[aeiouy]", rest)):
                continue
            w, on = rest, go == ">"
            break
    return w


STEMMERS = {"Porter": porter, "Snowball": porter2, "Lancaster": lancaster}


def stem_table(words: DataFrame, stemmer: str = "Snowball", word: str = "word") -> DataFrame:
    """word, stem for each distinct word; join it back on the word."""
    fn = STEMMERS[stemmer]

    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    # Else a filter on stems would be made below the distinct words, and every token be stemmed.
    return words.select(F.col(word).alias("word")).distinct().withColumn("stem", stem.asNondeterministic()("word"))
