"""The Snowball English stemmer (Porter2), written from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
    ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=len, reverse=True)


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _regions(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _region(word, 0) if r1 is None else r1
    return r1, _region(word, r1)


def _short_syllable(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").lstrip("'") if word[0] in "'’" else word.replace("’", "'")
    if word in WHOLE:
        return WHOLE[word]
    if word and word[0] == "y":
        word = "Y" + word[1:]
    word = re.sub("(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    for s in ("'s'", "'s", "'"):
        if word.endswith(s):
            word = word[: -len(s)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(s):
            bare = word[: -len(s)]
            if s in ("eedly", "eed"):
                if len(bare) >= r1:
                    word = bare + "ee"
            elif re.search("[aeiouy]", bare):
                word = bare
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _short_syllable(word):
                    word += "e"
            break
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # 2
    for s, t in STEP2:
        if word.endswith(s):
            bare = word[: -len(s)]
            if len(bare) >= r1 and (s != "ogi" or bare.endswith("l")) and (s != "li" or bare[-1:] in tuple(LI)):
                word = bare + t
            break
    # 3
    for s, t in STEP3:
        if word.endswith(s):
            bare = word[: -len(s)]
            if len(bare) >= r1 and (s != "ative" or len(bare) >= r2):
                word = bare + t
            break
    # 4
    for s in STEP4:
        if word.endswith(s):
            bare = word[: -len(s)]
            if len(bare) >= r2 and (s != "ion" or bare[-1:] in ("s", "t")):
                word = bare
            break
    # 5
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def kept(term: str) -> str:
    """What all words of letters and digits begin with whose stem this is: suffixes are cut or replaced by ones that differ in their last two letters at most."""
    return term[:-2]
