"""English words for full-text search: tokens, stop words, and stems by the published Porter2 rules."""

from __future__ import annotations

import re
from functools import lru_cache

import regex

# fixed values: the common English stop list
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())
WORDS = regex.compile(r"[\p{L}\p{N}]+")
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# fixed values: whole words with a stem of their own, and words that end after the first step
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# fixed values: suffixes of the second, third and fourth step with what takes their place
SECOND = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion",
    "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al",
    "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SPECIAL = re.compile(r"gener|commun|arsen")


def _after_vowel(word: str, start: int = 0) -> int:
    """Where the part behind the first non-vowel that follows a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ends(word: str, suffixes) -> str:
    """The longest suffix that the word ends in; the suffixes come longest first."""
    return next((s for s in suffixes if word.endswith(s)), "")


def _short_end(word: str) -> bool:
    """A last syllable that is short: consonant, vowel, consonant other than w, x and Y; or a vowel and a consonant as the whole word."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    letters = list(word)
    for i, c in enumerate(letters):  # a y that stands for a consonant
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    word = "".join(letters)
    special = _SPECIAL.match(word)
    r1 = special.end() if special else _after_vowel(word)
    r2 = _after_vowel(word, r1)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in UNCHANGED:
        return word

    found = _ends(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if found in ("eed", "eedly"):
        if len(word) - len(found) >= r1:
            word = word[: -len(found)] + "ee"
    elif found and any(c in VOWELS for c in word[: -len(found)]):
        word = word[: -len(found)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif _short_end(word) and len(word) <= r1:
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    found = _ends(word, SECOND)
    at = len(word) - len(found)
    if found and at >= r1 and not (found == "ogi" and word[at - 1] != "l") and not (found == "li" and word[at - 1] not in "cdeghkmnrt"):
        word = word[:at] + SECOND[found]
    found = _ends(word, THIRD)
    at = len(word) - len(found)
    if found and at >= (r2 if found == "ative" else r1):
        word = word[:at] + THIRD[found]
    found = _ends(word, FOURTH)
    at = len(word) - len(found)
    if found and at >= r2 and not (found == "ion" and word[at - 1] not in "st"):
        word = word[:at]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def lexemes(text: str) -> list[tuple[int, str]]:
    """(position, stem) of the words of a text that are no stop words; positions count all words, from 1."""
    return [(i, stem(w)) for i, w in enumerate(WORDS.findall(text.lower()), 1) if w not in STOP_WORDS]
