"""The English (Porter2) stemmer, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = "cdeghkmnrt"
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
REGION_EXCEPTIONS = ("gener", "commun", "arsen")

_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    head = next((p for p in REGION_EXCEPTIONS if word.startswith(p)), None)
    m = None if head else _REGION.search(word)
    r1 = len(head) if head else m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word))


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of one word, lower-cased."""
    word = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    for end in ("'s'", "'s", "'"):  # step 0
        if word.endswith(end):
            word = word[: -len(end)]
            break
    word = _plural(word)
    if word in AFTER_1A:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:  # step 1c
        word = word[:-1] + "i"
    end = _longest(word, STEP_2)
    if end and len(word) - len(end) >= r1 and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3:-2] and word[-3] in LI_ENDING):
        word = word[: -len(end)] + STEP_2[end]
    end = _longest(word, STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):  # step 5
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _plural(word: str) -> str:
    """Step 1a."""
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if re.search(r"[aeiouy].", word[:-1]) else word


def _past(word: str, r1: int) -> str:
    """Step 1b."""
    for end in ("eedly", "eed"):
        if word.endswith(end):
            return word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    for end in ("ingly", "edly", "ing", "ed"):
        if word.endswith(end):
            root = word[: -len(end)]
            if not re.search("[aeiouy]", root):
                return word
            if root.endswith(("at", "bl", "iz")):
                return root + "e"
            if root.endswith(DOUBLES):
                return root[:-1]
            return root + "e" if r1 >= len(root) and _short_end(root) else root
    return word
