"""Stemmers, from the published descriptions of the Snowball algorithms: English (Porter's revision of 2001), German, Swedish, Norwegian, Danish and Spanish."""

from __future__ import annotations

import re

_VOWELS = "aeiouy"
# Suffixes, endings and exceptions of the algorithm.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in "aeiouywxY"


def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    if word in _SAME:
        return word
    word = word.removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    m = re.match(r"gener|commun|arsen", word) or _REGION.search(word)
    r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    r2 = m.end() if m else len(word)

    for tail in ("'s'", "'s", "'"):
        if word.endswith(tail):
            word = word[: -len(tail)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _STAY:
        return word

    if word.endswith(("eed", "eedly")):
        cut = 3 if word.endswith("eed") else 5
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        for tail in ("ingly", "edly", "ing", "ed"):
            if word.endswith(tail):
                stem_ = word[: -len(tail)]
                if any(c in _VOWELS for c in stem_):
                    word = stem_
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(_DOUBLE):
                        word = word[:-1]
                    elif _short(word) and r1 >= len(word):
                        word += "e"
                break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    def ending(table) -> str:
        return next((t for t in sorted(table, key=len, reverse=True) if word.endswith(t)), "")

    tail = ending([*_STEP2, "ogi", "li"])
    if tail and len(word) - len(tail) >= r1:
        if tail == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif tail == "li":
            word = word[:-2] if word[-3] in "cdeghkmnrt" else word
        else:
            word = word[: -len(tail)] + _STEP2[tail]
    tail = ending([*_STEP3, "ative"])
    if tail and len(word) - len(tail) >= r1:
        if tail == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(tail)] + _STEP3[tail]
    tail = ending([*_STEP4, "ion"])
    if tail and len(word) - len(tail) >= r2:
        if tail != "ion" or word[-4:-3] in ("s", "t"):
            word = word[: -len(tail)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _regions(word: str, vowels: str, least: int = 0) -> tuple[int, int]:
    """Where the regions after the first and the second vowel-consonant pair begin; the first at `least` letters or more."""
    border = re.compile(f"[{vowels}][^{vowels}]")
    m = border.search(word)
    r1 = m.end() if m else len(word)
    m = border.search(word, r1)
    return max(r1, least), m.end() if m else len(word)


def _longest(word: str, suffixes, start: int) -> str:
    """The longest suffix of word that lies wholly from start on."""
    return max((x for x in suffixes if word.endswith(x) and len(word) - len(x) >= start), key=len, default="")


# The suffixes of each language.
_GERMAN_1, _GERMAN_2 = "em ern er e en es".split(), "en er est".split()
_SWEDISH = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()
_NORWEGIAN = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()
_DANISH = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()
_SPANISH_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_SPANISH_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_SPANISH_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_SPANISH_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_SPANISH_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id "
    "ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos "
    "imos áramos iéramos iésemos ásemos"
).split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    word = re.sub(f"(?<=[{vowels}])[uy](?=[{vowels}])", lambda m: m[0].upper(), word.replace("ß", "ss"))
    r1, r2 = _regions(word, vowels, 3)
    tail = _longest(word, _GERMAN_1, r1)
    if tail:
        word = word[: -len(tail)]
        if tail in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]
    elif word.endswith("s") and len(word) - 1 >= r1 and word[-2:-1] in tuple("bdfghklmnrt"):
        word = word[:-1]
    tail = _longest(word, _GERMAN_2, r1)
    if tail:
        word = word[: -len(tail)]
    elif word.endswith("st") and len(word) - 2 >= r1 and word[-3:-2] in tuple("bdfghklmnt") and len(word) >= 6:
        word = word[:-2]
    tail = _longest(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"), 0)
    if tail and len(word) - len(tail) >= r2:
        cut = word[: -len(tail)]
        if tail in ("end", "ung"):
            word = cut
            if word.endswith("ig") and len(word) - 2 >= r2 and not word.endswith("eig"):
                word = word[:-2]
        elif tail in ("ig", "ik", "isch"):
            word = word if cut.endswith("e") else cut
        elif tail in ("lich", "heit"):
            word = cut
            if word.endswith(("er", "en")) and len(word) - 2 >= r1:
                word = word[:-2]
        else:
            word = cut
            more = _longest(word, ("lich", "ig"), r2)
            word = word[: -len(more)] if more else word
    return word.lower().translate(str.maketrans("äöü", "aou"))


def swedish(word: str) -> str:
    r1, _ = _regions(word, "aeiouyäåö", 3)
    tail = _longest(word, _SWEDISH, r1)
    if tail:
        word = word[: -len(tail)]
    elif word.endswith("s") and len(word) - 1 >= r1 and word[-2:-1] in tuple("bcdfghjklmnoprtvy"):
        word = word[:-1]
    if _longest(word, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        word = word[:-1]
    tail = _longest(word, ("lig", "ig", "els", "löst", "fullt"), r1)
    return word[:-1] if tail in ("löst", "fullt") else word[: -len(tail)] if tail else word


def norwegian(word: str) -> str:
    vowels = "aeiouyæåø"
    r1, _ = _regions(word, vowels, 3)
    tail = _longest(word, [*_NORWEGIAN, "erte", "ert"], r1)
    if tail in ("erte", "ert"):
        word = word[: -len(tail)] + "er"
    elif tail:
        word = word[: -len(tail)]
    elif word.endswith("s") and len(word) - 1 >= r1 and (word[-2:-1] in tuple("bcdfghjlmnoprtvyz") or (word[-2:-1] == "k" and word[-3:-2] not in tuple(vowels))):
        word = word[:-1]
    if _longest(word, ("dt", "vt"), r1):
        word = word[:-1]
    tail = _longest(word, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"), r1)
    return word[: -len(tail)] if tail else word


def danish(word: str) -> str:
    vowels = "aeiouyæåø"
    r1, _ = _regions(word, vowels, 3)
    tail = _longest(word, _DANISH, r1)
    if tail:
        word = word[: -len(tail)]
    elif word.endswith("s") and len(word) - 1 >= r1 and word[-2:-1] in tuple("abcdfghjklmnoprtvyzå"):
        word = word[:-1]
    pairs = ("gd", "dt", "gt", "kt")
    if _longest(word, pairs, r1):
        word = word[:-1]
    if word.endswith("igst"):
        word = word[:-2]
    tail = _longest(word, ("ig", "lig", "elig", "els", "løst"), r1)
    if tail == "løst":
        word = word[:-1]
    elif tail:
        word = word[: -len(tail)]
        word = word[:-1] if _longest(word, pairs, r1) else word
    return word[:-1] if len(word) > 1 and word[-1] == word[-2] and word[-1] not in vowels and len(word) - 1 >= r1 else word


def spanish(word: str) -> str:
    vowels = "aeiouáéíóúü"
    r1, r2 = _regions(word, vowels)
    rv = len(word)
    if len(word) > 2:
        if word[1] not in vowels:
            m = re.compile(f"[{vowels}]").search(word, 2)
            rv = m.end() if m else rv
        elif word[0] in vowels:
            m = re.compile(f"[^{vowels}]").search(word, 2)
            rv = m.end() if m else rv
        else:
            rv = 3

    tail = _longest(word, _SPANISH_PRONOUNS, rv)
    if tail:
        cut = word[: -len(tail)]
        after = _longest(cut, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"), rv)
        if after and (after != "yendo" or cut.endswith("uyendo")):
            word = cut[: -len(after)] + after.translate(_ACUTE)
    before = word

    def drop(*ends: str) -> None:
        nonlocal word
        x = _longest(word, ends, r2)
        word = word[: -len(x)] if x else word

    tail = _longest(word, [*_SPANISH_PLAIN, *_SPANISH_IC, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"], 0)
    at = len(word) - len(tail)
    if tail == "amente":
        if at >= r1:
            word = word[:at]
            if word.endswith("iv"):
                n = len(word)
                drop("iv")
                if len(word) < n:
                    drop("at")
            else:
                drop("os", "ic", "ad")
    elif tail and at >= r2:
        word = word[:at]
        if tail in _SPANISH_IC:
            drop("ic")
        elif tail in ("logía", "logías"):
            word += "log"
        elif tail in ("ución", "uciones"):
            word += "u"
        elif tail in ("encia", "encias"):
            word += "ente"
        elif tail == "mente":
            drop("ante", "able", "ible")
        elif tail in ("idad", "idades"):
            drop("abil", "ic", "iv")
        elif tail in ("iva", "ivo", "ivas", "ivos"):
            drop("at")
    if word == before:
        tail = _longest(word, _SPANISH_Y, rv)
        if tail and word[: -len(tail)].endswith("u"):
            word = word[: -len(tail)]
        else:
            tail = _longest(word, [*_SPANISH_VERBS, "en", "es", "éis", "emos"], rv)
            if tail:
                word = word[: -len(tail)]
                if tail in ("en", "es", "éis", "emos") and word.endswith("gu"):
                    word = word[:-1]
    tail = _longest(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if tail:
        word = word[: -len(tail)]
        if tail in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_ACUTE)


STEMMERS = {"en": english, "de": german, "sv": swedish, "no": norwegian, "nb": norwegian, "da": danish, "es": spanish}


def stem(word: str, lang: str = "en") -> str | None:
    """The stem of a lower-case word; None where the language (a two-letter tag) has no stemmer here."""
    own = STEMMERS.get(lang[:2])
    return own(word) if own else None
