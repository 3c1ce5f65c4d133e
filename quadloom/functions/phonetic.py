"""Double metaphone codes, after the published description of the algorithm (Philips, 2000): up to four sounds each."""

from __future__ import annotations

_VOWELS = frozenset("AEIOUY")
LENGTH = 4


class _Word:
    def __init__(self, word: str):
        self.w = word.upper()
        self.n = len(self.w)
        self.last = self.n - 1
        self.slavic = "W" in self.w or "K" in self.w or "CZ" in self.w or "WITZ" in self.w

    def __getitem__(self, i: int) -> str:
        return self.w[i] if 0 <= i < self.n else ""

    def has(self, i: int, *options: str) -> bool:
        return i >= 0 and any(self.w[i : i + len(o)] == o and i + len(o) <= self.n for o in options)

    def vowel(self, i: int) -> bool:
        return self[i] in _VOWELS and 0 <= i < self.n

    @property
    def germanic(self) -> bool:
        return self.has(0, "VAN ", "VON ", "SCH")


# For each letter: (first code, second code, letters used) from a place in a word.


def _b(s: _Word, i: int):
    return "P", "P", 2 if s[i + 1] == "B" else 1


def _c(s: _Word, i: int):
    if i > 1 and not s.vowel(i - 2) and s.has(i - 1, "ACH") and s[i + 2] != "I" and (s[i + 2] != "E" or s.has(i - 2, "BACHER", "MACHER")):
        return "K", "K", 2
    if i == 0 and s.has(0, "CAESAR"):
        return "S", "S", 2
    if s.has(i, "CHIA"):
        return "K", "K", 2
    if s.has(i, "CH"):
        if i > 0 and s.has(i, "CHAE"):
            return "K", "X", 2
        if i == 0 and (s.has(1, "HARAC", "HARIS") or s.has(1, "HOR", "HYM", "HIA", "HEM")) and not s.has(0, "CHORE"):
            return "K", "K", 2
        greek = s.has(i - 2, "ORCHES", "ARCHIT", "ORCHID") or s[i + 2] in ("T", "S")
        before = i == 0 or s[i - 1] in ("A", "O", "U", "E")
        if s.germanic or greek or (before and (s[i + 2] in tuple("LRNMBHFVW ") or i + 1 == s.last)):
            return "K", "K", 2
        if i > 0:
            return ("K", "K", 2) if s.has(0, "MC") else ("X", "K", 2)
        return "X", "X", 2
    if s.has(i, "CZ") and not s.has(i - 2, "WICZ"):
        return "S", "X", 2
    if s.has(i + 1, "CIA"):
        return "X", "X", 3
    if s.has(i, "CC") and not (i == 1 and s[0] == "M"):
        if s[i + 2] in ("I", "E", "H") and not s.has(i + 2, "HU"):
            if (i == 1 and s[0] == "A") or s.has(i - 1, "UCCEE", "UCCES"):
                return "KS", "KS", 3
            return "X", "X", 3
        return "K", "K", 2
    if s.has(i, "CK", "CG", "CQ"):
        return "K", "K", 2
    if s.has(i, "CI", "CE", "CY"):
        return ("S", "X", 2) if s.has(i, "CIO", "CIE", "CIA") else ("S", "S", 2)
    if s.has(i + 1, " C", " Q", " G"):
        return "K", "K", 3
    return "K", "K", 2 if s[i + 1] in ("C", "K", "Q") and not s.has(i + 1, "CE", "CI") else 1


def _d(s: _Word, i: int):
    if s.has(i, "DG"):
        return ("J", "J", 3) if s[i + 2] in ("I", "E", "Y") else ("TK", "TK", 2)
    return "T", "T", 2 if s.has(i, "DT", "DD") else 1


def _g(s: _Word, i: int):
    if s[i + 1] == "H":
        if i > 0 and not s.vowel(i - 1):
            return "K", "K", 2
        if i == 0:
            return ("J", "J", 2) if s[2] == "I" else ("K", "K", 2)
        if (i > 1 and s[i - 2] in ("B", "H", "D")) or (i > 2 and s[i - 3] in ("B", "H", "D")) or (i > 3 and s[i - 4] in ("B", "H")):
            return "", "", 2
        if i > 2 and s[i - 1] == "U" and s[i - 3] in ("C", "G", "L", "R", "T"):
            return "F", "F", 2
        return ("K", "K", 2) if i > 0 and s[i - 1] != "I" else ("", "", 2)
    if s[i + 1] == "N":
        if i == 1 and s.vowel(0) and not s.slavic:
            return "KN", "N", 2
        return ("N", "KN", 2) if not s.has(i + 2, "EY") and s[i + 1] != "Y" and not s.slavic else ("KN", "KN", 2)
    if s.has(i + 1, "LI") and not s.slavic:
        return "KL", "L", 2
    if i == 0 and (s[1] == "Y" or s.has(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        return "K", "J", 2
    if (s.has(i + 1, "ER") or s[i + 1] == "Y") and not s.has(0, "DANGER", "RANGER", "MANGER") and s[i - 1] not in ("E", "I") and not s.has(i - 1, "RGY", "OGY"):
        return "K", "J", 2
    if s[i + 1] in ("E", "I", "Y") or s.has(i - 1, "AGGI", "OGGI"):
        if s.germanic or s.has(i + 1, "ET"):
            return "K", "K", 2
        return ("J", "J", 2) if s.has(i + 1, "IER") and i + 3 == s.last else ("J", "K", 2)
    return "K", "K", 2 if s[i + 1] == "G" else 1


def _h(s: _Word, i: int):
    return ("H", "H", 2) if (i == 0 or s.vowel(i - 1)) and s.vowel(i + 1) else ("", "", 1)


def _j(s: _Word, i: int):
    if s.has(i, "JOSE") or s.has(0, "SAN "):
        return ("H", "H", 1) if (i == 0 and s.n == 4) or s.has(0, "SAN ") else ("J", "H", 1)
    step = 2 if s[i + 1] == "J" else 1
    if i == 0:
        return "J", "A", step
    if s.vowel(i - 1) and not s.slavic and s[i + 1] in ("A", "O"):
        return "J", "H", step
    if i == s.last:
        return "J", "", step
    if s[i + 1] not in tuple("LTKSNMBZ") and s[i - 1] not in ("S", "K", "L"):
        return "J", "J", step
    return "", "", step


def _l(s: _Word, i: int):
    if s[i + 1] == "L":
        spanish = (i == s.n - 3 and s.has(i - 1, "ILLO", "ILLA", "ALLE")) or ((s.has(s.last - 1, "AS", "OS") or s[s.last] in ("A", "O")) and s.has(i - 1, "ALLE"))
        return ("L", "", 2) if spanish else ("L", "L", 2)
    return "L", "L", 1


def _m(s: _Word, i: int):
    silent = s.has(i - 1, "UMB") and (i + 1 == s.last or s.has(i + 2, "ER"))
    return "M", "M", 2 if silent or s[i + 1] == "M" else 1


def _p(s: _Word, i: int):
    if s[i + 1] == "H":
        return "F", "F", 2
    return "P", "P", 2 if s[i + 1] in ("P", "B") else 1


def _r(s: _Word, i: int):
    step = 2 if s[i + 1] == "R" else 1
    if i == s.last and not s.slavic and s.has(i - 2, "IE") and not s.has(i - 4, "ME", "MA"):
        return "", "R", step
    return "R", "R", step


def _s(s: _Word, i: int):
    if s.has(i - 1, "ISL", "YSL"):
        return "", "", 1
    if i == 0 and s.has(0, "SUGAR"):
        return "X", "S", 1
    if s.has(i, "SH"):
        return ("S", "S", 2) if s.has(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else ("X", "X", 2)
    if s.has(i, "SIO", "SIA"):
        return ("S", "S", 3) if s.slavic else ("S", "X", 3)
    if (i == 0 and s[1] in ("M", "N", "L", "W")) or s[i + 1] == "Z":
        return "S", "X", 2 if s[i + 1] == "Z" else 1
    if s.has(i, "SC"):
        if s[i + 2] == "H":
            if s.has(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                return ("X", "SK", 3) if s.has(i + 3, "ER", "EN") else ("SK", "SK", 3)
            return ("X", "S", 3) if i == 0 and not s.vowel(3) and s[3] != "W" else ("X", "X", 3)
        return ("S", "S", 3) if s[i + 2] in ("I", "E", "Y") else ("SK", "SK", 3)
    step = 2 if s[i + 1] in ("S", "Z") else 1
    return ("", "S", step) if i == s.last and s.has(i - 2, "AI", "OI") else ("S", "S", step)


def _t(s: _Word, i: int):
    if s.has(i, "TION", "TIA", "TCH"):
        return "X", "X", 3
    if s.has(i, "TH", "TTH"):
        return ("T", "T", 2) if s.has(i + 2, "OM", "AM") or s.germanic else ("0", "T", 2)
    return "T", "T", 2 if s[i + 1] in ("T", "D") else 1


def _w(s: _Word, i: int):
    if s.has(i, "WR"):
        return "R", "R", 2
    if i == 0 and (s.vowel(1) or s[1] == "H"):
        return ("A", "F", 1) if s.vowel(1) else ("A", "A", 1)
    if (i == s.last and s.vowel(i - 1)) or s.has(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or s.has(0, "SCH"):
        return "", "F", 1
    return ("TS", "FX", 4) if s.has(i, "WICZ", "WITZ") else ("", "", 1)


def _x(s: _Word, i: int):
    if i == 0:
        return "S", "S", 1
    silent = i == s.last and (s.has(i - 3, "IAU", "EAU") or s.has(i - 2, "AU", "OU"))
    return "" if silent else "KS", "" if silent else "KS", 2 if s[i + 1] in ("C", "X") else 1


def _z(s: _Word, i: int):
    if s[i + 1] == "H":
        return "J", "J", 2
    step = 2 if s[i + 1] == "Z" else 1
    if s.has(i + 1, "ZO", "ZI", "ZA") or (s.slavic and i > 0 and s[i - 1] != "T"):
        return "S", "TS", step
    return "S", "S", step


def _plain(code: str):
    return lambda s, i: (code, code, 2 if s[i + 1] == s[i] else 1)


_RULES = {"B": _b, "C": _c, "D": _d, "F": _plain("F"), "G": _g, "H": _h, "J": _j, "K": _plain("K"), "L": _l, "M": _m, "N": _plain("N"), "P": _p, "Q": _plain("K"), "R": _r, "S": _s, "T": _t, "V": _plain("F"), "W": _w, "X": _x, "Z": _z}
_RULES |= {"Ç": lambda s, i: ("S", "S", 1), "Ñ": lambda s, i: ("N", "N", 1)}


def double_metaphone(word: str) -> tuple[str, str]:
    """The first and the second code of a word; equal where there is one pronunciation."""
    s = _Word(word)
    i = 1 if s.has(0, "GN", "KN", "PN", "WR", "PS") else 0
    first = second = ""
    if s[0] == "X":
        first = second = "S"
        i = 1
    while i < s.n and (len(first) < LENGTH or len(second) < LENGTH):
        if s.vowel(i):
            a = b = "A" if i == 0 else ""
            step = 1
        elif s[i] in _RULES:
            a, b, step = _RULES[s[i]](s, i)
        else:
            a, b, step = "", "", 1
        first, second, i = first + a, second + b, i + step
    return first[:LENGTH], second[:LENGTH]
