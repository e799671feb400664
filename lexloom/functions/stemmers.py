"""English stemmers; both run on the distinct vocabulary, never on running text.

The dictionary stemmer (Krovetz 1993) takes its lexicon as a table (word, root, is_exception); none
is bundled.  The suffix stemmer follows the published English (Porter2) algorithm.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Lexicon = Mapping[str, tuple[str | None, bool]]


def lexicon(rows: Iterable[tuple[str, str | None, bool]]) -> dict[str, tuple[str | None, bool]]:
    """A lexicon from (word, root or None, is_exception); later rows replace earlier ones."""
    return {word: (root, bool(exception)) for word, root, exception in rows}


class Krovetz:
    """The dictionary stemmer: after each step a word that the lexicon knows is the stem."""

    def __init__(self, words: Lexicon):
        self.words = words

    def known(self, w: str) -> bool:
        return w in self.words

    def plain(self, w: str) -> bool:
        """Known and not an exception."""
        return w in self.words and not self.words[w][1]

    def __call__(self, word: str) -> str:
        w = word.lower()
        if not 1 < len(w) < 99 or not re.fullmatch("[a-z]+", w):
            return w
        for step in (None, *self.STEPS):
            if step is not None:
                w = step(self, w)
            if w in self.words:
                return self.words[w][0] or w
        return w

    # helpers

    @staticmethod
    def cut(w: str, suffix: str) -> str | None:
        """What comes before the suffix, if anything does."""
        return w[: -len(suffix)] if w.endswith(suffix) and len(w) > len(suffix) else None

    @staticmethod
    def consonant(w: str, k: int) -> bool:
        if w[k] in "aeiou":
            return False
        return w[k] != "y" or k == 0 or not Krovetz.consonant(w, k - 1)

    @classmethod
    def has_vowel(cls, s: str) -> bool:
        return any(not cls.consonant(s, k) for k in range(len(s)))

    @classmethod
    def doubled(cls, s: str) -> bool:
        return len(s) >= 3 and s[-1] == s[-2] and cls.consonant(s, len(s) - 1)

    def pick(self, *options: str) -> str | None:
        return next((o for o in options if self.known(o)), None)

    # steps, in order

    def plural(self, w: str) -> str:
        if not w.endswith("s"):
            return w
        if (s := self.cut(w, "ies")) is not None:
            return self.pick(s + "ie", s) or s + "y"
        if (s := self.cut(w, "es")) is not None:
            if len(s) >= 2 and self.known(s + "e") and not s.endswith("ss"):
                return s + "e"
            return s if self.known(s) else s + "e"
        return w if len(w) <= 3 or w.endswith(("ous", "ss")) else w[:-1]

    def past(self, w: str) -> str:
        if len(w) <= 4:
            return w
        if (s := self.cut(w, "ied")) is not None:
            return self.pick(s + "ie") or s + "y"
        if (s := self.cut(w, "ed")) is not None and self.has_vowel(s):
            if self.plain(s + "e"):
                return s + "e"
            if self.known(s):
                return s
            if self.doubled(s):
                return s[:-1] if self.known(s[:-1]) else s
            return w if s.startswith("un") else s + "e"
        return w

    def aspect(self, w: str) -> str:
        if len(w) > 5 and (s := self.cut(w, "ing")) is not None and self.has_vowel(s):
            if self.plain(s + "e"):
                return s + "e"
            if self.known(s):
                return s
            if self.doubled(s):
                return s[:-1] if self.known(s[:-1]) else s
            if len(s) > 1 and self.consonant(s, len(s) - 1) and self.consonant(s, len(s) - 2):
                return s
            return s + "e"
        return w

    def ity(self, w: str) -> str:
        if (s := self.cut(w, "ity")) is None:
            return w
        if found := self.pick(s, s + "e"):
            return found
        if s.endswith("il"):
            return s[:-2] + "le"
        if s.endswith("iv"):
            return s + "e"
        return s if s.endswith("al") or not self.known(w) else w

    def ness(self, w: str) -> str:
        if (s := self.cut(w, "ness")) is None:
            return w
        return s[:-1] + "y" if s.endswith("i") else s

    def ion(self, w: str) -> str:
        if (s := self.cut(w, "ization")) is not None:
            return s + "ize"
        if (s := self.cut(w, "ition")) is not None and (found := self.pick(s + "e")):
            return found
        if (s := self.cut(w, "ation")) is not None and (found := self.pick(s + "ate", s + "e", s)):
            return found
        if (s := self.cut(w, "ication")) is not None and (found := self.pick(s + "y")):
            return found
        if (s := self.cut(w, "ion")) is not None and (found := self.pick(s + "e", s)):
            return found
        return w

    def er_or(self, w: str) -> str:
        if self.cut(w, "izer") is not None:
            return w[:-1]
        s = self.cut(w, "er") or self.cut(w, "or")
        if s is None:
            return w
        letter = w[-2]
        if self.doubled(s):
            return self.pick(s[:-1], s, s + "e") or w
        if s.endswith("i") and (found := self.pick(s[:-1] + "y")):
            return found
        if s.endswith("e") and (found := self.pick(s[:-1])):
            return found
        return self.pick(s + letter, s, s + "e") or w

    def ly(self, w: str) -> str:
        if (s := self.cut(w, "ly")) is None:
            return w
        if found := self.pick(s + "le", s):
            return found
        if s.endswith("ab"):
            return s + "le"
        if s.endswith("i") and (found := self.pick(s[:-1] + "y")):
            return found
        return s

    def al(self, w: str) -> str:
        if len(w) < 4 or (s := self.cut(w, "al")) is None:
            return w
        if found := self.pick(s):
            return found
        if self.doubled(s) and (found := self.pick(s[:-1])):
            return found
        if found := self.pick(s + "e", s + "um"):
            return found
        if s.endswith("ic"):
            return self.pick(s[:-2], s[:-2] + "y") or s
        if s.endswith("i") and (found := self.pick(s[:-1])):
            return found
        return w

    def ive(self, w: str) -> str:
        if (s := self.cut(w, "ive")) is None:
            return w
        if found := self.pick(s, s + "e"):
            return found
        if s.endswith("at") and (found := self.pick(s[:-2] + "e", s[:-2])):
            return found
        return self.pick(s + "ion") or w

    def ize(self, w: str) -> str:
        if (s := self.cut(w, "ize")) is None:
            return w
        if found := self.pick(s):
            return found
        if self.doubled(s) and (found := self.pick(s[:-1])):
            return found
        return self.pick(s + "e") or w

    def ment(self, w: str) -> str:
        s = self.cut(w, "ment")
        return s if s is not None and self.known(s) else w

    def ble(self, w: str) -> str:
        s = self.cut(w, "ble")
        if s is None or s[-1] not in "ai" or len(s) < 2:
            return w
        base = s[:-1]
        undoubled = [base[:-1]] if self.doubled(base) else []
        return self.pick(base, *undoubled, base + "e", base + "ate") or w

    def ism(self, w: str) -> str:
        return self.cut(w, "ism") or w

    def ic(self, w: str) -> str:
        if (s := self.cut(w, "ic")) is None:
            return w
        return self.pick(w + "al", s + "y", s + "e", s) or w

    def ncy(self, w: str) -> str:
        s = self.cut(w, "ncy")
        if s is None or s[-1] not in "ae":
            return w
        return self.pick(s + "nt") or s + "nce"

    def nce(self, w: str) -> str:
        s = self.cut(w, "nce")
        if s is None or s[-1] not in "ae" or len(s) < 2:
            return w
        return self.pick(s[:-1] + "e", s[:-1]) or w

    STEPS = (plural, past, aspect, ity, ness, ion, er_or, ly, al, ive, ize, ment, ble, ism, ic, ncy, nce)


_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_STAY = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_STOP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"),
    ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(w: str, start: int) -> int:
    for k in range(start + 1, len(w)):
        if w[k] not in _V and w[k - 1] in _V:
            return k + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def porter2(word: str) -> str:
    """The English (Porter2) stem of a word."""
    w = word.lower()
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _STAY:
        return w
    chars = list(w)
    for k, c in enumerate(chars):
        if c == "y" and (k == 0 or chars[k - 1] in _V):
            chars[k] = "Y"
    w = "".join(chars)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _STOP:
        return w
    # 1b
    if (s := next((s for s in ("eedly", "eed") if w.endswith(s)), None)) is not None:
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif (s := next((s for s in ("ingly", "edly", "ing", "ed") if w.endswith(s)), None)) is not None and any(c in _V for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s, to in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ogi" or w[at - 1] == "l") and (s != "li" or w[at - 1] in "cdeghkmnrt"):
                w = w[:at] + to
            break
    # 3
    for s, to in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= (r2 if s == "ative" else r1):
                w = w[:at] + to
            break
    # 4
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or w.endswith("l") and len(w) - 1 >= r2 and w[-2] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def null_stem(word: str) -> str:
    return word


def stem_vocabulary(terms: DataFrame, stem: Callable[[str], str]) -> DataFrame:
    """(term, stem) of the distinct values of column ``term``."""

    @F.pandas_udf(StringType())
    def stemmed(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in words:
            yield s.map(stem)

    return terms.select("term").where("term IS NOT NULL").distinct().withColumn("stem", stemmed("term"))
