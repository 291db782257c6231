"""Arrow functions for what built-ins can't express: stems, string likeness, exact rounding, scoring of answers."""

from __future__ import annotations

import difflib
import functools
import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, by bits of one integer."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs_length(a, b) / n


def token_set(a: str, b: str) -> float:
    """The best likeness among the shared words, and the shared words with what either has besides."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [common, " ".join(sorted(own))])) for own in (x - y, y - x))
    if common and (x <= y or y <= x):
        return 100.0
    return max(indel_ratio(common, left) if common else 0.0, indel_ratio(common, right) if common else 0.0, indel_ratio(left, right))


def token_sort(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))


def partial(a: str, b: str) -> float:
    """The best likeness of the shorter text to a stretch of the longer one: stretches of its own length, and shorter ones at both ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    best = max(indel_ratio(short, x) for x in _stretches(short, long))
    return max(best, *(indel_ratio(long, x) for x in _stretches(long, short))) if len(short) == len(long) else best


def _stretches(short: str, long: str) -> list[str]:
    """Those that begin or end with a character of the shorter text; no other can be best."""
    m, n, own = len(short), len(long), set(short)
    starts = [long[:i] for i in range(1, m) if long[i - 1] in own] + [long[i:] for i in range(n - m + 1, n) if long[i] in own]
    return starts + [long[i : i + m] for i in range(n - m + 1) if long[i + m - 1] in own or long[i] in own] or [long[:m]]


def partial_token(a: str, b: str) -> float:
    """100 where a word is shared; else the best stretch of the words in order."""
    x, y = a.lower().split(), b.lower().split()
    if not x or not y:
        return 0.0
    return 100.0 if set(x) & set(y) else max(partial(" ".join(sorted(x)), " ".join(sorted(y))), partial(" ".join(sorted(set(x))), " ".join(sorted(set(y)))))


#: Weights of likenesses that don't look at the order of words, and of those that look at a stretch of the longer text only, by
#: how many times longer it is: fixed values of the published definition.
UNORDERED, STRETCH, FAR_STRETCH = 0.95, 0.9, 0.6


def weighted(a: str, b: str) -> float:
    """The greatest of several likenesses, each with its weight; texts that differ in length by half or more are compared by stretches."""
    x, y = a.lower(), b.lower()
    if not x or not y:
        return 0.0
    longer = max(len(x), len(y)) / min(len(x), len(y))
    plain = indel_ratio(x, y)
    if longer < 1.5:
        return max(plain, UNORDERED * max(token_sort(a, b), token_set(a, b)))
    scale = STRETCH if longer <= 8 else FAR_STRETCH
    return max(plain, scale * partial(x, y), UNORDERED * scale * partial_token(a, b))


_VOWEL = "aeiou"


def stem(word: str) -> str:
    """Porter's stemmer of 1980."""
    w = word
    if len(w) < 3:
        return w

    def cons(i: int, s: str) -> bool:
        c = s[i]
        return False if c in _VOWEL else (i == 0 or not cons(i - 1, s)) if c == "y" else True

    def shape(s: str) -> str:
        return re.sub(r"(.)\1+", r"\1", "".join("c" if cons(i, s) else "v" for i in range(len(s))))

    m = lambda s: shape(s).count("vc")
    has_vowel = lambda s: "v" in shape(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and cons(len(s) - 1, s)
    cvc = lambda s: len(s) > 2 and cons(len(s) - 1, s) and not cons(len(s) - 2, s) and cons(len(s) - 3, s) and s[-1] not in "wxy"

    def swap(s: str, rules: tuple, least: int) -> str:
        for end, to in rules:
            if s.endswith(end):
                root = s[: len(s) - len(end)]
                return root + to if m(root) > least else s
        return s

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif m(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if w.endswith(end):
            root = w[: -len(end)]
            if m(root) > 1 and (end != "ion" or root[-1:] in ("s", "t")):
                w = root
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if m(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


PLACES = {"integer": 0, "whole": 0, "tenths": 1, "hundredths": 2, "thousandths": 3, "ten_thousandths": 4}


def formatted(value: float | None, rounding: str | None) -> str | None:
    """Rounded as binary floating point rounds, half to even; whole numbers without a point."""
    if value is None:
        return None
    out = round(value, PLACES[rounding]) if rounding in PLACES else value
    return str(int(out)) if float(out).is_integer() else repr(out)


def matches(truth: str | None, answer: str | None, tolerance: float) -> bool:
    """Every number of the truth is among the answer's within a relative tolerance; without numbers, the words agree."""
    number = r"-?\d[\d,]*\.?\d*"
    read = lambda s: [float(x.replace(",", "")) for x in re.findall(number, s)]
    t, a = truth or "", answer or ""
    want, got = read(t), read(a)
    if not want:
        clean = lambda s: " ".join(re.sub(r"[^\w\s]", " ", s.lower()).split())
        return bool(clean(t)) and clean(t) in clean(a)
    return all(any(abs(g - w) <= tolerance * abs(w) if w else g == 0 for g in got) for w in want)


@pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(T.DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@functools.lru_cache(1 << 16)
def known_stem(word: str) -> str:
    """The stem; a worker's frequent words are stemmed once."""
    return stem(word)


@pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    return pd.Series([[known_stem(w) for w in x] if x is not None else None for x in words])


@pandas_udf(T.StringType())
def format_result(value: pd.Series, rounding: pd.Series) -> pd.Series:
    return pd.Series([formatted(None if pd.isna(v) else float(v), r) for v, r in zip(value, rounding, strict=True)])


@pandas_udf(T.BooleanType())
def answer_matches(truth: pd.Series, answer: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([matches(t, a, k) for t, a, k in zip(truth, answer, tolerance, strict=True)])
