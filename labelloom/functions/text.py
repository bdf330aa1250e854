"""Text and URL functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest page text that is looked at, in characters.
TEXT_LIMIT = 10_000


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the text in lower case."""
    return F.filter(F.split(F.lower(as_column(text)), "[^a-z0-9]+"), lambda t: t != "")


def tokens(text: Column | str) -> Column:
    """Blank-separated words in lower case without anything but letters and digits, empty ones dropped."""
    words = F.split(F.lower(as_column(text)), r"\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"(?U)[\W_]", "")), lambda w: w != "")


def topic_tokens(text: Column | str) -> Column:
    """Words of at least three word characters; a word on 's' is stemmed, and must keep three characters."""
    found = F.regexp_extract_all(F.lower(as_column(text)), F.lit(r"(?U)(\w{3,})"))
    short = F.transform(found, lambda w: F.when(w.endswith("s"), plural_stem(w)).otherwise(w))
    return F.filter(short, lambda w: F.char_length(w) >= 3)


def plural_stem(word: Column) -> Column:
    """The plural step of the English stemmer: -sses, -ies, -us and -ss, -s after a vowel before the last letter."""
    return (
        F.when(word.endswith("sses"), F.regexp_replace(word, "sses$", "ss"))
        .when(word.endswith("ies"), F.when(F.char_length(word) > 4, F.regexp_replace(word, "ies$", "i")).otherwise(F.regexp_replace(word, "ies$", "ie")))
        .when(word.rlike("(us|ss)$"), word)
        .when(word.rlike("[aeiouy].+s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def vocabulary_line(words: Column, vocabulary: Column) -> Column:
    """The words that a vocabulary (an array) holds, blank-joined, in order."""
    return F.array_join(F.filter(words, lambda w: F.array_contains(vocabulary, w)), " ")


def without_control(text: Column | str) -> Column:
    """Without characters of the categories C (control, format, unassigned, private)."""
    return F.regexp_replace(as_column(text), r"\p{C}", "")


def without_separators(text: Column | str) -> Column:
    """Without line and paragraph separators, format and control characters."""
    return F.regexp_replace(as_column(text), r"[\p{Zp}\p{Zl}\p{Cf}\p{Cc}]", "")


def truncated(text: Column | str, limit: int = TEXT_LIMIT) -> Column:
    """Up to the first blank after `limit` characters; a longer text without one loses its last character."""
    c = as_column(text)
    at = F.locate(" ", c, limit + 1)
    return F.when(F.char_length(c) <= limit, c).when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(F.substr(c, F.lit(1), F.char_length(c) - 1))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_column(url), "^https?://([^/?#]*)", 1))


def url_letters(url: Column | str) -> Column:
    """An URL without its query, `http` and all but letters."""
    return F.regexp_replace(F.lower(F.regexp_extract(as_column(url), "^[^?]*", 0)), "http|[^a-z]", "")


def url_ngrams(url: Column | str, least: int = 4, most: int = 5) -> Column:
    """The character n-grams of url_letters, repeats included; a shorter text has none."""
    text = url_letters(url)
    n = F.char_length(text)

    def of_length(k: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(k)))
        return F.when(n >= k, grams).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of_length(k) for k in range(least, most + 1)]))


def skip_url(url: Column | str, patterns: list[str]) -> Column:
    """Not http, or one of the patterns matches at the start."""
    c = as_column(url)
    return ~c.startswith("http") | c.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def _to_ascii(text: pd.Series) -> pd.Series:
    """Letters without their marks; what has no ASCII form is dropped."""
    special = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."})
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x.translate(special)).encode("ascii", "ignore").decode())


_VOWELS = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


#: Whole words with a stem of their own. Fixed values of the published English stemmer.
_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes of step 2 and 3 with what they become in the first region. Fixed values of the published English stemmer.
_STEP2 = {"ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful", "tional": "tion", "lessli": "less", "biliti": "ble", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def english_stem(word: str) -> str:
    """The stem of an English word by the published Snowball algorithm (Porter2)."""
    w = word.lower().replace("’", "'").lstrip("'")
    if len(w) < 3 or w in _UNCHANGED:
        return w
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), "")
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in _VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    w = _replaced(w, r1, _STEP2, ogi=True)
    w = _replaced(w, r1, _STEP3)
    if w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    end = next((e for e in _STEP4 if w.endswith(e)), "")
    if end:
        if len(w) - len(end) >= r2:
            w = w[: -len(end)]
    elif w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
        w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _replaced(w: str, r1: int, table: dict[str, str], ogi: bool = False) -> str:
    end = max((e for e in table if w.endswith(e)), key=len, default="")
    if end:
        return w[: -len(end)] + table[end] if len(w) - len(end) >= r1 else w
    if ogi and w.endswith("logi") and len(w) - 3 >= r1:
        return w[:-1]
    if ogi and w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
        return w[:-2]
    return w


def _stems(words: pd.Series) -> pd.Series:
    """The English stem of each word of an array."""
    known: dict[str, str] = {}

    def one(word: str) -> str:
        if word not in known:
            known[word] = english_stem(word)
        return known[word]

    return words.map(lambda ws: None if ws is None else [one(w) for w in ws])


def _entity_spans(words: pd.Series, entities: pd.Series) -> pd.Series:
    """Entities (blank-joined words) found in a word list, longest first from each place; a span within the
    last match is passed over, one that reaches beyond it is not."""

    def one(ws, es) -> list[str] | None:
        if ws is None or es is None:
            return None
        wanted, out, reached = set(es), [], 0
        longest = max((len(e.split(" ")) for e in wanted), default=0)
        for i in range(len(ws)):
            for n in range(min(longest, len(ws) - i), 0, -1):
                if i + n > reached and (found := " ".join(ws[i : i + n])) in wanted:
                    out.append(found)
                    reached = i + n
                    break
        return out

    return pd.Series([one(w, e) for w, e in zip(words, entities, strict=True)])


def to_ascii(text: Column | str) -> Column:
    return F.pandas_udf(_to_ascii, "string")(as_column(text))


def without_marks(text: Column | str) -> Column:
    """Latin letters without the marks that they are composed with; those that no mark makes (ß, æ, ø, ð, þ) stay."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    plain = {c: p[0] for c, p in parts.items() if len(p) > 1 and p[0].isascii() and all(map(unicodedata.combining, p[1:]))}
    return F.translate(as_column(text), "".join(plain), "".join(plain.values()))


def stems(words: Column | str) -> Column:
    return F.pandas_udf(_stems, "array<string>")(as_column(words))


def entity_spans(words: Column | str, entities: Column | str) -> Column:
    return F.pandas_udf(_entity_spans, "array<string>")(as_column(words), as_column(entities))
