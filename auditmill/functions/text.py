"""Script-aware text measures as column expressions; Arrow functions only where Spark has no built-in (NFKC)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from auditmill.shared import parts

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
HANGUL = r"\p{IsHangul}"
NOSPACE = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = r"[\p{L}\p{Nd}]+"
SPACE = r"[\s\p{Z}\x{85}]+"

# Per script latin, cjk, hangul, no-space.
SCRIPTS = ("latin", "cjk", "hangul", "no-space")
THIN = (300, 600, 250, 800)
SPEED = (220, 500, 200, 700)
LONG_PARAGRAPH = (150, 300, 130, 400)
DESCRIPTION_MIN, DESCRIPTION_MAX = (70, 100, 100, 80), (160, 240, 240, 180)
TITLE_MIN, TITLE_MAX = 30, 60


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _count_class(text: Column, others: str) -> Column:
    """Characters that aren't in the class `others`. What is left after removing runs of it is counted, so nothing is made per character."""
    return F.length(F.regexp_replace(text, f"{others}+", ""))


def by_script(script: Column, values: tuple) -> Column:
    """The value for a script, the first one's for unknown scripts."""
    out = F.when(script == SCRIPTS[1], values[1])
    for s, v in zip(SCRIPTS[2:], values[2:]):
        out = out.when(script == s, v)
    return out.otherwise(values[0])


def script_counts(text: Column) -> tuple[Column, Column, Column, Column]:
    """Letters of each script; all letters that belong to no other count as latin."""
    cjk, hangul, nospace = (_count_class(text, rf"[\P{{L}}[^{c}]]") for c in (CJK, HANGUL, NOSPACE))
    return _count_class(text, r"\P{L}") - cjk - hangul - nospace, cjk, hangul, nospace


def _counted(text: Column):
    """Takes an expression of the four counts, each of which is then taken once, however often it is named."""
    latin, cjk, hangul, nospace = script_counts(text)
    one = F.array(F.struct(latin.alias("latin"), cjk.alias("cjk"), hangul.alias("hangul"), nospace.alias("nospace")))
    return lambda f: F.get(F.transform(one, f), F.lit(0))


def _most(c: Column) -> Column:
    return (
        F.when((c.nospace > c.latin) & (c.nospace > c.cjk) & (c.nospace > c.hangul), "no-space")
        .when((c.hangul > c.latin) & (c.hangul > c.cjk), "hangul").when(c.cjk > c.latin, "cjk").otherwise("latin")
    )


def _all_latin(text: Column) -> Column:
    """Whether no character is of another script: one look at most texts, which then need no counts."""
    return (F.octet_length(text) == F.length(text)) | ~text.rlike(f"[{CJK}{HANGUL}{NOSPACE}]")


def classify(text: Column) -> Column:
    """The script with most letters; of equal ones the first; latin without letters."""
    return F.when(_all_latin(text), "latin").otherwise(_counted(text)(_most))


def script_of_lang(lang: Column) -> Column:
    """The script a language tag stands for; null if it says nothing."""
    tag = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^[^-_]*", 0))
    return F.when(tag.isin("ja", "zh"), "cjk").when(tag == "ko", "hangul").when(tag.isin("th", "lo", "km", "my"), "no-space")


def classify_with_hint(text: Column, lang: Column) -> Column:
    """The language's script if the text is empty or has a letter of it, else the text's own."""
    hint = script_of_lang(lang)

    def settle(c: Column) -> Column:
        has = F.when(hint == "cjk", c.cjk > 0).when(hint == "hangul", c.hangul > 0).when(hint == "no-space", c.nospace > 0)
        return F.when(hint.isNotNull() & ((text == "") | has), hint).otherwise(_most(c))

    return F.when(_all_latin(text), F.when(hint.isNotNull() & (text == ""), hint).otherwise("latin")).otherwise(_counted(text)(settle))


def count_words(text: Column) -> Column:
    return _count(text, WORD).cast("long")


def count_chars(text: Column) -> Column:
    return _count_class(text, r"[^\p{L}\p{Nd}]").cast("long")


def length(text: Column, script: Column) -> Column:
    """Words; in scripts without spaces each such letter is one, and each run of other letters and digits."""
    mixed = _count(text, rf"[\p{{L}}&&[{CJK}{NOSPACE}]]|[[\p{{L}}\p{{Nd}}]&&[^{CJK}{NOSPACE}]]+")
    return F.when(script.isin("cjk", "no-space"), mixed).otherwise(_count(text, WORD)).cast("long")


def first_words(text: Column, n: int) -> Column:
    """The first n words joined by one space; the text as it is if it has no more."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(F.size(found) <= n, text).otherwise(F.array_join(F.slice(found, 1, n), " "))


def first_units(text: Column, script: Column, n: int) -> Column:
    """As first_words; in scripts without spaces the text's beginning with n units."""
    # possessive, so that a text with fewer units fails at once
    unit = rf"(?:[\p{{L}}&&[{CJK}{NOSPACE}]]|[[\p{{L}}\p{{Nd}}]&&[^{CJK}{NOSPACE}]]++)"
    cut = F.regexp_extract(text, rf"^(?:[^\p{{L}}\p{{Nd}}]*+{unit}){{{n}}}+", 0)
    return F.when(script.isin("cjk", "no-space"), F.when(cut == "", text).otherwise(cut)).otherwise(first_words(text, n))


@cache
def _wide() -> str:
    """A character class of wide and full-width code points that aren't combining marks, from the Unicode database.

    A class is tried range by range: its whole span stands before the ranges, as most characters lie outside, and
    the largest ranges come first.
    """
    spans, lo = [], None
    for c in range(0x1100, 0x3FFFF):
        wide = unicodedata.east_asian_width(chr(c)) in "WF" and unicodedata.category(chr(c)) != "Mn"
        if wide and lo is None:
            lo = c
        elif not wide and lo is not None:
            spans.append((lo, c - 1))
            lo = None
    ranges = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in sorted(spans, key=lambda s: s[0] - s[1]))
    return rf"[\x{{{spans[0][0]:x}}}-\x{{{spans[-1][1]:x}}}&&[{ranges}]]"


def display_width(text: Column) -> Column:
    """Columns of a fixed-width display: wide characters two, combining marks none."""
    return (F.length(text) + _count(text, _wide()) - _count_class(text, r"\P{Mn}")).cast("long")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.lit(n <= 0), "").otherwise(F.substring(text, 1, max(n, 0)))


def shorten(text: Column, n: int) -> Column:
    """The first n characters and three dots if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def fit(text: Column, n: int) -> Column:
    """At most n characters, the last three of them dots if something is left out."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, max(0, n - 3)), F.lit("..."))).otherwise(text)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def text_hash(text: Column) -> Column:
    """SHA-256 of visible text; empty below 200 characters, where equal texts mean little."""
    return F.when(F.length(text) >= 200, F.sha2(text, 256)).otherwise("")


def reading_minutes(units: Column, script: Column) -> Column:
    speed = by_script(script, SPEED)
    return (F.floor(units / speed) + (units % speed > F.floor(speed / 2)).cast("int")).cast("long")


def w3c_time(value: Column) -> Column:
    """An HTTP date as a W3C time in UTC; empty if it is none."""
    at = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def plural(n: Column, word: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, word).otherwise(word + "s"))


# ---------------------------------------------------------------- beyond built-ins
def _folded(s: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", s or "").casefold().split())


@cache
def _patterns() -> dict:
    import regex

    sets = {"cjk": r"[\p{Han}\p{Hiragana}\p{Katakana}&&\p{L}]", "hangul": r"[\p{Hangul}&&\p{L}]", "no-space": r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}&&\p{L}]"}
    return {k: regex.compile(v, regex.V1) for k, v in sets.items()} | {"all": regex.compile(r"\p{L}")}


def script_name(text: str, lang: str = "") -> str:
    """classify_with_hint for one text."""
    tag = lang.replace("_", "-").split("-")[0].lower()
    hint = {"ja": "cjk", "zh": "cjk", "ko": "hangul", "th": "no-space", "lo": "no-space", "km": "no-space", "my": "no-space"}.get(tag)
    if text.isascii():
        return hint if hint and not text else "latin"
    p = _patterns()
    n = {k: len(p[k].findall(text)) for k in ("cjk", "hangul", "no-space")}
    if hint and (not text or n[hint]):
        return hint
    n = {"latin": len(p["all"].findall(text)) - sum(n.values())} | n
    return max(n, key=n.get)


@F.arrow_udf(StringType())
def fold(text: pa.Array) -> pa.Array:
    """Compatibility form, case-folded, white space collapsed: what keywords are matched in."""
    return pa.array([_folded(s) for s in text.to_pylist()], pa.string())


def _script(c: str) -> str | None:
    """The script name of a letter where words aren't parted by spaces."""
    name = unicodedata.name(c, "")
    if c.isalpha():
        if name.startswith(("CJK ", "HIRAGANA", "KATAKANA")) and c not in "ー":
            return "cjk"
        if name.startswith(("THAI", "LAO", "KHMER", "MYANMAR")):
            return "no-space"
    return None


def keyword_hits(text: str | None, keyword: str | None) -> int:
    """Occurrences of a keyword: within running text in scripts without spaces, else as a whole phrase."""
    t, k = _folded(text), _folded(keyword)
    if not k:
        return 0
    if any(_script(c) for c in k):
        return t.count(k)

    def joins(c: str) -> bool:
        return c.isdecimal() or (c.isalpha() and not _script(c))

    n, at = 0, t.find(k)
    while at >= 0:
        end = at + len(k)
        n += not (at and joins(t[at - 1])) and not (end < len(t) and joins(t[end]))
        at = t.find(k, at + 1)
    return n


@F.arrow_udf(LongType())
def count_keyword(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        for text, keyword in parts(*batch):
            yield pa.array([keyword_hits(t, k) for t, k in zip(text.to_pylist(), keyword.to_pylist())], pa.int64())


def count_ascii_keyword(text: Column, keyword: str) -> Column:
    """count_keyword for a keyword and texts of which only ASCII case matters: stays in the JVM."""
    import re

    return _count(F.lower(text), rf"(?<![\p{{L}}\p{{Nd}}]){re.escape(keyword.lower())}(?![\p{{L}}\p{{Nd}}])").cast("long")
