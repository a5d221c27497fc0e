"""One consistent form for text that looks the same.

Method: quick-check properties. Every character is either stable (no normalization of this profile
can change it, and it joins with no neighbour) or not. One regular expression over the unstable
characters isolates the unstable segments of a text together with the character before each, which
a combining mark may join; only those segments are normalized, and spliced back between the stable
stretches, which are never touched. Spark tests the same property on the JVM first, so that stable
texts, nearly all of them, never reach Python.

The profile: full-width and half-width forms, letters and digits of other fonts, ligatures and parted accents are
composed (the parts of NFKC that concern them); every white space character becomes U+0020; invisible characters go, but for
the joiners and selectors an emoji needs; look-alike letters of another script within a word become
letters of the word's own script. Quotes, dashes, dots and words wholly in another script stay.
"""

from __future__ import annotations

import re
import unicodedata as ucd
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that look alike, Latin with Cyrillic and Latin with Greek.
LATIN_CYRILLIC = "aа cс eе iі jј oо pр sѕ xх yу hһ AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ"
#: Letters that look like a Latin one which has another look-alike already, or that no word of Latin letters has.
LATIN_FURTHER = "dԁ qԛ wԝ lӏ IӀ vѵ gɡ"
LATIN_GREEK = "oο vν uυ iι pρ aα xχ AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ"

LATIN, GREEK, CYRILLIC = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\u0370-\u03ff\u1f00-\u1fff", "\u0400-\u052f"


_SCRIPTS = [re.compile(f"[{c}]") for c in (LATIN, GREEK, CYRILLIC)]


@cache
def _look() -> dict[str, dict[str, str]]:
    """By script, what to make of each look-alike of the others."""
    out: dict[str, dict[str, str]] = {"L": {}, "C": {}, "G": {}}
    lc = {p[0]: p[1] for p in LATIN_CYRILLIC.split()}
    lg = {p[0]: p[1] for p in LATIN_GREEK.split()}
    for own, other, pairs in (("L", "C", lc), ("L", "G", lg)):
        out[other] |= pairs
        out[own] |= {v: k for k, v in pairs.items()}
    out["L"] |= {p[1]: p[0] for p in LATIN_FURTHER.split() if _script(p[1]) == "C"}
    both = {k: (lc[k], lg[k]) for k in lc if k in lg}
    out["C"] |= {g: c for c, g in both.values()}
    out["G"] |= {c: g for c, g in both.values()}
    return out


def _script(c: str) -> str:
    n = ord(c)
    if n < 0x250:
        return "L" if c.isalpha() else ""
    if 0x370 <= n <= 0x3FF or 0x1F00 <= n <= 0x1FFF:
        return "G" if c.isalpha() else ""
    return "C" if 0x400 <= n <= 0x52F and c.isalpha() else ""


@cache
def _properties() -> tuple[dict[str, str], frozenset[str], frozenset[str]]:
    """What single characters become; the marks that may join the character before; the emoji joiners."""
    single: dict[str, str] = {}
    marks: set[str] = set()
    for n in range(0x80, 0x2FA20):
        c = chr(n)
        kind = ucd.category(c)
        if kind in ("Cs", "Cn", "Co"):
            continue
        if kind in ("Zs", "Zl", "Zp") or n == 0x85:
            single[c] = " "
        elif kind == "Cf" or kind == "Cc" or 0xFE00 <= n <= 0xFE0F or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0":
            single[c] = ""
        elif (d := ucd.decomposition(c)).startswith(("<wide>", "<narrow>")) or d.startswith("<font>") and kind[0] in "LN":
            single[c] = ucd.normalize("NFKC", c)
            marks |= {m for m in single[c] if ucd.combining(m)}
        elif kind[0] == "L" and (d := ucd.decomposition(c)):
            if d[0] != "<":
                parts = d.split()
                if len(parts) == 2 and ucd.combining(m := chr(int(parts[1], 16))):
                    marks.add(m)
                if (to := ucd.normalize("NFC", c)) != c:
                    single[c] = to
            elif "LIGATURE" in ucd.name(c, ""):
                single[c] = ucd.normalize("NFKC", c)
    single |= {p[1]: p[0] for p in LATIN_FURTHER.split() if _script(p[1]) != "C"}
    single |= dict.fromkeys("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", " ") | {chr(n): "" for n in [*range(9), *range(0x0E, 0x1C), 0x7F]} | {chr(n): "" for n in range(0xE0000, 0xE01F0)}
    return single, frozenset(marks), frozenset("\u200d\ufe0e\ufe0f")


def _ranges(chars: set[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for n in sorted(map(ord, chars)):
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


@cache
def _unstable() -> tuple[str, str, re.Pattern, re.Pattern]:
    """The class of unstable characters for Java, that of joining marks, and the segment patterns for Python."""
    single, marks, _ = _properties()
    java = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges(set(single) | marks))
    java_marks = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges(set(marks)))
    esc = lambda s: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(s))
    u, m = esc(set(single) | marks), esc(set(marks))
    # the character before, the unstable ones, and marks after them; the character after tells a joiner what it joins
    return java, java_marks, re.compile(f"[^{u}]?[{u}]+(?:[^{u}\\s][{m}]+)*"), re.compile(rf"(?=\S*[{LATIN}])(?=\S*[{GREEK}{CYRILLIC}])\S+|(?=\S*[{GREEK}])(?=\S*[{CYRILLIC}])\S+")


def _pictograph(c: str) -> bool:
    return ucd.category(c) in ("So", "Sk") or 0x1F000 <= ord(c) <= 0x1FAFF or c in "\u200d\ufe0f\u2640\u2642\u2194-\u21aa"


def _segment(text: str, a: int, b: int) -> str:
    """The normal form of text[a:b]; the text around it is looked at, not changed."""
    single, _, joiners = _properties()
    out = []
    for i in range(a, b):
        c = text[i]
        if c in joiners:
            before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
            if c == "\u200d" and before and after and _pictograph(before) and _pictograph(after):
                out.append(c)
            elif c != "\u200d" and before and (_pictograph(before) or before in "0123456789#*\u00a9\u00ae\u203c\u2049\u2122\u2139\u3030\u303d"):
                out.append(c)
        else:
            out.append(single.get(c, c))
    return ucd.normalize("NFC", "".join(out))


def _one_script(m: re.Match) -> str:
    """A word of several scripts in the one that holds it best: all letters of the others must look like its own."""
    word = m[0]
    kinds = [_script(c) for c in word]
    n = {k: kinds.count(k) for k in "LCG"}
    best = None
    for own in "LCG":
        if n[own]:
            table = _look()[own]
            if all(k in ("", own) or c in table for c, k in zip(word, kinds, strict=True)):
                # letters that only this script has speak for it before mere numbers do
                sure = sum(k == own and not any(c in _look()[o] for o in "LCG" if o != own and n[o]) for c, k in zip(word, kinds, strict=True))
                best = max(best or (-1, -1, ""), (sure, n[own], own))
    if not best:
        return word
    table = _look()[best[2]]
    return "".join(c if k in ("", best[2]) else table[c] for c, k in zip(word, kinds, strict=True))


def canonical(text: str | None) -> str | None:
    """The one form of ``text``; null stays null. A mark that opens the text has nothing to join and stays."""
    if text is None or text.isascii() and text.isprintable():
        return text
    *_, segments, mixed = _unstable()
    out, at = [], 0
    for m in segments.finditer(text):
        out += (text[at : m.start()], _segment(text, m.start(), m.end()))
        at = m.end()
    if at:
        text = "".join(out) + text[at:]
    # few texts have letters of two scripts at all
    scripts = sum(p.search(text) is not None for p in _SCRIPTS)
    return mixed.sub(_one_script, text) if scripts > 1 else text


def suspect(text: Column) -> Column:
    """Quick check on the JVM: true where the canonical form may differ from the text."""
    java = _unstable()[0]
    has = lambda *cls: text.rlike("[" + "".join(cls) + "]")
    # plain ASCII, most words, is told by one range
    return has("^ -~") & (has(java) | (has(LATIN) & has(GREEK, CYRILLIC)) | (has(GREEK) & has(CYRILLIC)))


def opens_with_mark(text: Column) -> Column:
    """True where a combining accent opens the text."""
    return text.rlike("^[" + _unstable()[1] + "]")


@F.pandas_udf(StringType())
def _canonical(text: pd.Series) -> pd.Series:
    return text.map(canonical, na_action="ignore")


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical", changed: str = "changed") -> DataFrame:
    """``df`` with the canonical form of column ``text`` and whether the text isn't in it.

    Texts that pass the quick check are their own form. A text that opens with a mark counts as
    changed though the mark needs the text before it: :func:`canonical_words` has that. Null texts
    give null and false; empty ones themselves; columns named as the results are replaced.
    """
    col = F.col(text)
    df = df.withColumn(out, F.coalesce(_canonical(F.when(suspect(col), col)), col))
    return df.withColumn(changed, F.coalesce((F.col(out) != col) | opens_with_mark(col), F.lit(False)))


#: Positions in a block of words.
BLOCK = 4_096


def canonical_words(words: DataFrame) -> DataFrame:
    """Words ``source_id, pos, text, joins_left`` in canonical form, accents at the head of a token that
    joins its left neighbour moved to the end of that neighbour. Repeated rows come out once.

    Words are shuffled once, by source and block of positions; in that partitioning repeated rows go and neighbours
    meet. The words at either end of a block also go, as ghosts, to the block that they adjoin.
    """
    mark = F.when(F.col("pos").isNotNull() & F.col("joins_left") & opens_with_mark(F.col("text")), F.regexp_extract("text", "^([" + _unstable()[1] + "]+)", 1))
    near = F.array_compact(F.array(F.lit(0), F.when(F.pmod("pos", F.lit(BLOCK)) == 0, F.lit(-1)), F.when(F.pmod("pos", F.lit(BLOCK)) == BLOCK - 1, F.lit(1))))
    rows = words.select("source_id", "pos", "text", "joins_left", F.explode(near).alias("ghost"))
    rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK) + F.col("ghost")).repartition("source_id", "block").distinct()
    rows = rows.withColumn("mark", mark).withColumn("p", F.coalesce(F.col("pos").cast("bigint"), F.lit(-1)))
    here = Window.partitionBy("source_id", "block").orderBy("p")
    beside = lambda n: here.rangeBetween(n, n)
    lent, given = F.max("mark").over(beside(1)), F.max("mark").over(beside(0))
    taken = F.max(F.col("text").isNotNull()).over(beside(-1))
    known = F.col("source_id").isNotNull() & F.col("pos").isNotNull()
    both = rows.select("*", F.when(known, lent).alias("lent"), F.when(known & taken & F.col("mark").isNotNull(), given).alias("given")).where("ghost = 0")
    own = F.when(F.col("given").isNotNull(), F.expr("substr(text, length(given) + 1)")).otherwise(F.col("text"))
    both = both.select("source_id", "pos", "joins_left", F.concat(own, F.coalesce("lent", F.lit(""))).alias("text"))
    return with_canonical(both).select("source_id", "pos", "joins_left", F.col("canonical").alias("text"))
