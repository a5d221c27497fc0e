"""Text and time functions as columns: all on the JVM, null for null.

Python's white space is wider than ``\\s`` of Java, so the class is spelled out; strings are code points on
both sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Unicode; marks that end sentences and clauses; what may close after them; abbreviations; words
# that leave a sentence open, words that open one, hesitations, and words of sound cues.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CLOSERS = r"""\x{22}\x{201c}\x{201d}\x{2018}\x{2019}'\)\]\x{300d}\x{300f}\x{300b}\x{3009}\x{3011}"""
SENTENCE_MARKS = r".!?\x{3002}\x{ff01}\x{ff1f}\x{61f}\x{6d4}\x{964}\x{965}\x{1362}\x{104b}\x{17d4}\x{17d5}\x{f0d}\x{589}"
CLAUSE_MARKS = r",;:\x{2014}\x{2013}\x{3001}\x{ff0c}\x{ff1a}\x{ff1b}\x{60c}\x{61b}\x{55d}"
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "st.", "vs.", "etc.", "e.g.", "i.e.", "jr.", "sr.", "prof.", "no.", "inc.", "co.", "fig.", "al.")
DANGLING = tuple("a an the and or but so because if that which who whose whom of to in on at by for with from into onto as is are was were be been being am do does did have has had will would can could shall should may might must very really just quite their his her its our your my this these those i you we they he she it there when while than then though although unless until example um uh like".split())
STRONG_MARKERS = tuple("so now okay ok but anyway anyways alright next however finally meanwhile first firstly second secondly third lastly basically".split())
WEAK_MARKERS = ("and", "then", "well", "also")
FILLERS = ("um", "uh", "uhm", "umm", "er", "ah", "mm", "hmm")
STRIPPED = r"""\x{22}\x{201c}\x{201d}\x{2018}\x{2019}'()\[\]"""
NOISE_WORDS = tuple("music applause laughter laughs laughing cheering cheers clapping applauding inaudible crosstalk sighs coughing chuckles chuckling gasps groans murmuring beep bleep static".split())


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def words(c: Column) -> Column:
    """Array of the words; empty for a blank text."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{SPACE}]+")), F.lit(0))


def ends_ellipsis(c: Column) -> Column:
    return c.rlike(rf"(?:\.\.\.|\x{{2026}})[{CLOSERS}]*$")


def ends_sentence_mark(c: Column) -> Column:
    return c.rlike(f"[{SENTENCE_MARKS}][{CLOSERS}]*$")


def ends_clause_mark(c: Column) -> Column:
    return c.rlike(f"[{CLAUSE_MARKS}][{CLOSERS}]*$")


def bare(c: Column) -> Column:
    """A word in lower case without quotes and brackets at its ends."""
    return F.lower(F.regexp_replace(c, f"^[{STRIPPED}]+|[{STRIPPED}]+$", ""))


def last_word(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(F.regexp_replace(c, f"[{SPACE}]+$", ""), f"[{SPACE}]+"), F.lit(-1)), F.lit(""))


def first_word(c: Column) -> Column:
    """The first word that is no hesitation, as :func:`bare` has it; empty without any."""
    filler = f"[{SPACE}]*[{STRIPPED}]*(?:{'|'.join(FILLERS)})[{STRIPPED}]*(?![^{SPACE}])"
    return bare(F.regexp_extract(c, f"(?i)^(?:{filler})*+[{SPACE}]*([^{SPACE}]+)", 1))


def ends_abbreviation(c: Column, *, decimals: bool = False) -> Column:
    """The last token is an abbreviation or dotted initials; with ``decimals`` also an initial or a number with a point."""
    return is_abbreviation(bare(last_word(c)), decimals=decimals)


def is_abbreviation(last: Column, *, decimals: bool = False) -> Column:
    """:func:`ends_abbreviation` of a text's last word, bare."""
    out = last.isin(*ABBREVIATIONS) | last.rlike(r"^([a-z]\.)+$")
    return out | last.rlike(r"[0-9]\.[0-9]") if decimals else out


def format_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole seconds; 00:00:00 for negative, NaN or infinite ones; hours may pass 99."""
    good = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < 1e15)
    s = F.floor(F.when(good, seconds).otherwise(F.lit(0.0))).cast("bigint")
    pad = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    out = F.concat(pad(F.floor(s / 3600)), F.lit(":"), pad(F.floor(s / 60) % 60), F.lit(":"), pad(s % 60))
    return F.when(seconds.isNotNull(), out)


def duration_seconds(c: Column) -> Column:
    """Seconds of ``S``, ``MM:SS`` or ``H:MM:SS``; zero for null, malformed and negative ones."""
    parts = F.split(strip(c), ":")
    total = F.aggregate(F.transform(parts, lambda p: strip(p).try_cast("double")), F.lit(0.0), lambda a, p: a * 60 + p)
    return F.greatest(F.coalesce(F.nanvl(total, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def utc_stamp(c: Column) -> Column:
    """A timestamp as ``2026-01-31T09:05:00Z``."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def slug(c: Column, fallback: str = "episode") -> Column:
    """Lower-case stem of letters, digits and marks joined by hyphens, 80 characters at most."""
    kept = F.lower(strip(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}\p{{M}}{SPACE}_-]", "")))
    out = F.regexp_replace(F.regexp_replace(kept, f"[{SPACE}_-]+", "-"), "^-+|-+$", "")
    return F.left(F.when(out == "", F.lit(fallback)).otherwise(out), F.lit(80))


def safe_id(c: Column, key: Column | None = None) -> Column:
    """ASCII stem of 60 characters at most; with eight digits of a SHA-1 if letters were lost or a key is given."""
    stem = F.left(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""), F.lit(60))
    stem = F.when(stem == "", F.lit("clip")).otherwise(stem)
    marked = F.concat(stem, F.lit("-"), F.left(F.sha1((c if key is None else F.coalesce(key, c)).cast("binary")), F.lit(8)))
    lossy = c.rlike(r"[\p{L}\p{N}&&[^\x00-\x7f]]")
    return F.when(lossy if key is None else lossy | key.isNotNull(), marked).otherwise(stem)


def pipe_safe(c: Column) -> Column:
    """For a cell of a pipe-delimited line."""
    return collapse(F.replace(c, F.lit("|"), F.lit(" ")))


def preview(c: Column) -> Column:
    """80 characters at most, the last three points if cut."""
    return F.when(F.length(c) <= 80, c).otherwise(F.concat(F.left(c, F.lit(77)), F.lit("...")))


def is_noise_cue(c: Column) -> Column:
    """The whole text is one bracketed cue that is empty, notes only, or holds a word of the noise list."""
    inner = F.regexp_extract(c, rf"^[\[(][{SPACE}]*([^\])]{{0,40}})[{SPACE}]*[\])]$", 1)
    inner = strip(F.regexp_replace(strip(inner), r"^[\x{266a}\x{266b}\x{1f3b5}\x{1f3b6}]+|[\x{266a}\x{266b}\x{1f3b5}\x{1f3b6}]+$", ""))
    noisy = F.exists(words(inner), lambda w: F.lower(F.regexp_replace(w, "^[.,!?]+|[.,!?]+$", "")).isin(*NOISE_WORDS))
    return c.rlike(rf"^[\[(][{SPACE}]*[^\])]{{0,40}}[{SPACE}]*[\])]$") & ((inner == "") | noisy)
