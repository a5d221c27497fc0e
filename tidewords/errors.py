"""What may be wrong with an input, a service or an output: each error says what happened and what to do next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewords.functions.text import strip


class TidewordsError(Exception):
    """Base of all expected failures: ``message`` and, where there is one, a ``hint``."""

    def __init__(self, message: str, hint: str = ""):
        super().__init__(message)
        self.message, self.hint = message, hint


class SourceError(TidewordsError, ValueError):
    """Not something that can be read: a wrong URL, a missing file or folder, a suffix of no medium."""


class UnavailableError(TidewordsError):
    """The medium is private, gone, restricted, or behind a check."""


class NoCaptionsError(TidewordsError):
    """There are no caption tracks."""


class CaptionsError(TidewordsError):
    """There are captions, but they could not be fetched."""


class MetadataError(TidewordsError):
    """Metadata could not be fetched or read."""


class FeedError(TidewordsError):
    """A feed could not be fetched or read."""


class ListingError(TidewordsError):
    """A playlist or channel could not be listed, or is empty."""


class DownloadError(TidewordsError):
    """A medium could not be fetched whole."""


class RecognitionError(TidewordsError):
    """Speech could not be recognized, or the language asked for is none."""


class SpeakersError(TidewordsError):
    """Speakers could not be told apart."""


class AudioError(TidewordsError):
    """Audio could not be probed, cut or written."""


class DatasetError(TidewordsError):
    """A dataset can't be built: no words, a format that isn't known, too many failures."""


class WriteError(TidewordsError):
    """An output could not be written."""


# Kinds of failures of a fetch by what its log says, in this order: kind, class of the error, texts of which one
# group must all be there.
FETCH = (
    ("private", UnavailableError, (("private video",),)),
    ("gone", UnavailableError, (("video unavailable",), ("this video has been removed",))),
    ("age", UnavailableError, (("age", "confirm"),)),
    ("check", UnavailableError, (("not a bot",), ("sign in to confirm",))),
    ("url", SourceError, (("is not a valid url",), ("unsupported url",))),
)


def fetch_failure(log: Column) -> Column:
    """Struct ``kind, error, tail`` of a fetch's log: the first kind of FETCH whose texts it has, in any case, else ``other``;
    the class of the error; the last line, ``no error output`` of a blank log. Null for null."""
    low = F.lower(log)
    kind, name = F.lit("other"), F.lit(MetadataError.__name__)
    for k, error, texts in reversed(FETCH):
        hit = F.lit(False)
        for needed in texts:
            one = F.lit(True)
            for t in needed:
                one = one & F.contains(low, F.lit(t))
            hit = hit | one
        kind, name = F.when(hit, k).otherwise(kind), F.when(hit, error.__name__).otherwise(name)
    last = F.element_at(F.split(strip(log), r"\r\n|[\n\r]"), -1)
    tail = F.when(strip(log) == "", "no error output").otherwise(last)
    return F.when(log.isNotNull(), F.struct(kind.alias("kind"), name.alias("error"), tail.alias("tail")))


def of_fetch(url: str, kind: str, tail: str) -> TidewordsError:
    """The error of a failure as :func:`fetch_failure` names it."""
    said = {"private": "is private", "gone": "is gone or was never there", "age": "may be seen by adults only", "check": "is served to signed-in sessions only", "url": "is no address that can be fetched"}
    hints = {"private": "Only its owner can reach it.", "gone": "See whether it plays in a browser.", "age": "Fetch it in a signed-in session.", "check": "Fetch it in a signed-in session.", "url": "Give the address of one medium, a playlist or a channel."}
    cls = next((c for k, c, _ in FETCH if k == kind), MetadataError)
    return cls(f"{url} {said[kind]}" if kind in said else f"{url} could not be fetched: {tail}", hints.get(kind, "Bring the fetching tool up to date if it plays in a browser."))
