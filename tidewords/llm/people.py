"""Names of speakers, however written, in one form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewords.llm.charforms import canonical

# Labels that name nobody.
NOBODY = frozenset("host guest unknown none null speaker n/a unk narrator anonymous interviewer moderator".split()) | {""}
_NUMBERED = re.compile(r"(?:speaker|spk|sprecher|s)[ ]?#?0*(\d+)")


def person(label: str | None) -> str | None:
    """The one form of a label: ``#n`` of a numbered speaker, ``first last`` of a named one in lower case;
    null where it names nobody."""
    if label is None:
        return None
    s = " ".join(canonical(label).replace("_", " ").split()).strip(" :-").casefold()
    if "," in s:
        last, first = (p.strip() for p in s.split(",", 1))
        s = f"{first} {last}".strip()
    if s in NOBODY:
        return None
    m = _NUMBERED.fullmatch(s)
    return f"#{m[1]}" if m else s


@F.pandas_udf(StringType())
def _person(label: pd.Series) -> pd.Series:
    known: dict[str | None, str | None] = {}
    return label.map(lambda x: known[x] if x in known else known.setdefault(x, person(x)), na_action="ignore")


def person_of(label: Column) -> Column:
    """:func:`person` of a column."""
    return _person(label)
