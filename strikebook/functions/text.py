"""Match keys of attribute names, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a Portuguese attribute name.
FUNCTION_WORDS = (
    "a ao aos as com da das de do dos e em na nas no nos o os para por"
).split()


def _accents() -> tuple[str, str]:
    """Every precomposed Latin letter and its base, by canonical decomposition."""
    pairs = []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(point))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(point), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def normalise(name: Column) -> Column:
    """Lower-case letters and digits without accents, words parted by one space."""
    plain = F.lower(F.regexp_replace(F.translate(name, ACCENTED, PLAIN), r"\p{M}", ""))
    return F.coalesce(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{Nd}]+", " ")), F.lit(""))


def signature(key: Column) -> Column:
    """Meaning words in order of the alphabet, plural ``s`` folded; all words if none has meaning."""
    words = F.filter(F.split(key, " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(FUNCTION_WORDS))
    folded = F.transform(
        kept, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    )
    return F.array_join(F.array_sort(F.when(F.size(folded) > 0, folded).otherwise(words)), " ")


def number_of(key: Column) -> Column:
    """A trailing whole number that follows at least one word."""
    return F.regexp_extract(key, r"^.+ (\d+)$", 1).try_cast("int")


def stem_of(key: Column) -> Column:
    return F.when(number_of(key).isNotNull(), F.regexp_extract(key, r"^(.+) \d+$", 1)).otherwise(key)
