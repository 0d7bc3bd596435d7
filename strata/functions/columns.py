"""Column functions that the operators share."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _accents() -> tuple[str, str]:
    """Every letter of the first planes' scripts that is a letter with marks, and that letter."""
    marked = {}
    for c in map(chr, range(0xC0, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            marked[c] = base
    return "".join(marked), "".join(marked.values())


ACCENTED, PLAIN = _accents()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def fold(c: Column | str) -> Column:
    """Without accents (letters with marks, and marks of their own), in upper case, each run of white space one space."""
    plain = F.regexp_replace(F.translate(_col(c), ACCENTED, PLAIN), r"\p{Mn}+", "")
    return F.upper(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def column_name(name: str) -> str:
    """A sensor's name as a column: ``P-PDG`` is ``p_pdg``, which needs no quotes in SQL."""
    return name.strip().lower().replace("-", "_")


def with_plain_names(df: DataFrame) -> DataFrame:
    """All columns by ``column_name``. Two that become one name are an error."""
    names = [column_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names become equal: {sorted(c for c in df.columns if names.count(column_name(c)) > 1)}")
    return df.toDF(*names)


def squeeze(c: Column | str) -> Column:
    """In upper case, trimmed, each run of white space one space."""
    return F.upper(F.trim(F.regexp_replace(_col(c), r"\s+", " ")))


def name_key(c: Column | str) -> Column:
    """Key of a name that case and spacing don't change."""
    return F.md5(squeeze(c))


def key_of(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))


def fingerprint(*parts: Column | str) -> Column:
    """All parts in one text, nulls as empty ones."""
    return F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])


def safe_key(c: Column | str, fallback: str = "resource") -> Column:
    """Part of an object key: without accents, other characters than letters, digits, dot, dash and underscore as dashes."""
    kept = F.regexp_replace(F.translate(_col(c), ACCENTED, PLAIN), "[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(kept, "^-+|-+$", "")), F.lit("")), F.lit(fallback))


def flag(c: Column | str) -> Column:
    """t and f (any case, trimmed) as booleans, all else null."""
    t = F.lower(F.trim(_col(c)))
    return F.when(t == "t", F.lit(True)).when(t == "f", F.lit(False))


def month_key(day: Column | str) -> Column:
    return F.year(_col(day)) * 100 + F.month(_col(day))


def month_start(day: Column | str) -> Column:
    return F.trunc(_col(day), "month")


def months_apart(later: Column | str, first: Column | str) -> Column:
    """Whole months between two first days of months."""
    return F.months_between(_col(later), _col(first)).cast("int")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Days from start to end; null if the end is before the start."""
    return F.when(_col(end) >= _col(start), F.datediff(_col(end), _col(start)))


def capped(c: Column | str, cap: float) -> Column:
    """At most ``cap``; null stays null and NaN becomes it (``least`` would make the cap of either)."""
    x = F.when(~F.isnan(_col(c)), _col(c))
    return F.when(x > cap, F.lit(float(cap))).otherwise(x)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0."""
    return _col(a) / F.nullif(_col(b), F.lit(0).cast("double"))


def sum_of(*parts: Column | str) -> Column:
    """The sum, nulls as 0."""
    out = F.coalesce(_col(parts[0]), F.lit(0))
    for p in parts[1:]:
        out = out + F.coalesce(_col(p), F.lit(0))
    return out


def to_target(c: Column | str) -> Column:
    return F.log1p(_col(c))


def from_target(c: Column | str, most: float = 1e7) -> Column:
    """The inverse, with the target kept between 0 and that of ``most``; null stays null."""
    top = F.log1p(F.lit(float(most)))
    return F.expm1(F.when(_col(c) < 0, F.lit(0.0)).when(_col(c) > top, top).otherwise(_col(c)))
