"""Column functions for names, dates and short texts. All are built-in expressions but Jaro-Winkler (Arrow)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters with diacritics and their plain letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalise(s: Column) -> Column:
    """Lower-case, without diacritics, leading article and punctuation, blanks squeezed. Null gives ''."""
    x = F.translate(F.lower(F.coalesce(s, F.lit(""))), ACCENTED, PLAIN)
    x = F.regexp_replace(F.regexp_replace(x, r"^(the|a|an)\s+", ""), r"[^A-Za-z0-9_\s]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalise_artist(s: Column) -> Column:
    """normalise, without 'and', a closing band/group/... and anything from 'feat' on."""
    x = F.regexp_replace(normalise(s), r"\s+and\s+", " ")
    x = F.regexp_replace(x, r"\s+(band|group|ensemble|orchestra|quartet|trio|duo)$", "")
    return F.trim(F.regexp_replace(x, r"\s*(featuring|feat|ft)\s+.+$", ""))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    a, b = a.lower(), b.lower()
    reach = max(len(a), len(b)) // 2 - 1
    if reach < 0:
        return 0.0
    taken, hits = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if j not in taken and b[j] == c), None)
        if j is not None:
            taken.add(j)
            hits.append(c)
    if not hits:
        return 0.0
    m, moved = len(hits), sum(x != b[j] for x, j in zip(hits, sorted(taken), strict=True))
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity with the prefix always counted (0.1 a character, up to four)."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def combined_similarity(a: Column, b: Column, jw: Column) -> Column:
    """0.6 Jaro-Winkler + 0.4 Levenshtein, + 0.1 if one contains the other, at most 1; of normalised texts."""
    bonus = F.when(F.contains(a, b) | F.contains(b, a), 0.1).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), jw * 0.6 + levenshtein_similarity(a, b) * 0.4 + bonus))


def acronym(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, r"\s+"), lambda w: F.substring(w, 1, 1)), "")


def match_status(score: Column) -> Column:
    return F.when(score >= 0.9, "match").when(score >= 0.7, "partial").otherwise("mismatch")


def title_confidence(a: Column, b: Column) -> Column:
    """Letters and digits alone: equal 1, one in the other 0.9, else Levenshtein similarity."""
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (a, b))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(levenshtein_similarity(x, y))


#: Phrases that rule out a name.
SKIP = ("tickets", "admission", "doors", "show", "starts", "ages", "all ages", "presented by", "with special guest", "featuring", "live at", "appearing at")


def candidate_names(text: Column) -> Column:
    """Parts between , & + • · | and line ends that may be names."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,&+•·\n|]"), lambda p: F.trim(p))

    def good(p: Column) -> Column:
        ok = F.length(p).between(2, 100) & (F.length(F.regexp_replace(p, "[^0-9]", "")) <= 4)
        return ok & ~F.lower(p).rlike("|".join(SKIP))

    return F.filter(parts, good)


def slug(s: Column, prefix: str = "", sep: str = "_") -> Column:
    x = F.regexp_replace(F.lower(s), "[^a-z0-9]+", sep)
    return F.concat(F.lit(prefix), F.regexp_replace(x, f"^{sep}+|{sep}+$", ""))


#: Phrases of commentary.
COMMENTARY = (
    "not specified", "not available", "not provided", "not found", "not visible", "not clear", "cannot be determined",
    "could not be determined", "unable to determine", "unclear", "unknown", "n/a", "none specified", r"no \w+ specified",
    r"no \w+ provided", r"no \w+ found", r"\[not applicable\]", "in the text provided", "in the image", "from the poster",
    "appears to be", "might be", "could be", "possibly", "likely", "seems to",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = "mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
_MONTH = "(?:" + "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS).replace("sep(?:tember)?", "sep(?:t|tember)?") + ")"


def is_commentary(s: Column) -> Column:
    return F.coalesce(F.trim(s) == "", F.lit(True)) | F.lower(s).rlike("|".join(COMMENTARY))


def looks_like_date(s: Column) -> Column:
    full = "|".join(MONTHS)
    return F.lower(s).rlike(rf"\b\d{{1,2}}\s+({full})\b|\b({full})\s+\d{{1,2}}\b")


def split_commentary(s: Column) -> tuple[Column, Column]:
    """(value, what stood in closing parentheses or null)."""
    note = F.regexp_extract(s, r"\(([^()]*)\)\s*$", 1)
    return F.trim(F.regexp_replace(s, r"\s*\([^()]*\)\s*$", "")), F.when(note != "", note)


def clean_text(s: Column, longest: int = 100) -> Column:
    """Squeezed text; null if commentary, shorter than 2 or longer than `longest`."""
    x = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(~is_commentary(s) & F.length(x).between(2, longest), x)


def let(x: Column, body) -> Column:
    """`body(x)` with x worked out once a row, where plain composition would repeat it in each place."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def month_number(name: Column) -> Column:
    return F.coalesce(*[F.when(F.substring(F.lower(name), 1, 3) == m[:3], F.lit(i)) for i, m in enumerate(MONTHS, 1)])


def _full_year(y: Column, pivot: int) -> Column:
    n = F.when(y != "", y).cast("int")
    return n + F.when(F.length(y) > 2, 0).when(n > pivot, 1900).otherwise(2000)


def normalise_date(raw: Column, pivot: int = 50) -> Column:
    """Messy date text as DD/MM/YYYY, or DD/MM without a year; null if it isn't one. Day before month."""
    x = F.trim(split_commentary(raw)[0])
    x = F.regexp_replace(x, r"(?i)^(?:until|from|on|starting|ending|begins?|ends?)\s+", "")
    x = F.regexp_replace(F.regexp_replace(x, rf"(?i)^(?:{DAYS})[,.\s]+", ""), rf"(?i)[,.\s]+(?:{DAYS})$", "")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)(\d+)(?:st|nd|rd|th)\b", "$1"), r"\s+", " "))
    return let(x, lambda x: _date_of(x, pivot))


def _date_of(x: Column, pivot: int) -> Column:
    def made(pattern: str, day: int, month: int, year: int, named: bool, open_year: bool) -> Column:
        """By one pattern; its groups are day, month, year. open_year: DD/MM where the year is missing or no such date is."""
        hit = x.rlike(pattern)
        d, m, y = (F.regexp_extract(x, pattern, g) for g in (day, month, year))
        d = F.when(hit, d).cast("int")
        mm = month_number(m) if named else F.when(hit, m).cast("int")
        yy = _full_year(y, pivot)
        whole = F.try_to_date(F.format_string("%04d-%02d-%02d", yy, mm, d))
        ok = whole.isNotNull() & yy.between(1900, 2100)
        partial = F.when(d.between(1, 31), F.format_string("%02d/%02d", d, mm)) if open_year else F.lit(None).cast("string")
        return F.when(hit, F.when(ok, F.date_format(whole, "dd/MM/yyyy")).otherwise(partial))

    market = x.rlike("(?i)only at|coming soon|now showing|in theaters")
    mp = rf"(?i)\b(\d{{1,2}})\s*({_MONTH})\b"
    marketed = F.when(x.rlike(mp), F.format_string("%02d/%02d", F.when(x.rlike(mp), F.regexp_extract(x, mp, 1)).cast("int"), month_number(F.regexp_extract(x, mp, 2))))
    forms = [
        made(r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})$", 1, 2, 3, False, False),
        made(r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$", 1, 2, 3, False, False),
        made(rf"(?i)^({_MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{2}})$", 2, 1, 3, True, False),
        made(rf"(?i)^(\d{{1,2}})\s+({_MONTH})\.?\s+(\d{{2}})$", 1, 2, 3, True, False),
        made(rf"(?i)^({_MONTH})\.?\s+(\d{{1,2}}),?\s*(\d{{4}})?$", 2, 1, 3, True, True),
        made(rf"(?i)^(\d{{1,2}})\s+({_MONTH})\.?,?\s*(\d{{4}})?$", 1, 2, 3, True, True),
        made(r"^(\d{4})-(\d{2})-(\d{2})$", 3, 2, 1, False, False),
    ]
    return F.when(market, marketed).otherwise(F.coalesce(*forms))


def extract_year(s: Column) -> Column:
    y = F.regexp_extract(s, r"\b(19[6-9]\d|20[0-2]\d)\b", 1)
    return F.when(y != "", y).cast("int")


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def weekday(s: Column) -> Column:
    d = F.substring(F.regexp_extract(F.lower(s), rf"\b({DAYS})\b", 1), 1, 3)
    return F.coalesce(*[F.when(d == n[:3].lower(), F.lit(n)) for n in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])


def iso_to_local(s: Column) -> Column:
    return F.regexp_replace(s, r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1")


def looks_concatenated(s: Column) -> Column:
    caps = F.size(F.regexp_extract_all(s, F.lit(r"\b[A-Z][a-z]+"), F.lit(0)))
    return (F.length(s) > 50) | (caps >= 4) | s.rlike(r"[,&+•|]") | F.lower(s).rlike(r"\s(and|with|feat\.?)\s")


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").otherwise("very-low")


def embedding_text(name: Column, kind: Column, observations: Column) -> Column:
    kept = F.filter(observations, lambda o: F.length(o) >= 5)
    return F.concat_ws("\n", F.concat(F.lit("Name: "), name), F.concat(F.lit("Type: "), kind), F.when(F.size(kept) > 0, F.concat(F.lit("Observations:\n"), F.array_join(kept, "\n"))))


def expand_dates(s: Column) -> Column:
    """Dates of 'A-B Month [Year]' (ranges of up to 7 days day by day, longer: both ends), or of 'A & B Month [Year]'."""
    span = rf"(?i)^\s*(?:(?:{DAYS})[,.\s]+)?(\d{{1,2}})\s*[-–]\s*(\d{{1,2}})\s+({_MONTH})\s*(\d{{4}})?\s*$"
    pair = rf"(?i)^\s*(?:(?:{DAYS})[,.\s]+)?(\d{{1,2}})\s*(?:&|and|,)\s*(?:(?:{DAYS})[,.\s]+)?(\d{{1,2}})\s+({_MONTH})\s*(\d{{4}})?\s*$"

    def tail(p: str) -> Column:
        return F.rtrim(F.concat(F.lit(" "), F.regexp_extract(s, p, 3), F.lit(" "), F.regexp_extract(s, p, 4)))

    n = lambda p, g: F.when(s.rlike(p), F.regexp_extract(s, p, g)).cast("int")
    a, b = n(span, 1), n(span, 2)
    days = F.when((b >= a) & (b - a <= 7), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))
    say = lambda days, p: F.transform(days, lambda x: F.concat(x.cast("string"), tail(p)))
    return F.when(s.rlike(span), say(days, span)).when(s.rlike(pair), say(F.array(n(pair, 1), n(pair, 2)), pair)).otherwise(F.array(F.trim(s)))
