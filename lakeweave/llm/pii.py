"""Pseudonyms for personal data in texts, by format-preserving Feistel networks. DataFrame functions only.

Kinds: payment card numbers (13 to 19 digits, in one run or in groups of a blank or hyphen, Luhn-checked; any run of whole
groups within a longer chain of groups, cards' usual layouts first), phone numbers
(North American, with 10 digits), US social security numbers, IPv4 addresses, calendar dates (YYYY-MM-DD and DD/MM/YYYY,
1900-01-01 to 2100-01-01), e-mail addresses, and secrets (access keys of the form AKIA + 16, and values of password=,
token =, secret=, api_key= assignments of 8 characters or more).

A number or date is checked first; what fails the check stays. It is then permuted by a keyed Feistel network within the
valid values of its own format (same length and separators, check digit recomputed, real calendar date), so equal values
get equal pseudonyms in all documents, and different values different ones. E-mail addresses and secrets have no numeric
domain: their letters and digits are replaced by a keyed hash of the same shape, which also links equal values.

Null texts stay null, empty texts empty; nothing is cut, however long a text is. Repeated rows get equal results. Other
columns stay; n_replaced is added by `count_column` if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Fixed patterns, most specific first.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
SECRET = r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|token|secret|api_key)\s*[=:]\s*)[\x22']?[A-Za-z0-9_/+-]{8,}[\x22']?"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
PHONE = r"(?<![\d(])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: A chain of digit groups up to where another kind starts, of 13 digits or more.
CARD = rf"(?<![\d.-])(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{EMAIL}|{DATE}|{IP}|{PHONE}|{SSN})\d++)*+"
ANY = "|".join((EMAIL, SECRET, DATE, IP, PHONE, SSN, CARD))
#: Layouts of cards: one run, 4-4-4-n, 4-4-4-4-n, 4-6-4 and 4-6-5.
LAYOUT = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1(?:\d{1,7}|\d{4}\1\d{1,3})|\d{4}([ -])\d{6}\2\d{4,5})$"


def _round(key: str, kind: str, i: Column, x: Column, modulus: int) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(modulus))


def feistel(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """struct(l, r): a keyed permutation of the pairs with 0 <= l < a and 0 <= r < b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        turned = F.struct(F.pmod(s["l"] + _round(key, kind, i, s["r"], a), F.lit(a)).alias("l"), s["r"].alias("r"))
        other = F.struct(s["l"].alias("l"), F.pmod(s["r"] + _round(key, kind, i, s["l"], b), F.lit(b)).alias("r"))
        return F.when(i % 2 == 0, turned).otherwise(other)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(x: Column, body) -> Column:
    """`body(x)` with x worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum of a digit string; whether its last digit is doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == (0 if doubled_last else 1), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _into(shape: Column, digits: Column) -> Column:
    """`shape` with its digits, from the left, replaced by `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike(r"^\d$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, "(?!^)"), start, step)["out"]


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        out = m
        for n in range(13, 20):
            left = (n - 1) // 2
            right = n - 1 - left
            made = _let(feistel(F.substring(d, 1, left), F.substring(d, left + 1, right), 10**left, 10**right, key, f"card{n}"), _card_digits(left, right))
            out = F.when(F.length(d) == n, _into(m, made)).otherwise(out)
        return F.when(_luhn_sum(d, False) % 10 == 0, out).otherwise(m)

    return _let(_digits(m), of)


def _groups(groups: Column, a: Column, b: Column) -> Column:
    """Groups a to b, counted from 0, with the separators between them."""
    return F.regexp_replace(F.array_join(F.slice(groups, a + 1, b - a + 1), ""), "[ -]$", "")


def _cards(m: Column, key: str) -> Column:
    """struct(new, n): a chain with its n cards replaced. From the left, a group starts a card if groups from there make a
    number that passes in a card's layout, or, where none in a layout overlaps, any number that passes (the longest)."""

    def of(groups: Column) -> Column:
        none, last = F.lit(-1), F.size(groups) - 1

        def ends(i: Column) -> Column:
            """struct(laid, other): last groups of the numbers that start at group i, -1 for none."""

            def tested(e: Column) -> Column:
                return _let(_groups(groups, i, e), lambda run: _let(_digits(run), lambda d: F.struct(e.alias("e"), run.rlike(LAYOUT).alias("laid"), (F.length(d).between(13, 19) & (_luhn_sum(d, False) % 10 == 0)).alias("good"))))

            def pick(x: Column) -> Column:
                laid, other = F.filter(x, lambda t: t["good"] & t["laid"]), F.filter(x, lambda t: t["good"])
                return F.struct(F.coalesce(F.array_min(F.transform(laid, lambda t: t["e"])), none).alias("laid"), F.coalesce(F.array_max(F.transform(other, lambda t: t["e"])), none).alias("other"))

            return _let(F.transform(F.sequence(i, F.least(i + 18, last)), tested), pick)

        def chosen(found: Column) -> Column:
            start = F.struct(F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("runs"), F.lit(0).alias("free"))

            def step(s: Column, i: Column) -> Column:
                x = F.get(found, i)
                overlaps = F.exists(F.slice(found, i + 2, F.greatest(x["other"] - i, F.lit(0))), lambda y: y["laid"] >= 0)
                b = F.when(i < s["free"], none).when(x["laid"] >= 0, x["laid"]).when((x["other"] >= 0) & ~overlaps, x["other"]).otherwise(none)
                return _let(b, lambda e: F.when(e >= 0, F.struct(F.concat(s["runs"], F.array(F.struct(i.alias("a"), e.alias("b")))).alias("runs"), (e + 1).alias("free"))).otherwise(s))

            return F.aggregate(F.sequence(F.lit(0), last), start, step)["runs"]

        def joined(runs: Column) -> Column:
            def part(r: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(runs, k - 1)["b"] + 1).otherwise(0)
                gap = F.array_join(F.slice(groups, before + 1, r["a"] - before), "")
                return F.concat(gap, _card(_groups(groups, r["a"], r["b"]), key), F.regexp_extract(F.get(groups, r["b"]), "[ -]?$", 0))

            done = F.when(F.size(runs) > 0, F.get(runs, F.size(runs) - 1)["b"] + 1).otherwise(0)
            tail = F.array_join(F.slice(groups, done + 1, F.size(groups) - done), "")
            return F.struct(F.concat(F.array_join(F.transform(runs, part), ""), tail).alias("new"), F.size(runs).alias("n"))

        return _let(_let(F.transform(F.sequence(F.lit(0), last), ends), chosen), joined)

    return _let(F.regexp_extract_all(m, F.lit(r"\d+[ -]?"), F.lit(0)), of)


def _card_digits(left: int, right: int):
    def join(s: Column) -> Column:
        return _let(F.concat(_pad(s["l"], left), _pad(s["r"], right)), lambda d: F.concat(d, F.pmod(-_luhn_sum(d, True), F.lit(10)).cast("string")))

    return join


def _phone(m: Column, key: str) -> Column:
    """Area code and exchange stay in 200 to 999; a leading country code stays."""

    def of(d: Column) -> Column:
        ten = F.substring(d, -10, 10)
        s = feistel(F.substring(ten, 1, 3).cast("long") - 200, F.substring(ten, 4, 7).cast("long") - 2_000_000, 800, 8_000_000, key, "phone")
        made = _let(s, lambda x: F.concat((x["l"] + 200).cast("string"), (x["r"] + 2_000_000).cast("string")))
        return _into(m, F.concat(F.when(F.length(d) == 11, F.substring(d, 1, 1)).otherwise(""), made))

    return _let(_digits(m), of)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""

    def of(d: Column) -> Column:
        area, group, serial = (F.substring(d, i, n).cast("long") for i, n in ((1, 3), (4, 2), (6, 4)))
        rank = F.when(area > 666, area - 2).otherwise(area - 1)
        s = feistel(rank, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

        def show(x: Column) -> Column:
            new = F.when(x["l"] >= 665, x["l"] + 2).otherwise(x["l"] + 1)
            return _into(m, F.concat(_pad(new, 3), _pad(F.floor(x["r"] / 9999) + 1, 2), _pad(x["r"] % 9999 + 1, 4)))

        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _let(s, show)).otherwise(m)

    return _let(_digits(m), of)


def _ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        n = [F.get(o, F.lit(i)).cast("long") for i in range(4)]
        s = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "ip")
        show = lambda x: F.concat_ws(".", *[F.floor(x[side] / by).cast("long") % 256 for side in ("l", "r") for by in (256, 1)])
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), _let(s, show)).otherwise(m)

    return _let(F.split(m, r"\."), of)


def _date(m: Column, key: str) -> Column:
    """Days from 1900-01-01 on: 150 x 487 of them."""
    iso = m.contains("-")

    def of(day: Column) -> Column:
        n = F.datediff(day, F.lit("1900-01-01").cast("date"))
        s = feistel(F.floor(n / 487), n % 487, 150, 487, key, "date")

        def show(x: Column) -> Column:
            new = F.date_add(F.lit("1900-01-01").cast("date"), (x["l"] * 487 + x["r"]).cast("int"))
            return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "dd/MM/yyyy"))

        return F.when(n.between(0, 150 * 487 - 1), _let(s, show)).otherwise(m)

    return _let(F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "dd/MM/yyyy")), of)


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: str) -> Column:
    """What stands before a value stays; the value becomes as many hex digits (upper case after AKIA)."""
    head = F.regexp_extract(m, r"^(?i:AKIA|(?:password|passwd|token|secret|api_key)\s*[=:]\s*[\x22']?)", 0)
    tail = F.regexp_extract(m, r"[\x22']?$", 0)
    value = F.substring(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail))

    def of(v: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), v), 256)
        long = F.substring(F.repeat(digest, F.ceil(F.length(v) / 64).cast("int")), F.lit(1), F.length(v))
        return F.concat(head, F.when(head == "AKIA", F.upper(long)).otherwise(long), tail)

    return _let(value, of)


def pseudonym(m: Column, key: str) -> Column:
    """struct(new, n): what stands in for one match of ANY, and how many values were replaced in it."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    other = (
        F.when(whole(EMAIL), _email(m, key))
        .when(whole(SECRET), _secret(m, key))
        .when(whole(DATE), F.coalesce(_date(m, key), m))
        .when(whole(IP), _ip(m, key))
        .when(whole(PHONE), _phone(m, key))
        .when(whole(SSN), _ssn(m, key))
    )
    return _let(other, lambda x: F.when(x.isNotNull(), F.struct(x.alias("new"), (x != m).cast("int").alias("n"))).otherwise(_cards(m, key)))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count_column: str | None = None) -> DataFrame:
    """`docs` with the personal data of `text` replaced; count_column: how many values were."""
    t = F.col(text)
    held = docs.withColumn("_lw_new", F.when(t.rlike(r"[0-9@]|(?i:password|passwd|token|secret|api_key)"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    held = held.withColumn("_lw_new", F.when(F.size("_lw_new") > 0, F.transform("_lw_new", lambda m: pseudonym(m, key))))
    between = F.split(t, ANY, -1)
    joined = F.concat(F.array_join(F.transform("_lw_new", lambda x, i: F.concat(F.get(F.col("_lw_parts"), i), x["new"])), ""), F.element_at("_lw_parts", -1))
    held = held.withColumn("_lw_parts", F.when(F.col("_lw_new").isNotNull(), between))
    out = held.withColumn(text, F.when(F.col("_lw_new").isNull(), t).otherwise(joined))
    if count_column:
        out = out.withColumn(count_column, F.coalesce(F.aggregate("_lw_new", F.lit(0), lambda n, x: n + x["n"]), F.lit(0)))
    return out.drop("_lw_new", "_lw_parts")
