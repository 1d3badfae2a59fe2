"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

Card numbers (Luhn), phone numbers, IPv4 addresses, social security numbers and dates are found by pattern, validated, and
permuted by a keyed Feistel network within their own format: a valid card number becomes another valid card number with the
same separators, an address another address, a date another date of the same hundred years. The permutation is one to one
for a key and format, so equal values stay equal in all documents and different ones stay different. E-mail names and long
hexadecimal secrets, which are no numbers, get a keyed digest of the same kind of characters. What fails its validation
(a number that is no card, an address with an octet over 255) is left as it is.

Fixed conventions: dates are YYYY-MM-DD, DD.MM.YYYY or DD/MM/YYYY, and MM/DD/YYYY where only that is a date, of the years 1020
to 9919; card numbers have 13 to 19 digits, in one run or in groups of four; phone numbers begin with + and keep their
country code.

A null text stays null, an empty one empty; long texts are read whole; equal rows give equal rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "replace this key"
ROUNDS = 10
LOCAL = r"\p{L}\p{N}._%+-"
PATTERNS = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+@[A-Za-z0-9-]{{1,63}}+(?:\.[A-Za-z0-9-]{{1,63}}+)++",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d|\.\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Every pattern needs one of these, which few texts hold.
HINT = "@|[0-9]|[a-f]{32}|[A-F]{32}"


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _feistel(a: Column, b: Column, ma: Column, mb: Column, tweak: Column) -> Column:
    """Permutes (a, b), 0 <= a < ma, 0 <= b < mb, one to one; struct of both. ROUNDS is even, so sides end where they began."""
    begin = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(acc: Column, k: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", tweak, k.cast("string"), acc["b"].cast("string")), 256)
        value = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        modulus = F.when(k % 2 == 0, ma).otherwise(mb).cast("long")
        return F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + F.pmod(value, modulus), modulus).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits_permuted(digits: Column, tweak: Column) -> Column:
    """A run of 2 to 36 digits as another run of the same length."""

    def run(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        v = n - u
        sides = _feistel(F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, v).cast("long"), _power(u), _power(v), F.concat_ws("|", tweak, n.cast("string")))
        return _let(sides, lambda out: F.concat(F.lpad(out["a"].cast("string"), u, "0"), F.lpad(out["b"].cast("string"), v, "0")))

    return _let(digits, run)


def _luhn_sum(digits: Column) -> Column:
    """Sum of a number whose last digit is the check digit."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, k: acc + _luhn_value(F.substring(digits, -k, F.lit(1)).cast("int"), k % 2 == 0),
    )


def _luhn_value(d: Column, doubled: Column) -> Column:
    return F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)


def _with_check_digit(body: Column) -> Column:
    return _let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def _refilled(match: Column, digits: Column) -> Column:
    """The match with its digits replaced one by one."""

    def run(new: Column) -> Column:
        def at(k: Column) -> Column:
            own = F.substring(match, k, F.lit(1))
            rank = F.length(F.regexp_replace(F.substring(match, F.lit(1), k), r"\D", ""))
            return F.when(own.rlike(r"\d"), F.substring(new, rank, F.lit(1))).otherwise(own)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(match)), at), "")

    return _let(digits, run)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"\D", "")


def _card(m: Column, key: Column) -> Column:
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = _with_check_digit(digits_permuted(body, F.concat_ws("|", key, F.lit("card"))))
    return F.when(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, _refilled(m, new))


def _phone(m: Column, key: Column) -> Column:
    digits = _digits(m)
    code = F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1)
    rest = F.substring(digits, F.length(code) + 1, F.length(digits))
    return _refilled(m, F.concat(code, digits_permuted(rest, F.concat_ws("|", key, F.lit("phone"), code))))


def _ssn(m: Column, key: Column) -> Column:
    valid = ~m.rlike(r"^(000|666|9)|-00-|-0000$")
    # Area 1..899 without 666, group 1..99, serial 1..9999, as one number of mixed radix.
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    rank = area - F.when(area > 666, 2).otherwise(1)
    sides = _feistel(rank * 99 + group - 1, serial - 1, _lit(898 * 99), _lit(9999), F.concat_ws("|", key, F.lit("ssn")))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def written(out: Column) -> Column:
        place = F.floor(out["a"] / 99)
        return F.concat_ws("-", pad(place + F.when(place >= 665, 2).otherwise(1), 3), pad(out["a"] % 99 + 1, 2), pad(out["b"] + 1, 4))

    return F.when(valid, _let(sides, written))


def _ip(m: Column, key: Column) -> Column:
    valid = m.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}$")
    n = [F.element_at(F.split(m, r"\."), k).cast("long") for k in (1, 2, 3, 4)]
    sides = _feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], _lit(65536), _lit(65536), F.concat_ws("|", key, F.lit("ip")))

    def written(out: Column) -> Column:
        octets = [F.floor(out["a"] / 256), out["a"] % 256, F.floor(out["b"] / 256), out["b"] % 256]
        return F.concat_ws(".", *[o.cast("long").cast("string") for o in octets])

    return F.when(valid, _let(sides, written))


def _date(m: Column, key: Column) -> Column:
    """A date by its number within a hundred years from a year that ends in 20: 36,525 = 75 * 487 or 36,524 = 92 * 397 days."""
    day_first = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))
    month_first = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))
    read = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    iso, dotted = m.rlike("^....-"), m.contains(".")
    parsed = F.struct(read(m).alias("iso"), read(day_first).alias("a"), read(month_first).alias("b"))

    def run(p: Column) -> Column:
        day = F.when(iso, p["iso"]).when(dotted, p["a"]).otherwise(F.coalesce(p["a"], p["b"]))
        start = (F.floor((F.year(day) - 20) / 100) * 100 + 20).cast("int")
        first, end = F.make_date(start, F.lit(1), F.lit(1)), F.make_date(start + 100, F.lit(1), F.lit(1))
        leap = F.datediff(end, first) == 36525
        ma, mb = F.when(leap, _lit(75)).otherwise(_lit(92)), F.when(leap, _lit(487)).otherwise(_lit(397))
        at = F.datediff(day, first).cast("long")
        sides = _feistel(F.floor(at / mb), at % mb, ma, mb, F.concat_ws("|", key, F.lit("date"), start.cast("string")))
        new = F.date_add(first, _let(sides, lambda out: out["a"] * mb + out["b"]).cast("int"))
        form = F.when(iso, "yyyy-MM-dd").when(dotted, "dd.MM.yyyy").when(p["a"].isNotNull(), "dd/MM/yyyy").otherwise("MM/dd/yyyy")
        return F.when(F.year(day).between(1020, 9919), _let(new, lambda d: F.call_function("date_format", d, form)))

    return _let(parsed, run)


def _email(m: Column, key: Column) -> Column:
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    digest = F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256)
    return F.when(name != "", F.concat(F.lit("u"), F.substring(digest, 1, 15), F.lit("@"), domain))


def _secret(m: Column, key: Column) -> Column:
    parts = [F.sha2(F.concat_ws("|", key, F.lit("secret"), F.lit(str(k)), F.lower(m)), 256) for k in range(2)]
    new = F.substring(F.concat(*parts), F.lit(1), F.length(m))
    # Digits alone are a number that no rule validates.
    return F.when(~m.rlike(r"^\d+$"), F.when(m.rlike("[A-Z]"), F.upper(new)).otherwise(new))


KINDS: dict[str, Callable[[Column, Column], Column]] = {
    "email": _email, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "secret": _secret, "card": _card,
}
FORMS = {
    "email": "@", "phone": r"^\+", "date": r"^(\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})$", "ssn": r"^\d{3}-\d\d-\d{4}$",
    "ip": r"^(\d{1,3}\.){3}\d{1,3}$", "secret": "^[0-9A-Fa-f]{32,}$", "card": r"^[\d -]+$",
}


def pseudonymised(df: DataFrame, key: str = KEY, text: str = "text", found: str | None = None) -> DataFrame:
    """The rows of `df` with pseudonyms in `text`; `found` names an added array of the kinds replaced, in text order."""
    own = F.col(text).cast("string")
    secret = F.lit(key)
    any_match = F.when(own.rlike(HINT), F.regexp_extract_all(own, F.lit(ANY), F.lit(0)))

    def replaced(m: Column) -> Column:
        kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name in reversed(KINDS):
            kind = F.when(m.rlike(FORMS[name]), F.lit(name)).otherwise(kind)
            new = F.when(m.rlike(FORMS[name]), KINDS[name](m, secret)).otherwise(new)
        return F.struct(m.alias("old"), new.alias("new"), kind.alias("kind"))

    # Each step is a projection of its own, so that no expression is worked out twice; the input's columns stay in a struct.
    rows = df.select(F.struct(*df.columns).alias("_row"), own.alias("_text"), any_match.alias("_matches"))
    rows = rows.withColumn("_new", F.when(F.size("_matches") > 0, F.transform("_matches", replaced)))
    rows = rows.withColumn("_gaps", F.when(F.col("_new").isNotNull(), F.split("_text", ANY, -1)))
    joined = F.array_join(
        F.transform("_new", lambda x, k: F.concat(F.col("_gaps")[k], F.coalesce(x["new"], x["old"]))), ""
    )
    whole = F.concat(joined, F.element_at("_gaps", -1))
    kinds = F.transform(F.filter(F.col("_new"), lambda x: x["new"].isNotNull()), lambda x: x["kind"])
    got = {text: F.when(F.col("_new").isNotNull(), whole).otherwise(F.col("_text"))}
    if found:
        got[found] = F.coalesce(kinds, F.array().cast("array<string>"))
    kept = [F.col("_row")[c].alias(c) if c not in got else got.pop(c).alias(c) for c in df.columns]
    return rows.select(*kept, *[v.alias(c) for c, v in got.items()])
