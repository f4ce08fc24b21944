"""Operator 4: format-preserving pseudonyms by keyed Feistel permutations, in SQL functions.

One pattern finds candidates in the whole text; each is validated for its kind and, if
valid, replaced by another valid value of the same form.  Equal values give equal
pseudonyms in every document, different values of a kind different ones, and the key's
holder can undo them (``reveal``).  There is no shuffle and no Python per row: the text
is split at the matches, the matches are transformed, and both are zipped together.

Kinds, and the domain that a kind's permutation keeps:

- card: 13 to 19 digits, whole or in fours, of a valid Luhn sum; the first digit stays,
  the last is computed anew.
- phone: (ddd) ddd-dddd or ddd-ddd-dddd, with or without +1; its ten digits.
- ssn: ddd-dd-dddd with an area of 001-899 but 666, group 01-99 and serial 0001-9999.
- ip: four octets up to 255 without leading zeros.
- date: an existing day of 1900-2099 as yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy; 29
  February goes to 29 February of another year.
- iban: two letters and 13 to 32 digits and capitals of a valid checksum; digits of the
  account are permuted, letters stay, the checksum is computed anew.
- email: the part before @ becomes ten keyed letters (linked, but not to be undone).

A permutation acts on pairs (a, b) below (m1, m2): rounds add, in turn, a keyed hash of
one half to the other, modulo its size.  Invalid candidates stay as they are.  Null text
stays null with no finds; empty and repeated rows are rows like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of a permutation.
ROUNDS = 10

# The written forms of the kinds.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9/-])"
PHONE = r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, DATE, PHONE, SSN, IP, CARD, IBAN))

KINDS = ("card", "phone", "ssn", "ip", "date", "iban", "email")


def _hash(key: str, kind: str, turn: Column, value: Column) -> Column:
    """60 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def permute(key: str, kind: str, a: Column, b: Column, m1: Column, m2: Column, undo: bool = False) -> Column:
    """struct(a, b) permuted within 0..m1-1 and 0..m2-1."""
    sign = -1 if undo else 1
    turns = [F.lit(i) for i in range(ROUNDS)]

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + sign * (_hash(key, kind, i, s["b"]) % m1), m1)).otherwise(s["a"]).cast("bigint").alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + sign * (_hash(key, kind, i, s["a"]) % m2), m2)).cast("bigint").alias("b"),
        )

    return F.aggregate(F.array(*(turns[::-1] if undo else turns)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def permute_digits(key: str, kind: str, digits: Column, undo: bool = False) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    # the length is part of the kind, so that no two lengths share a permutation's hashes
    a, b = digits.substr(F.lit(1), u), digits.substr(u + 1, n - u)
    return _let(permute(key, kind, a, b, _power(u), _power(n - u), undo), lambda s: F.concat(F.lpad(s["a"].cast("string"), u, F.lit("0")), F.lpad(s["b"].cast("string"), n - u, F.lit("0"))))


def _refill(form: Column, digits: Column) -> Column:
    """form, its digits replaced in order by the given ones."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, digits.substr(s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def _luhn(digits: Column, double_last: bool) -> Column:
    """The Luhn sum modulo 10; double_last: the last digit counts double."""
    back = F.split(F.reverse(digits), "")

    def weight(c: Column, i: Column) -> Column:
        x = c.cast("int")
        return F.when(i % 2 == (0 if double_last else 1), x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.transform(back, weight), F.lit(0), lambda s, x: s + x) % 10


def _mod97(text: Column) -> Column:
    """Digits and capitals (A = 10) as one number, modulo 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(x: Column, key: str, undo: bool) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(d.substr(F.lit(1), F.lit(1)), permute_digits(key, "card", d.substr(F.lit(2), F.length(d) - 2), undo))
        return _let(body, lambda b: _refill(x, F.concat(b, ((10 - _luhn(b, True)) % 10).cast("string"))))

    return _let(_digits(x), lambda d: F.when(_luhn(d, False) == 0, new(d)))


def _phone(x: Column, key: str, undo: bool) -> Column:
    return _let(_digits(x), lambda d: _refill(x, F.concat(d.substr(F.lit(1), F.length(d) - 10), permute_digits(key, "phone", F.right(d, F.lit(10)), undo))))


def _ssn(x: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.split(x, "-")[i].cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    a = area - 1 - F.when(area > 666, 1).otherwise(0)
    b = (group - 1) * 9999 + serial - 1

    def form(s: Column) -> Column:
        number = s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", number, F.floor(s["b"] / 9999) + 1, s["b"] % 9999 + 1)

    return F.when(valid, _let(permute(key, "ssn", a, b, F.lit(898), F.lit(99 * 9999), undo), form))


def _ip(x: Column, key: str, undo: bool) -> Column:
    part = F.split(x, "\\.")
    o = [part[i].cast("int") for i in range(4)]
    valid = ~x.rlike(r"(^|\.)0[0-9]") & (F.greatest(*o) <= 255)
    half = F.lit(65536)
    return F.when(valid, _let(permute(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], half, half, undo), lambda s: F.concat_ws(".", *[F.floor(s[h] / 256).cast("string") if top else (s[h] % 256).cast("string") for h in "ab" for top in (True, False)])))


def _date(x: Column, key: str, undo: bool) -> Column:
    iso = F.when(x.contains("."), F.concat_ws("-", x.substr(7, 4), x.substr(4, 2), x.substr(1, 2))).when(x.contains("/"), F.concat_ws("-", x.substr(7, 4), x.substr(1, 2), x.substr(4, 2))).otherwise(x)

    def new(day: Column) -> Column:
        year = F.year(day)
        leap_day = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
        # the place of a day among 365, that of a common year
        place = F.datediff(F.make_date(F.lit(1901), F.month(day), F.dayofmonth(day)), F.lit("1901-01-01").cast("date"))
        common = _let(permute(key, "date", year - 1900, place, F.lit(200), F.lit(365), undo), lambda s: _let(F.date_add(F.lit("1901-01-01").cast("date"), s["b"].cast("int")), lambda d: F.make_date((s["a"] + 1900).cast("int"), F.month(d), F.dayofmonth(d))))
        # the 49 leap years from 1904 to 2096, as 7 by 7
        leap = F.floor((year - 1904) / 4)
        leaps = _let(permute(key, "leap day", F.floor(leap / 7), leap % 7, F.lit(7), F.lit(7), undo), lambda s: F.make_date((1904 + 4 * (s["a"] * 7 + s["b"])).cast("int"), F.lit(2), F.lit(29)))
        return _let(F.when(leap_day, leaps).otherwise(common), lambda d: F.date_format(d, "yyyy-MM-dd"))

    def form(d: Column) -> Column:
        y, m, t = d.substr(1, 4), d.substr(6, 2), d.substr(9, 2)
        return F.when(x.contains("."), F.concat_ws(".", t, m, y)).when(x.contains("/"), F.concat_ws("/", m, t, y)).otherwise(d)

    return _let(F.try_to_date(iso, "yyyy-MM-dd"), lambda day: F.when(day.isNotNull(), _let(new(day), form)))


def _iban(x: Column, key: str, undo: bool) -> Column:
    country, account = x.substr(1, 2), F.substring(x, 5, 99)
    digits = _digits(account)

    def check(a: Column) -> Column:
        return F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)

    valid = (_mod97(F.concat(account, country, x.substr(3, 2))) == 1) & (F.length(digits) >= 2)
    return F.when(valid, _let(_refill(account, permute_digits(key, "iban", digits, undo)), check))


def _email(x: Column, key: str) -> Column:
    local = F.lower(F.substring_index(x, "@", 1))
    letters = F.translate(F.lpad(F.conv(_hash(key, "email", F.lit(0), local).cast("string"), 10, 16), 15, "0"), "0123456789ABCDEF", "abcdefghijklmnop")
    return F.concat(F.substring(letters, 1, 10), F.lit("@"), F.substring_index(x, "@", -1))


def _is(x: Column, pattern: str) -> Column:
    return x.rlike(f"^(?:{pattern})$")


def _replace(x: Column, key: str, undo: bool) -> Column:
    """struct(kind, new) of a candidate; kind is null where it isn't valid."""
    forms = (
        ("email", EMAIL, F.lit(None).cast("string") if undo else _email(x, key)),
        ("date", DATE, _date(x, key, undo)),
        ("phone", PHONE, _phone(x, key, undo)),
        ("ssn", SSN, _ssn(x, key, undo)),
        ("ip", IP, _ip(x, key, undo)),
        ("card", CARD, _card(x, key, undo)),
        ("iban", IBAN, _iban(x, key, undo)),
    )
    out = F.lit(None).cast("struct<kind:string,new:string>")
    for kind, pattern, new in reversed(forms):
        out = F.when(_is(x, pattern), F.struct(F.lit(kind).alias("kind"), new.alias("new"))).otherwise(out)
    return _let(out, lambda r: F.struct(F.when(r["new"].isNotNull(), r["kind"]).alias("kind"), F.coalesce(r["new"], x).alias("new")))


def _done(text: Column, key: str, undo: bool) -> Column:
    """struct(text, kinds) with the pseudonyms in place."""

    def whole(made: Column) -> Column:
        new = F.zip_with(F.split(text, PATTERN, -1), made["new"], lambda part, m: F.concat(part, F.coalesce(m, F.lit(""))))
        return F.struct(F.array_join(new, "").alias("text"), F.filter(made["kind"], lambda k: k.isNotNull()).alias("kinds"))

    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    plain = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    # most texts hold neither @ nor a digit
    return F.when(text.rlike("[0-9@]"), _let(F.transform(found, lambda x: _replace(x, key, undo)), whole)).otherwise(plain)


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """All columns and rows, with the personal data in ``text_col`` replaced."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = names[[c.lower() for c in df.columns].index(text_col.lower())]
    return df.toDF(*names).select(*[_done(F.col(c), key, undo)["text"].alias(c) if c == at else F.col(c) for c in names]).toDF(*df.columns)


def reveal(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Undoes pseudonymise with the same key, but for email addresses."""
    return pseudonymise(df, key, text_col, undo=True)


def personal_data(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, the pseudonymised text, n_found and one count for each kind."""
    lower = [c.lower() for c in df.columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(lower))])
    rows = plain.select(F.col(f"c{lower.index(id_col.lower())}").alias("id"), F.col(f"c{lower.index(text_col.lower())}").alias("text"))
    made = rows.select("id", _done(F.col("text"), key, False).alias("made"))
    counts = [F.expr(f"cast(size(filter(made.kinds, k -> k = '{kind}')) as bigint) as n_{kind}") for kind in KINDS]
    return made.select(F.col("id").alias(id_col), F.col("made.text").alias("text"), F.size("made.kinds").cast("long").alias("n_found"), *counts)
