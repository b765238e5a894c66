"""Format-preserving Feistel pseudonyms, in DataFrame expressions only.

Validated values are permuted, under a key, within their own format: an alternating Feistel
network over Z_a x Z_b adds to one half a keyed hash of the other, so it is a permutation of
exactly the a*b values of the format, and equal values stay equal in all documents.

    card       13-19 digits that pass the Luhn test: the first digit stays, the check digit is made anew
    iban       country and length stay, check digits (mod 97) are made anew
    phone      the digits after the country code (one to three of them, as assigned)
    ssn        valid area, group and serial numbers go to valid ones
    ip         four octets
    date       valid days from 1800 to 2199, permuted among all dates that one written form holds:
               its signs, its order, and for each part whether it has one digit, a leading zero or two
               digits; a day first and a month first with slashes are one form.  The same day in two
               forms is linked where both pad and neither is of that form
    email      letters and digits of the name, and those of all but the top domain, each within its
               class; case stays in place and doesn't change the pseudonym
    secret     the value after token/password/secret/key, and access key ids; a-f and g-z are classes
               of their own, so hexadecimal values stay so

Each of these is a permutation, so different values never get one pseudonym.
Numbers that fail their test, and all other text, stay as they are.
"""

from __future__ import annotations

import calendar
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
KEY_SETTING = "spark.kinspark.pii.key"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:1[89]|2[01])[0-9]{2}"

# What is looked for, most specific first; a match is of the first kind whose pattern fits it whole.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,6}\.[\p{L}]{2,24}(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:(?i:token|password|passwd|secret|api[_-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?[0-9A-Za-z]{12,128}|(?:AKIA|ASIA)[0-9A-Z]{16})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9./-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_YEAR}/{_MONTH}/{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|[0-9]{{1,2}}/[0-9]{{1,2}}/{_YEAR})(?![0-9]|[./-][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
#: One group for each kind.
ANY = "|".join(f"({p})" for p in PATTERNS.values())
# Around and within a match.  ESCAPE in a text gets HELD behind it, so that EDGE is nowhere else; no pattern matches either.
ESCAPE, HELD, EDGE, FIELD = "\x01", "\x01\x02", "\x01\x03", "\x02"
#: Part of every match, and rare elsewhere; cheap, as nearly all characters fail at the first test.
HINT = (
    r"(?=[@=:A-Z+)0-9])(?:@|[=:] {0,2}[\"']?[0-9A-Za-z]{12}|A[KS]IA[0-9A-Z]{16}|[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}|\+[1-9]|\) ?[0-9]{3}-"
    r"|[0-9](?:[-/.][0-9]{1,3}[-/.][0-9]|[ -][0-9]{4}(?:[0-9]{2})?[ -][0-9]{4}|[0-9]{12}))"
)


def keyed(key: str, kind: str, r: Column, half: Column) -> Column:
    """60 bits of a keyed hash as a long."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """body of a name for `value`, which is so made once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def feistel(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """The permutation of 0..a*b-1 at `value`."""
    left = ((value - F.pmod(value, b)) / b).cast("decimal(20,0)").cast("long")
    start = F.struct(left.alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def turn(acc: Column, r: Column) -> Column:
        one = F.when(r % 2 == 0, F.pmod(acc["l"] + F.pmod(keyed(key, kind, r, acc["r"]), a), a)).otherwise(acc["l"])
        two = F.when(r % 2 == 1, F.pmod(acc["r"] + F.pmod(keyed(key, kind, r, acc["l"]), b), b)).otherwise(acc["r"])
        return F.struct(one.cast("long").alias("l"), two.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["l"] * b + acc["r"])


def power(n: Column) -> Column:
    """10**n as a long."""
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("long")


def digits_feistel(digits: Column, key: str, kind: str) -> Column:
    """A string of up to 18 digits to another of the same length."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    moved = feistel(digits.cast("long"), power(half), power(n - half), key, kind)
    return F.when(n > 0, F.lpad(moved.cast("string"), n, "0")).otherwise(digits)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(text: Column, digits: Column, skip: Column | int = 0) -> Column:
    """text with its digits after the first `skip` replaced, in order, by `digits`."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        at = acc["k"] - skip
        new = F.when(is_digit & (at >= 0), F.substring(digits, at + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["s"], new).alias("s"), (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(text, ""), start, put, lambda acc: acc["s"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum from the right, every second digit doubled from place `doubled` (0 or 1) on."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def card(text: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        middle = digits_feistel(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card")
        valid = (luhn_sum(digits, 1) % 10 == 0) & digits.rlike("^[2-6]")
        return F.when(valid, let(let(F.concat(F.substring(digits, 1, 1), middle), checked), lambda whole: refilled(text, whole)))

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - F.pmod(luhn_sum(body, 0), F.lit(10)), F.lit(10)).cast("string"))

    return let(only_digits(text), made)


def shifted(text: Column, other: Column, r: Column, key: str, kind: str, split_hex: bool) -> Column:
    """Each letter and digit moved within its class by a hash of the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other), 256)
    classes = [("0", "9"), *((("a", "f"), ("g", "z"), ("A", "F"), ("G", "Z")) if split_hex else (("a", "z"), ("A", "Z"))), ("à", "ö"), ("À", "Ö")]

    def moves(d: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            k = F.conv(F.substring(d, F.pmod(2 * i, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")
            code, out = F.ascii(c), None
            for first, last in classes:
                new = F.char(ord(first) + F.pmod(code - ord(first) + k, F.lit(ord(last) - ord(first) + 1)))
                out = (F if out is None else out).when(code.between(ord(first), ord(last)), new)
            return out.otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), move), "")

    return F.when(F.length(text) > 0, let(digest, moves)).otherwise(text)


def string_feistel(text: Column, key: str, kind: str, split_hex: bool = False) -> Column:
    """Feistel over characters: a half's letters and digits move within their class by a hash of the other half."""
    n = F.length(text)
    cut = (n / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, n).alias("r"))

    def turn(acc: Column, r: Column) -> Column:
        return F.struct(
            F.when(r % 2 == 0, shifted(acc["l"], acc["r"], r, key, kind, split_hex)).otherwise(acc["l"]).alias("l"),
            F.when(r % 2 == 1, shifted(acc["r"], acc["l"], r, key, kind, split_hex)).otherwise(acc["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


_LOW, _HIGH = ("".join(map(chr, [*range(a, a + 26), *range(b, b + 23)])) for a, b in ((97, 224), (65, 192)))


def email(text: Column, key: str) -> Column:
    """Name and domain apart, so that those of one domain stay together."""
    host = F.substring_index(text, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    name = F.substring(text, F.lit(1), F.length(text) - F.length(host) - 1)
    label = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    moved = F.concat(*(x for part, kind, end in ((name, "email", F.lit("@")), (label, "domain", top)) for x in (string_feistel(F.translate(part, _HIGH, _LOW), key, kind), end)))

    def cased(new: Column) -> Column:
        one = lambda c, i: F.when((c != F.translate(c, _HIGH, _LOW)), F.translate(F.substring(new, i + 1, F.lit(1)), _LOW, _HIGH)).otherwise(F.substring(new, i + 1, F.lit(1)))
        return F.array_join(F.transform(F.split(text, ""), one), "")

    head = F.length(text) - F.length(top)
    return let(moved, lambda new: F.when(F.translate(text, _HIGH, _LOW) == text, new).otherwise(F.concat(F.substring(cased(new), F.lit(1), head), top)))


def secret(text: Column, key: str) -> Column:
    value = F.when(text.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$"), F.substring(text, F.lit(5), F.length(text))).otherwise(F.regexp_extract(text, "([0-9A-Za-z]+)$", 1))
    return let(value, lambda v: F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(v)), string_feistel(v, key, "secret", split_hex=True)))


# Calling codes of one digit, and of two; all others have three.
CODES_1, CODES_2 = "[17]", "2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def phone(text: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        code = F.when(~text.startswith("+"), 0).when(digits.rlike(f"^{CODES_1}"), 1).when(digits.rlike(f"^(?:{CODES_2})"), 2).otherwise(3)
        return let(code, lambda n: F.when(F.length(digits).between(8, 15), let(digits_feistel(F.substring(digits, n + 1, F.length(digits)), key, "phone"), lambda new: refilled(text, new, n))))

    return let(only_digits(text), made)


def ssn(text: Column, key: str) -> Column:
    area, group, serial = (F.substring(text, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(((place * 99 + group - 1) * 9999 + serial - 1).cast("long"), F.lit(898 * 99), F.lit(9999), key, "ssn")
    head, tail = F.floor(moved / 9999).cast("int"), (F.pmod(moved, F.lit(9999)) + 1).cast("int")
    place2 = F.floor(head / 99).cast("int")
    area2 = F.when(place2 >= 665, place2 + 2).otherwise(place2 + 1)
    return F.when(valid, F.format_string("%03d-%02d-%04d", area2, (F.pmod(head, F.lit(99)) + 1).cast("int"), tail))


def ip(text: Column, key: str) -> Column:
    value = F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    moved = feistel(value, F.lit(65536), F.lit(65536), key, "ip")
    return F.array_join(F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.pmod(F.floor(moved / F.pow(F.lit(2.0), s)), F.lit(256)).cast("int").cast("string")), ".")


YEARS = range(1800, 2200)  # a Gregorian cycle
LEAP = [str(y) for y in YEARS if calendar.isleap(y)]


def written(shape: str, lone: bool, last: int) -> dict[int, str]:
    """Numbers up to `last` as a part of this shape writes them: `1` one digit, `0` a zero before it, `2` two digits.

    Beside a lone digit two digits are not padded, so they begin at 10.
    """
    if shape == "2":
        return {n: f"{n:02}" for n in range(10 if lone else 1, last + 1)}
    return {n: f"{'0' if shape == '0' else ''}{n}" for n in range(1, 10)}


class Form(NamedTuple):
    """All dates that one form holds: `days` of every year, `leap` days of leap years."""

    name: str
    days: list[str]
    leap: list[str]

    @property
    def size(self) -> int:
        return len(YEARS) * len(self.days) + len(LEAP) * len(self.leap)

    @property
    def halves(self) -> tuple[int, int]:
        """Bases of about the square root whose product is the size, or exceeds it least."""
        root = math.isqrt(self.size)
        return min(((a, -(-self.size // a)) for a in range(root // 2, root + 1)), key=lambda ab: (ab[0] * ab[1], -ab[0]))


def forms() -> list[Form]:
    """Of month and day (named by their shapes), and of two numbers with a slash (named with `s`) where the second is the day only from 13 on."""
    out = []
    for slash in (False, True):
        for one, two in ("22", "11", "10", "12", "01", "21"):
            lone = "1" in (one, two)
            days, leap = [], []
            for n, first in written(one, lone, 31).items():
                for m, second in written(two, lone, 31).items():
                    month, day = (m, n) if slash and m <= 12 else (n, m)
                    if month <= 12 and day <= calendar.monthrange(2000, month)[1]:
                        (leap if (month, day) == (2, 29) else days).append(f"{first}-{second}")
            out.append(Form("s" * slash + one + two, days, leap))
    return out


FORMS = forms()


def date(text: Column, key: str) -> Column:
    words = lambda ws: F.split(F.lit(",".join(map(str, ws))), ",")
    longs = lambda ns: F.array(*[F.lit(n) for n in ns]).cast("array<bigint>")
    days, leaps, years = F.array(*[words(f.days) for f in FORMS]), F.array(*[words(f.leap) for f in FORMS]), words(LEAP)
    n_days, n_leap, sizes = longs(len(f.days) for f in FORMS), longs(max(1, len(f.leap)) for f in FORMS), longs(f.size for f in FORMS)
    left, right = longs(f.halves[0] for f in FORMS), longs(f.halves[1] for f in FORMS)
    spare = longs(f.halves[0] * f.halves[1] - f.size for f in FORMS)

    def read(p: Column) -> Column:
        """Year, then the two numbers: month and day, or as they stand with slashes."""
        sign, first = F.regexp_extract(text, "([-/.])", 1), F.length(p[0]) == 4
        return F.struct(
            F.when(first, p[0]).otherwise(p[2]).alias("y"), F.when(~first & (sign == "/"), p[0]).otherwise(p[1]).alias("one"),
            F.when(first, p[2]).when(sign == "/", p[1]).otherwise(p[0]).alias("two"), sign.alias("sign"), first.alias("first"),
        )

    def shape(x: Column, lone: Column) -> Column:
        return F.when(F.length(x) == 1, "1").when(lone & x.startswith("0"), "0").otherwise("2")

    def formed(d: Column) -> Column:
        lone = (F.length(d["one"]) == 1) | (F.length(d["two"]) == 1)
        name = F.concat(F.when(~d["first"] & (d["sign"] == "/"), "s").otherwise(""), shape(d["one"], lone), shape(d["two"], lone))
        return F.struct(d.alias("d"), (F.array_position(F.array(*[F.lit(f.name) for f in FORMS]), name) - 1).cast("int").alias("f"), F.concat_ws("-", d["one"], d["two"]).alias("day"))

    def ranked(x: Column) -> Column:
        """The place of the date in its form: days of every year by year, then leap days."""
        f, y = x["f"], x["d"]["y"]
        at, leap, at_leap = F.array_position(days[f], x["day"]), F.array_position(years, y), F.array_position(leaps[f], x["day"])
        common = (y.cast("long") - YEARS[0]) * n_days[f] + at - 1
        rank = F.when(at > 0, common).when((leap > 0) & (at_leap > 0), len(YEARS) * n_days[f] + (leap - 1) * n_leap[f] + at_leap - 1)
        return F.struct(x["d"].alias("d"), f.alias("f"), rank.alias("rank"))

    def moved(x: Column) -> Column:
        """Walks on while outside of the form: what is outside can't be met twice, so as many steps as that is suffice."""
        f = x["f"]

        def step(acc: Column, i: Column) -> Column:
            return F.when((i == 0) | (acc >= sizes[f]), feistel(acc, left[f], right[f], key, "date")).otherwise(acc)

        rank = F.aggregate(F.sequence(F.lit(0).cast("bigint"), spare[f]), x["rank"], step)
        return F.struct(x["d"].alias("d"), f.alias("f"), F.when(x["rank"].isNotNull(), rank).alias("rank"))

    def unranked(x: Column) -> Column:
        f, rest = x["f"], x["rank"] - len(YEARS) * n_days[x["f"]]
        div = lambda a, b: F.call_function("div", a, b)
        common = F.struct((YEARS[0] + div(x["rank"], n_days[f])).cast("string").alias("y"), F.get(days[f], F.pmod(x["rank"], n_days[f]).cast("int")).alias("day"))
        leap = F.struct(F.get(years, div(rest, n_leap[f]).cast("int")).alias("y"), F.get(leaps[f], F.pmod(rest, n_leap[f]).cast("int")).alias("day"))
        return F.struct(x["d"].alias("d"), F.when(x["rank"].isNotNull(), F.when(rest < 0, common).otherwise(leap)).alias("new"))

    def put(x: Column) -> Column:
        one, two, y = F.substring_index(x["new"]["day"], "-", 1), F.substring_index(x["new"]["day"], "-", -1), x["new"]["y"]
        sign = x["d"]["sign"]
        made = F.when(x["d"]["first"], F.concat(y, sign, one, sign, two)).when(sign == "/", F.concat(one, sign, two, sign, y)).otherwise(F.concat(two, sign, one, sign, y))
        return F.when(x["new"].isNotNull(), made)

    out = F.split(text, "[-/.]")
    for body in (read, formed, ranked, moved, unranked, put):
        out = let(out, body)
    return out


def iban(text: Column, key: str) -> Column:
    plain = F.regexp_replace(text, " ", "")

    def mod97(s: Column) -> Column:
        def add(acc: Column, c: Column) -> Column:
            v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
            return F.pmod(F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v), F.lit(97)).cast("int")

        return F.aggregate(F.split(s, ""), F.lit(0), add)

    account = F.substring(plain, F.lit(5), F.length(plain))
    country = F.substring(plain, 1, 2)
    valid = (mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34) & F.substring(plain, 3, 2).between("02", "98")
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def spaced(whole: Column) -> Column:
        return F.aggregate(
            F.split(text, ""), start,
            lambda acc, c: F.struct(F.concat(acc["s"], F.when(c == " ", c).otherwise(F.substring(whole, acc["k"] + 1, F.lit(1)))).alias("s"), (acc["k"] + (c != " ").cast("int")).alias("k")),
            lambda acc: acc["s"],
        )

    def whole(new: Column) -> Column:
        return F.concat(country, F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)

    return F.when(valid, let(let(string_feistel(account, key, "iban"), whole), spaced))


def pseudonym(found: Column, place: Column, key: str) -> Column:
    """struct(kind, value) of the match of the pattern at `place` (from 0); value stays and kind is null if it fails its test."""
    made = (email, secret, iban, phone, ssn, ip, date, card)
    value = None
    for n, build in enumerate(made):
        value = (F if value is None else value).when(place == n, build(found, key))
    kind = F.get(F.array(*[F.lit(k) for k in PATTERNS]), place)
    return let(value, lambda v: F.struct(F.coalesce(v, found).alias("value"), F.when(v.isNotNull(), kind).alias("kind")))


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """docs with `text` pseudonymised, and columns n_pii (values replaced) and pii_kinds (their kinds, sorted).

    Null texts stay null with n_pii 0; empty texts and texts without a valid value stay
    unchanged.  Repeated rows change alike.  Columns of docs that are named n_pii or pii_kinds
    give way to these; all others stay.  The key is taken from the session's
    spark.kinspark.pii.key where none is given; without a key there are no pseudonyms, so that
    is an error.
    """
    key = key if key is not None else docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a secret key: pass one or set {KEY_SETTING}")
    found_, made_ = free_name(docs.columns, "_found"), free_name(docs.columns, "_made")
    # one pass: each match between edges, behind as many field marks as kinds come before its own
    groups = FIELD.join(f"${k + 1}" for k in range(len(PATTERNS)))
    marked = F.regexp_replace(F.replace(F.col(text), F.lit(ESCAPE), F.lit(HELD)), ANY, f"{EDGE}{groups}{EDGE}")
    pieces = F.when(F.col(text).rlike(HINT), F.split(marked, EDGE, -1))
    rows = docs.withColumn(found_, F.when(F.size(pieces) > 1, pieces))
    any_found = F.col(found_).isNotNull()

    def piece(p: Column, i: Column) -> Column:
        plain = F.struct(F.replace(p, F.lit(HELD), F.lit(ESCAPE)).alias("value"), F.lit(None).cast("string").alias("kind"))
        place = F.length(p) - F.length(F.ltrim(p, F.lit(FIELD)))
        return F.when(i % 2 == 0, plain).otherwise(let(F.struct(F.btrim(p, F.lit(FIELD)).alias("m"), place.alias("place")), lambda x: pseudonym(x["m"], x["place"], key)))

    rows = rows.withColumn(made_, F.transform(found_, piece))
    joined = F.array_join(F.transform(made_, lambda m: m["value"]), "")
    kinds = F.filter(F.transform(made_, lambda m: m["kind"]), lambda k: k.isNotNull())
    rows = rows.withColumns({
        "n_pii": F.when(any_found, F.size(kinds)).otherwise(0).cast("long"),
        "pii_kinds": F.when(any_found, F.array_join(F.array_sort(F.array_distinct(kinds)), ",")).otherwise(""),
        text: F.when(any_found, joined).otherwise(F.col(text)),
    })
    return rows.drop(found_, made_)
