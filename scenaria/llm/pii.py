r"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Found: e-mail addresses, IPv4 addresses, payment card numbers (13 to 19 digits
with a right Luhn digit), IBANs (right by modulo 97), US social security
numbers (of a valid area), phone numbers, and calendar dates (Y-M-D, Y/M/D;
M/D/Y and M-D-Y or, where that is no date, D/M/Y and D-M-Y; D.M.Y). Numbers and
dates that fail validation are left alone, and so is all other text, IPv6
addresses included. One expression finds them all in the text as it was given, an
address before a number that begins with it, so nothing is replaced twice.

Each is keyed-permuted within its format by an alternating Feistel network with
SHA-2 round functions: equal values get equal pseudonyms in all documents, and
different values of a kind different ones. What is permuted is the bare value
(digits, or letters and digits, without separators), and the pseudonym is written
in the layout in which the value was found, so a value stays linked however it is
spaced. In detail: the part of an e-mail address before @, where digits, lower and
upper case keep their places and other characters stay; the digits of a phone
number after the country code, which is known by its digits; card digits but for
the Luhn digit and IBAN characters but for the check digits, both of which are
worked out anew; an IPv4 address as a 32-bit number; a social security number
within the valid areas; a date as a day within its window of 28 years (all such
windows from 1901 to 2096 have 10,227 days) or else within its own year. A phone
number without a country code is linked to the same digits behind any code.

The key is an argument. It stands in the query plan, so guard event logs as you
guard the key.

A pseudonym may by chance equal its value, once in as many as the format has.
Null texts stay null, empty and very long ones are read as all others, other
columns are not touched (a new column that is asked for replaces one of its name).
Every row gives one row, repeated ones too; an empty table gives none.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

ROUNDS = 8
KEY_SETTING = "spark.scenaria.pii.key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?<s>[ -])\d{4}\k<s>\d{4}\k<s>\d{1,7}|\d{4}(?<t>[ -])\d{6}\k<t>\d{5})(?!\d)"
#: Countries whose IBANs fill all their groups of four: nothing but the count of groups tells where those end.
FULL_GROUPS = {
    4: "BE",
    5: "AT|BA|EE|KZ|LT|LU|MN|XK",
    6: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    7: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG",
    8: "LC",
}
FULL = "|".join(rf"(?:{lands})\d\d(?: [A-Z0-9]{{4}}){{{n - 1}}}" for n, lands in FULL_GROUPS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:{FULL}|[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?))(?![A-Za-z0-9])"
#: What begins another value, so no group of an open phone number begins there.
OTHER = "|".join(
    (
        rf"(?<!\.)(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
        r"(?<![.-])\d{4}/\d{1,2}/\d{1,2}(?!\d)|(?<![.-])\d{1,2}/\d{1,2}/\d{4}(?!\d)",
        r"(?<![.-])(?:1[89]|20)\d\d-(?:1[0-2]|0?[1-9])-(?:3[01]|[12]\d|0?[1-9])(?![\d/-]|\.\d)",
        r"(?<![.-])(?:3[01]|[12]\d|0?[1-9])-(?:3[01]|[12]\d|0?[1-9])-(?:1[89]|20)\d\d(?![\d/-]|\.\d)",
        r"(?<![.-])(?:3[01]|[12]\d|0?[1-9])\.(?:1[0-2]|0?[1-9])\.(?:1[89]|20)\d\d(?![\d/-]|\.\d)",
        r"(?<!-)(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
        # of five groups of four, the first is still the phone's
        r"\d{13,19}(?!\d)|\d{4}(?: \d{4} \d{4} |-\d{4}-\d{4}-)\d{1,7}(?![ -]?\d{4}(?!\d)|\d)|\d{4}(?: \d{6} |-\d{6}-)\d{5}(?!\d)",
    )
)
#: Digits after the country code, where a country's numbers have all the same count, or at most one less.
NATIONAL = {
    8: "45|47|65|216|509|852|853|965|968|973|974",
    9: "27|31|33|34|41|48|51|56|61|84|212|213|251|254|255|256|351|380|420|421|593|966|994|998",
    10: "1|7|20|30|44|52|57|58|63|90|91|92|98",
    11: "86",
}
#: A phone number ends where its format is complete: at its country's count of digits, in groups of two
#: at least after the first, or after (AAA) EEE-NNNN. The form of any other country is open: it ends
#: before what begins another value.
DIGIT = r"(?:(?:\)[ .-]?|[ .-](?=\d\d))?\d)"
COMPLETE = "|".join([*(rf"\+(?:{codes})[ .-]?(?=\d|\(\d{{1,4}}\))\(?\d{DIGIT}{{{n - 1}}}" for n, codes in NATIONAL.items()), r"\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[.-]\d{4}"])
NATIVE = r"(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
GROUP = rf"(?:\d{{2,4}}|[ .-](?!{OTHER})\d{{2,4}})"
MORE = rf"(?:\d{{2,4}}|[ .-](?!{OTHER}|{NATIVE})\d{{2,4}})"
PHONE = rf"(?<![\d+])(?:(?:{COMPLETE})(?!\d)|\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}}){GROUP}{{2}}{MORE}{{0,2}}|{NATIVE})(?!\d)"
#: A number does not end within an address. Most places are ruled out by what a number begins with.
NUMBER = rf"(?=[0-9+(]|[A-Z]{{2}}\d)(?:{'|'.join((IBAN, IP, DATE, SSN, PHONE, CARD))})(?![A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++\.[A-Za-z0-9-])"
#: An address goes first.
FOUND = rf"{EMAIL}|{NUMBER}"
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
#: The country codes of one and two digits; all others have three.
CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def _hash(key: str, kind: str, i: Column, x: Column) -> Column:
    """60 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def permute_number(x: Column, low: int, high: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. low * high - 1, as a Feistel network over the two digits of mixed radix."""
    x = x.cast("long")
    begin = F.struct((x % F.lit(low)).alias("a"), F.floor(x / F.lit(low)).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        a = F.when(odd, (s["a"] + _hash(key, kind, i, s["b"])) % F.lit(low)).otherwise(s["a"])
        b = F.when(odd, s["b"]).otherwise((s["b"] + _hash(key, kind, i, s["a"])) % F.lit(high))
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: s["a"] + s["b"] * F.lit(low))


def permute_digits(x: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings as long as x (up to 36), as a Feistel network over its halves."""
    size = F.length(x)
    left = F.floor(size / 2).cast("int")
    number = lambda half: F.coalesce(half.cast("long"), F.lit(0).cast("long"))
    radix = lambda places: F.pow(F.lit(10), places).cast("long")
    begin = F.struct(number(F.substring(x, F.lit(1), left)).alias("a"), number(F.substring(x, left + 1, size)).alias("b"))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        by = _hash(key, kind, i, F.concat_ws("|", size.cast("string"), F.when(odd, s["b"]).otherwise(s["a"]).cast("string")))
        moved = (F.when(odd, s["a"]).otherwise(s["b"]) + by) % radix(F.when(odd, left).otherwise(size - left))
        return F.struct(F.when(odd, moved).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise(moved).alias("b"))

    spelt = lambda n, places: F.lpad(n.cast("string"), places, "0")
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: F.concat(spelt(s["a"], left), spelt(s["b"], size - left)))


def permute_text(x: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings that have x's pattern of digits, lower and upper case; other characters stay."""

    def shifted(half: Column, by: Column) -> Column:
        def one(j: Column) -> Column:
            c = F.substring(half, j, F.lit(1))
            k = F.conv(F.substring(by, ((j - 1) % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            move = lambda first, n: F.char(F.lit(first) + (code - first + k) % n)
            return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)

        return F.when(half == "", half).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), ""))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        other = F.when(odd, s["b"]).otherwise(s["a"])
        by = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.length(s["a"]).cast("string"), other), 512)
        moved = let(by, lambda k: shifted(F.when(odd, s["a"]).otherwise(s["b"]), k))
        return F.struct(F.when(odd, moved).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise(moved).alias("b"))

    middle = F.floor(F.length(x) / 2).cast("int")
    begin = F.struct(F.substring(x, F.lit(1), middle).alias("a"), F.substring(x, middle + 1, F.length(x)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: F.concat(s["a"], s["b"]))


def luhn_sum(digits: Column, shift: int) -> Column:
    """Sum of digits, every second doubled, counted from the right; shift 1: as if one more stood on the right."""

    def one(d: Column, j: Column) -> Column:
        twice = (j + shift) % 2 == 1
        n = d.cast("int") * F.when(twice, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(digits), ""), one)
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def mod97(letters: Column) -> Column:
    """Of the number that digits, and letters as 10 to 35, spell."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(letters, ""), F.lit(0), step)


#: What stands between the digits and letters of a value.
SEPARATORS = " .-()+"


def bare(x: Column) -> Column:
    return F.translate(x, SEPARATORS, "")


def laid_out(new: Column, x: Column) -> Column:
    """new, which has no separators, with those of x in their places."""

    def one(j: Column) -> Column:
        c = F.substring(x, j, F.lit(1))
        return F.when(bare(c) == "", c).otherwise(F.substring(new, F.length(bare(F.substring(x, F.lit(1), j))), F.lit(1)))

    return F.when(F.length(x) == F.length(new), new).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), one), ""))


def card(x: Column, key: str) -> Column:
    def rebuilt(digits: Column) -> Column:
        body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        checked = let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 1) % 10) % 10).cast("string")))
        return F.when(luhn_sum(digits, 0) % 10 == 0, let(checked, lambda n: laid_out(n, x)))

    return let(bare(x), rebuilt)


def iban(x: Column, key: str) -> Column:
    def rebuilt(plain: Column) -> Column:
        land, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        checked = let(permute_text(rest, key, "iban"), lambda r: F.concat(land, F.lpad((98 - mod97(F.concat(r, land, F.lit("00")))).cast("string"), 2, "0"), r))
        return F.when(mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1, let(checked, lambda n: laid_out(n, x)))

    return let(bare(x), rebuilt)


def ip(x: Column, key: str) -> Column:
    number = F.aggregate(F.split(x, r"\."), F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    octet = lambda n, place: (F.shiftright(n, place) % 256).cast("string")
    return let(permute_number(number, 65536, 65536, key, "ip"), lambda n: F.concat_ws(".", octet(n, 24), octet(n, 16), octet(n, 8), octet(n, 0)))


def ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substring(x, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    number = ((area - F.when(area > 666, 2).otherwise(1)).cast("long") * 99 + group - 1) * 9999 + serial - 1

    def spelt(n: Column) -> Column:
        place = F.floor(n / (99 * 9999)).cast("int")
        return F.format_string("%03d-%02d-%04d", place + F.when(place >= 665, 2).otherwise(1), (F.floor(n / 9999) % 99 + 1).cast("int"), (n % 9999 + 1).cast("int"))

    return F.when(valid, let(permute_number(number, 898 * 99, 9999, key, "ssn"), spelt))


def phone(x: Column, key: str) -> Column:
    def rebuilt(digits: Column) -> Column:
        code = F.when(F.startswith(x, F.lit("+")), F.regexp_extract(digits, CODE, 1)).otherwise("")
        return let(code, lambda c: let(F.concat(c, permute_digits(F.substring(digits, F.length(c) + 1, F.length(digits)), key, "phone")), lambda n: laid_out(n, x)))

    return let(bare(x), rebuilt)


def email(x: Column, key: str) -> Column:
    at = F.locate("@", x)
    return F.concat(permute_text(F.substring(x, F.lit(1), at - 1), key, "email"), F.substring(x, at, F.length(x)))


def date(x: Column, key: str) -> Column:
    """The parts are read by their separators, moved as a day, and written with as many digits at least. Each step is bound once, so the plan stays small."""

    def read(p: Column) -> Column:
        first, number = F.length(p[0]) == 4, lambda k: p[k].cast("int")
        day_first = F.contains(x, F.lit(".")) | (~first & (number(0) > 12))
        order = F.when(first, F.array(*map(F.lit, (0, 1, 2)))).when(day_first, F.array(*map(F.lit, (2, 1, 0)))).otherwise(F.array(*map(F.lit, (2, 0, 1))))
        return let(order, lambda o: F.struct(p.alias("part"), o.alias("order"), *(F.get(p, F.get(o, F.lit(k))).cast("int").alias(name) for k, name in enumerate("ymd"))))

    def checked(r: Column) -> Column:
        leap = ((r["y"] % 4 == 0) & (r["y"] % 100 != 0)) | (r["y"] % 400 == 0)
        longest = F.when(r["m"] == 2, F.when(leap, 29).otherwise(28)).when(r["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        valid = (r["y"] >= 1) & (r["m"] >= 1) & (r["m"] <= 12) & (r["d"] >= 1) & (r["d"] <= longest)
        return F.when(valid, let(F.struct(r["y"].between(1901, 2096).alias("windowed"), leap.alias("leap")), lambda c: placed(r, c)))

    def placed(r: Column, c: Column) -> Column:
        begin = F.make_date(F.when(c["windowed"], 1901 + F.floor((r["y"] - 1901) / 28).cast("int") * 28).otherwise(r["y"]), F.lit(1), F.lit(1))
        return let(begin, lambda b: let(F.datediff(F.make_date(r["y"], r["m"], r["d"]), b), lambda place: let(F.date_add(b, moved(place, c).cast("int")), lambda t: spelt(t, r))))

    def moved(place: Column, c: Column) -> Column:
        return F.when(c["windowed"], permute_number(place, 21, 487, key, "date")).when(c["leap"], permute_number(place, 6, 61, key, "date")).otherwise(permute_number(place, 5, 73, key, "date"))

    def spelt(t: Column, r: Column) -> Column:
        numbers = F.array(F.year(t), F.month(t), F.dayofmonth(t))
        # as many digits as the part had, four for a year
        size = lambda k: F.when(F.get(r["order"], F.lit(0)) == k, 4).when(F.length(r["part"][k]) == 2, 2).otherwise(1)
        said = lambda k: let(F.get(numbers, F.array_position(r["order"], k).cast("int") - 1).cast("string"), lambda n: F.lpad(n, F.greatest(F.length(n), size(k)), "0"))
        mark = F.regexp_extract(x, r"[-/.]", 0)
        return F.concat(said(0), mark, said(1), mark, said(2))

    return let(F.split(x, r"[-/.]"), lambda p: let(read(p), checked))


def kind_of(x: Column) -> Column:
    at = lambda p: x.rlike(_whole(p))
    return F.when(F.contains(x, F.lit("@")), "email").when(at(IBAN), "iban").when(at(IP), "ip").when(at(DATE), "date").when(at(SSN), "ssn").when(at(PHONE), "phone").otherwise("card")


def _replaced(text: Column, pseudonym: Callable[[Column, Column], Column]) -> Column:
    """struct(text, kinds): everything found through pseudonym(match, kind), which gives null to leave it."""

    def one(m: Column) -> Column:
        return let(kind_of(m), lambda k: let(pseudonym(m, k), lambda new: F.struct(F.coalesce(new, m).alias("new"), F.when(new.isNotNull(), k).alias("kind"))))

    # without an @ there is no address to look for
    mail = F.contains(text, F.lit("@"))

    def put(found: Column) -> Column:
        between = F.when(mail, F.split(text, FOUND, -1)).otherwise(F.split(text, NUMBER, -1))
        joined = F.array_join(F.zip_with(between, found, lambda s, f: F.concat(s, F.coalesce(f["new"], F.lit("")))), "")
        return F.struct(joined.alias("text"), F.filter(F.transform(found, lambda f: f["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    matches = F.when(mail, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))

    def replaced(m: Column) -> Column:
        return F.when(F.size(m) > 0, let(F.transform(m, one), put)).otherwise(F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds")))

    return let(matches, replaced)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """docs with the text replaced; found_col, if given, names a column with the kinds replaced, in order."""
    nothing = F.array().cast("array<string>")
    by_kind = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}

    def pseudonym(m: Column, k: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, f in by_kind.items():
            out = F.when(k == name, f(m, key)).otherwise(out)
        return out

    text = F.col(f"`{text_col}`")
    done = F.when(text.isNotNull(), let(text.cast("string"), lambda t: _replaced(t, pseudonym)))
    name = "__found"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, done)
    out = out.withColumn(text_col, F.col(name)["text"])
    if found_col:
        out = out.withColumn(found_col, F.coalesce(F.col(name)["kinds"], nothing))
    return out.drop(name)


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting `spark.scenaria.pii.key`; where that is unset, a random one for this session.

    Pseudonyms of different sessions are linked only if both were given one key.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key
