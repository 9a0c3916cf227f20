import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from scenaria.llm import pii

# -- the same in plain Python ----------------------------------------------------------

FOUND = re.compile(re.sub(r"\\k<(.)>", r"(?P=\1)", pii.FOUND.replace("(?<s>", "(?P<s>").replace("(?<t>", "(?P<t>")), re.A)
WHOLE = [(k, re.compile(re.sub(r"\\k<(.)>", r"(?P=\1)", p.replace("(?<s>", "(?P<s>").replace("(?<t>", "(?P<t>")), re.A)) for k, p in (("email", pii.EMAIL), ("iban", pii.IBAN), ("ip", pii.IP), ("date", pii.DATE), ("ssn", pii.SSN), ("phone", pii.PHONE), ("card", pii.CARD))]


def bits(key, kind, *more):
    return int(hashlib.sha256("|".join(map(str, (key, kind, *more))).encode()).hexdigest()[:15], 16)


def slow_number(x, low, high, key, kind):
    a, b = x % low, x // low
    for i in range(1, 9):
        if i % 2:
            a = (a + bits(key, kind, i, b)) % low
        else:
            b = (b + bits(key, kind, i, a)) % high
    return a + b * low


def slow_digits(x, key, kind):
    n, left = len(x), len(x) // 2
    a, b = int(x[:left] or 0), int(x[left:] or 0)
    for i in range(1, 9):
        if i % 2:
            a = (a + bits(key, kind, i, n, b)) % 10**left
        else:
            b = (b + bits(key, kind, i, n, a)) % 10 ** (n - left)
    return (str(a).zfill(left) if left else "") + str(b).zfill(n - left)


def slow_text(x, key, kind):
    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    alphabets = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    first = len(a)
    for i in range(1, 9):
        by = hashlib.sha512(f"{key}|{kind}|{i}|{first}|{b if i % 2 else a}".encode()).digest()
        out = ""
        for j, c in enumerate(a if i % 2 else b):
            own = next((z for z in alphabets if c in z), None)
            out += own[(own.index(c) + by[j % 64]) % len(own)] if own else c
        a, b = (out, b) if i % 2 else (a, out)
    return a + b


def relaid(new, x):
    rest = iter(new)
    return "".join(c if c in " .-()+" else next(rest) for c in x)


def day_of(x):
    parts, mark = re.split("[-/.]", x), re.search("[-/.]", x)[0]
    n = [int(p) for p in parts]
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    elif mark == "." or n[0] > 12:
        order = (2, 1, 0)
    else:
        order = (2, 0, 1)
    return datetime.date(n[order[0]], n[order[1]], n[order[2]]), order, parts, mark


def slow_pseudonym(x, kind, key):
    plain = "".join(c for c in x if c not in " .-()+")
    if kind == "email":
        local, _, domain = x.partition("@")
        return slow_text(local, key, "email") + "@" + domain
    if kind == "iban":
        if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
            return None
        rest = slow_text(plain[4:], key, "iban")
        return relaid(plain[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in rest + plain[:2] + '00')) % 97:02d}" + rest, x)
    if kind == "ip":
        n = slow_number(sum(int(o) << s for o, s in zip(x.split("."), (24, 16, 8, 0))), 65536, 65536, key, "ip")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "date":
        try:
            day, order, parts, mark = day_of(x)
        except ValueError:
            return None
        if 1901 <= day.year <= 2096:
            begin = datetime.date(1901 + (day.year - 1901) // 28 * 28, 1, 1)
            radix = 21, 487
        else:
            begin = datetime.date(day.year, 1, 1)
            leap = (datetime.date(day.year, 3, 1) - datetime.date(day.year, 2, 28)).days == 2
            radix = (6, 61) if leap else (5, 73)
        new = begin + datetime.timedelta(slow_number((day - begin).days, *radix, key, "date"))
        said = {order[0]: f"{new.year:04d}", order[1]: str(new.month).zfill(2 if len(parts[order[1]]) == 2 else 1), order[2]: str(new.day).zfill(2 if len(parts[order[2]]) == 2 else 1)}
        return mark.join(said[k] for k in range(3))
    if kind == "ssn":
        area, group, serial = (int(p) for p in x.split("-"))
        if not (area > 0 and area != 666 and area < 900 and group > 0 and serial > 0):
            return None
        n = slow_number(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
        place = n // (99 * 9999)
        return f"{place + (2 if place >= 665 else 1):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if kind == "phone":
        code = re.match(pii.CODE, plain)[0] if x[0] == "+" else ""
        return relaid(code + slow_digits(plain[len(code) :], key, "phone"), x)
    if not luhn(plain):
        return None
    body = slow_digits(plain[:-1], key, "card")
    return relaid(next(body + d for d in "0123456789" if luhn(body + d)), x)


def slow_pseudonymise(text, key):
    kinds = []

    def one(m):
        kind = next(k for k, p in WHOLE if p.fullmatch(m[0]))
        new = slow_pseudonym(m[0], kind, key)
        if new is not None:
            kinds.append(kind)
        return m[0] if new is None else new

    return (None, []) if text is None else (FOUND.sub(one, text), kinds)


def made_up(seed):
    """Values of all kinds, right and wrong ones, in several layouts."""
    draw = random.Random(seed)
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    card = d(15)
    card += next(x for x in "0123456789" if luhn(card + x))
    day = datetime.date(draw.randint(1890, 2110), 1, 1) + datetime.timedelta(draw.randint(0, 364))
    phone = d(10)
    return [
        f"{draw.choice(['a', 'Bo.Z', 'x_9+y', '1234567890123', '555-123-4567'])}{d(2)}@{draw.choice(['x.com', 'mail.example.org'])}",
        ".".join(str(draw.randint(0, 260)) for _ in range(4)),
        card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}", d(16),
        f"{day}", f"{day.year}/{day.month}/{day.day}", f"{day.month}/{day.day}/{day.year}", f"{day.month:02d}-{day.day:02d}-{day.year}", f"{day.day}.{day.month}.{day.year}", "2023-02-30",
        f"{d(3)}-{d(2)}-{d(4)}", f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}", f"+1{phone}", f"({phone[:3]}) {phone[3:6]}-{phone[6:]}", f"+44 20 {phone[:4]} {phone[4:8]}", f"+49 1512 {phone[:4]} {phone[4:8]}", f"+353 {phone[:2]} {phone[2:5]} {phone[5:9]}",
        "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "fe80::1", d(draw.randint(1, 20)), "ordinary words",
    ]


def test_frame_against_brute_force(spark):
    texts = [None, "", "é\u00a0ß"]
    for k in range(60):
        values = made_up(k)
        random.Random(k).shuffle(values)
        texts.append(random.Random(k).choice([" ", ", ", " / ", "\n", ": "]).join(values))
    texts += [texts[3], texts[3], "word " * 20_000 + texts[4]]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, found string, __found int")
    rows = pii.pseudonymise(docs, "k", found_col="found").collect()
    assert len(rows) == len(texts)
    seen = set()
    for r in rows:
        assert (r["text"], r["found"]) == slow_pseudonymise(texts[r["doc_id"]], "k"), texts[r["doc_id"]]
        seen |= set(r["found"])
    assert seen == set(pii.KINDS)


def test_a_value_is_linked_in_every_layout(spark):
    groups = [
        ["4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486"],
        ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
        ["+1 (826) 555-4081", "+1 826 555 4081", "+18265554081", "+1-826-555-4081"],
        ["+44 20 7946 0958", "+442079460958", "+44 (20) 7946-0958"],
        ["(826) 555-4081", "826-555-4081", "826 555 4081"],
        ["7/3/1985", "07/03/1985", "7-3-1985"],
    ]
    cases = [(g, x) for g, xs in enumerate(groups) for x in xs]
    docs = spark.createDataFrame([(k, f"see {x}, or") for k, (_, x) in enumerate(cases)], "doc_id bigint, text string")
    got = {}
    for r in pii.pseudonymise(docs, "k", found_col="found").collect():
        g, x = cases[r["doc_id"]]
        new = r["text"].removeprefix("see ").removesuffix(", or")
        assert len(r["found"]) == 1 and new != x
        if g < 5:
            assert re.sub("[0-9A-Z]", "x", new) == re.sub("[0-9A-Z]", "x", x)
        got.setdefault(g, set()).add(re.sub(r"[ ()-]", "", new) if g < 5 else "/".join(p.lstrip("0") for p in re.split("[-/]", new)))
    assert all(len(v) == 1 for v in got.values()), got


def test_addresses_like_numbers_stay_distinct(spark):
    n = 10_000
    docs = spark.range(n).select("id", F.concat(F.format_string("%013d", F.col("id") * 7 + 4539578763621), F.lit("@x.com")).alias("text"))
    out = pii.pseudonymise(docs, "k", found_col="found")
    assert out.agg(F.countDistinct("text")).first()[0] == n and out.filter("found = array('email')").count() == n
    phones = spark.range(n).select("id", F.format_string("555-%03d-4567@mail.com", F.col("id") % 1000).alias("text"))
    out = pii.pseudonymise(phones, "k", found_col="found")
    assert out.agg(F.countDistinct("text")).first()[0] == 1000 and out.filter("found = array('email')").count() == n


def test_key_of_the_session(spark):
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 64
    spark.conf.set(pii.KEY_SETTING, "own")
    assert pii.session_key(spark) == "own"
    spark.conf.unset(pii.KEY_SETTING)


# -- values in texts -------------------------------------------------------------------


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    texts = [
        "mail bo.42@mail8.example.com, ip 10.0.255.7. call +1 (988) 555-2485 4539578763621486 now",
        "again bo.42@mail8.example.com and 4539 5787 6362 1486 and 10.0.255.7",
        "bad card 4539578763621487, bad ip 300.1.1.1, bad date 2023-02-29, version 1.2.3, year 2024, 1234",
        "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 and GB83WEST12345698765432",
        "born 1985-07-03 or 7/3/1985 or 03.07.1985 or 31/12/1850, ssn 123-45-6789 not 000-12-3456",
        None,
        "",
        "ordinary words, no data; 3.14 and 1,000 and a-b@c",
        "ßü " * 30_000 + "x@y.org",
    ]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id bigint, text string, __found int")
    out = pii.pseudonymise(docs, "k", found_col="found")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "__found", "found"] and rows[0]["__found"] == 5
    assert [rows[k]["found"] for k in range(9)] == [["email", "ip", "phone", "card"], ["email", "card", "ip"], [], ["iban", "iban"], ["date"] * 4 + ["ssn"], [], [], [], ["email"]]
    for k in (2, 5, 6, 7):  # left alone
        assert rows[k]["text"] == texts[k]
    first = re.fullmatch(r"mail ([a-z]{2}\.\d\d)@mail8\.example\.com, ip ([\d.]+)\. call \+1 (\(\d{3}\) \d{3}-\d{4}) (\d{16}) now", rows[0]["text"])
    assert first and luhn(first[4]) and first[4] != "4539578763621486" and all(0 <= int(x) < 256 for x in first[2].split("."))
    second = re.fullmatch(r"again (\S+)@mail8\.example\.com and (\d{4} \d{4} \d{4} \d{4}) and (\S+)", rows[1]["text"])
    assert second[1] == first[1] and second[3] == first[2] and luhn(second[2].replace(" ", ""))
    for value in re.findall(r"[A-Z]{2}\d\d[A-Z ]*[\d ]+\d", rows[3]["text"])[:2]:
        plain = value.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain not in "".join(texts[3].split())
    assert rows[3]["text"].endswith("GB83WEST12345698765432")
    dates = re.fullmatch(r"born (\d{4}-\d\d-\d\d) or (\d+/\d+/\d{4}) or (\d\d\.\d\d\.\d{4}) or (\d\d/\d\d/1850), ssn (\d{3}-\d\d-\d{4}) not 000-12-3456", rows[4]["text"])
    day = datetime.date.fromisoformat(dates[1])
    assert 1985 <= day.year < 2013 and datetime.datetime.strptime(dates[2], "%m/%d/%Y").date() == day == datetime.datetime.strptime(dates[3], "%d.%m.%Y").date()
    assert pii.pseudonymise(docs, "other").filter("doc_id = 0").first()["text"] != rows[0]["text"]
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_a_phone_ends_where_it_is_complete(spark):
    phones = ["+1 (826) 555-4081", "+1 826 555 4081", "+18265554081", "+44 20 7946 0958", "+33 6 12 34 56 78", "+49 (826) 555-4081"]
    after = ["190.137.223.204", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "2024-01-05", "05.01.2024", "1/5/2024", "123-45-6789", "555-123-4567", *("12345678"[:k] for k in range(2, 9))]
    kinds = ["ip", "card", "card", "card", "date", "date", "date", "ssn", "phone", *[None] * 7]
    cases = [(p, a, k) for p in phones for a, k in zip(after, kinds)]
    open_form = "+49 1512 3456 789"  # of a country whose numbers differ in length
    cases += [(open_form, a, k) for a, k in zip(after, kinds) if k]
    docs = spark.createDataFrame([(k, f"call {p} {a} now") for k, (p, a, _) in enumerate(cases)] + [(-1 - k, f"call {p} now") for k, p in enumerate([*phones, open_form])], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k", found_col="found").collect()}
    alone = {p: rows[-1 - k]["text"].removesuffix(" now") for k, p in enumerate([*phones, open_form])}
    for k, (p, a, kind) in enumerate(cases):
        assert rows[k]["found"] == (["phone", kind] if kind else ["phone"]), (p, a)
        assert rows[k]["text"].startswith(alone[p] + " ") and alone[p] != f"call {p}", (p, a)
        left = rows[k]["text"].removeprefix(alone[p] + " ").removesuffix(" now")
        assert (left == a) == (kind is None), (p, a)
    shapes = ["+41 44-668 18 00", "+46 8 123 456 78", "+49 30 1234 5678", "+353 1 234 5678", "+86 10 6552 9988", "(826) 555-4081", "826-555-4081", "+7 (826) 555-40-81", "+33 1.23.45.67.89", "+39 06.12.34.56.78", "+49 1512 3456 7890"]
    whole = pii.pseudonymise(spark.createDataFrame([(k, f"at {p}, or") for k, p in enumerate(shapes)], "doc_id bigint, text string"), "k", found_col="found")
    for r in whole.collect():
        p = shapes[r["doc_id"]]
        assert r["found"] == ["phone"] and re.sub(r"\d", "9", r["text"]) == re.sub(r"\d", "9", f"at {p}, or"), p


def test_an_iban_ends_with_its_last_group(spark):
    def valid(land, rest):
        return f"{land}{98 - int(''.join(str(int(c, 36)) for c in rest + land + '00')) % 97:02d}{rest}"

    # one of each count of groups, and one whose last group is short
    plain = ["ES9121000418450200051332", valid("BE", "539007547034"), valid("AT", "1904300234573201"), valid("PL", "109010140000071219812874"), valid("LC", "HEMM000100010012001200023015"), "DE89370400440532013000"]
    spaced = [re.sub(r"(.{4})(?=.)", r"\1 ", x) for x in plain]
    after = ["BIC CAIXESBB", "12", "007", "CODE", "2024 ABCD", "EUR 500", "4539 5787 6362 1486"]
    cases = [(x, a) for x in spaced for a in after]
    docs = spark.createDataFrame([(k, f"to {x} {a} now") for k, (x, a) in enumerate(cases)] + [(-1 - k, f"to {x}, now") for k, x in enumerate(spaced)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k", found_col="found").collect()}
    alone = {x: rows[-1 - k]["text"].removesuffix(", now") for k, x in enumerate(spaced)}
    for k, (x, a) in enumerate(cases):
        card = a.startswith("4539")
        assert rows[k]["found"] == (["iban", "card"] if card else ["iban"]), (x, a)
        assert rows[k]["text"].startswith(alone[x] + " ") and x not in rows[k]["text"], (x, a)
        assert (rows[k]["text"] == f"{alone[x]} {a} now") != card, (x, a)


def test_permutations_are_one_to_one(spark):
    n = spark.range(10_227).select(pii.permute_number(F.col("id"), 21, 487, "k", "t").alias("x"))
    assert n.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first() == (10_227, 0, 10_226)
    digits = spark.range(10_000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("x"))
    assert digits.agg(F.countDistinct("x")).first()[0] == 10_000 and digits.filter(~F.col("x").rlike(r"^\d{4}$")).count() == 0
    odd = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x"))
    assert odd.agg(F.countDistinct("x"), F.min(F.length("x")), F.max(F.length("x"))).first() == (1000, 3, 3)
    t = spark.range(10_000).select(pii.permute_text(F.format_string("%02d-%02d", (F.col("id") / 100).cast("int"), F.col("id") % 100), "k", "t").alias("x"))
    assert t.agg(F.countDistinct("x")).first()[0] == 10_000 and t.filter(~F.col("x").rlike(r"^\d\d-\d\d$")).count() == 0
    days = spark.sql("select explode(sequence(date'1957-01-01', date'1984-12-31')) d").select(pii.date(F.date_format("d", "yyyy-MM-dd"), "k").alias("x"))
    assert days.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first() == (10_227, "1957-01-01", "1984-12-31")
