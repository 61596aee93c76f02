r"""PII pseudonyms by format-preserving Feistel permutations, in DataFrame functions alone.

One pattern finds e-mail addresses, card numbers, phone numbers, social security numbers, IPv4 addresses, dates and
access key ids. A match is validated (check digit, number ranges, calendar) and replaced by its image under a keyed
Feistel permutation of its own format: a card stays a card with a right check digit, a date a date of the calendar, a
phone number a dialable one, an address an address. The permutation depends on the key and the value's normal form
alone, so equal values stay linked across documents, and whoever has the key can undo it. Round values are HMAC-SHA256
under the key. What fails validation stays, as does what has no pattern here: bank account numbers, IPv6 addresses,
phone numbers outside the ten-digit plan, names and street addresses.

A slash date is read month first where that is a date, else day first; its image is read the same way, so one value has one
pseudonym in every form and no two values share one. E-mail addresses are equal whatever their letter case and come out in
lower case. A permutation can leave a value as it is: about one value does in each domain, so one in 36 one-letter names.

Defined results: null text stays null with no match; a text of any length is searched whole; bytes that are not UTF-8
become U+FFFD in a text with a match and stay in one without; repeated rows give equal results; an empty table gives no
row; other columns are kept out of the result. The default key is for tests: production passes its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns by kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "date": r"(?<![0-9.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9\-/])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8


def _chain(start: Column, steps) -> Column:
    """Run steps one after another as array elements, so that each half is computed once and not copied into an ever larger expression."""
    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, steps)


def keyed_hash(key: str, message: Column) -> Column:
    """HMAC-SHA256 of a string, in lower-case hex."""
    k = hashlib.sha256(key.encode()).digest() if len(key.encode()) > 64 else key.encode()
    pad = lambda with_: F.lit(bytes(x ^ with_ for x in k.ljust(64, b"\0")))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def permute(key: str, kind: str, a: Column, b: Column, size_a, size_b) -> Column:
    """Image of (a, b) in [0, size_a) x [0, size_b) as struct<a, b>: halves take turns adding a keyed hash of the other, so each round can be undone."""
    size_a, size_b = F.lit(size_a).cast("long") if isinstance(size_a, int) else size_a, F.lit(size_b).cast("long") if isinstance(size_b, int) else size_b

    def step(s, k):
        def mix(half, size):
            seed = F.concat(F.lit(f"{kind}|"), k.cast("string"), F.lit("|"), half.cast("string"))
            return F.pmod(F.conv(F.substring(keyed_hash(key, seed), 1, 15), 16, 10).cast("long"), size)

        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + mix(s["b"], size_a), size_a)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + mix(s["a"], size_b), size_b)).alias("b"),
        )

    return _chain(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0") if isinstance(n, int) else F.lpad(x.cast("string"), n, F.lit("0"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """Image of a string of 2 to 36 digits among the strings of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = (F.length(digits) - half).cast("int")
    power = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")
    image = permute(key, kind, F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1, rest).cast("long"), power(half), power(rest))
    return _let(image, lambda s: F.concat(_pad(s["a"], half), _pad(s["b"], rest)))


def permute_letters(key: str, kind: str, chars: Column, alphabet: int = 36) -> Column:
    """Image of a string of 2 to 24 lower-case letters and digits among those of its length."""
    half = F.floor(F.length(chars) / 2).cast("int")
    rest = (F.length(chars) - half).cast("int")
    power = lambda n: F.floor(F.pow(F.lit(float(alphabet)), n) + 0.5).cast("long")  # noqa: E731  exact below 2^53; 36^10 is
    number = lambda c: F.conv(c, alphabet, 10).cast("long")
    image = permute(key, kind, number(F.substr(chars, F.lit(1), half)), number(F.substr(chars, half + 1, rest)), power(half), power(rest))
    return _let(image, lambda s: F.concat(*(F.lpad(F.lower(F.conv(x.cast("string"), 10, alphabet)), n, F.lit("0")) for x, n in ((s["a"], half), (s["b"], rest)))))


def refill(form: Column, chars: Column, kind: str) -> Column:
    """form with its characters of the class `kind` (a regex class) replaced in order by those of chars."""
    at = lambda i: F.length(F.regexp_replace(F.substr(form, F.lit(1), i), f"[^{kind}]", ""))
    each = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: _let(F.substr(form, i, F.lit(1)), lambda c: F.when(c.rlike(f"^[{kind}]$"), F.substr(chars, at(i), F.lit(1))).otherwise(c)))
    return F.array_join(each, "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted once."""
    n = F.length(digits)

    def value(i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, x: s + x)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(key, m):
    def image(d):
        body = permute_digits(key, "card", F.substr(d, F.lit(1), (F.length(d) - 1).cast("int")))
        check = lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))
        good = F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
        return F.when(good, refill(m, _let(body, check), "0-9")).otherwise(m)

    return _let(_digits(m), image)


def _phone(key, m):
    def image(d):
        n = F.substring(d, -10, 10)
        area, rest = F.substring(n, 1, 3).cast("long") - 200, (F.substring(n, 4, 3).cast("long") - 200) * 10000 + F.substring(n, 7, 4).cast("long")
        good = (F.substring(n, 1, 1) >= "2") & (F.substring(n, 4, 1) >= "2")
        new = _let(permute(key, "phone", area, rest, 800, 8_000_000), lambda s: F.concat(F.substr(d, F.lit(1), (F.length(d) - 10).cast("int")), (s["a"] + 200).cast("string"), _pad(s["b"] + 2_000_000, 7)))
        return F.when(good, refill(m, new, "0-9")).otherwise(m)

    return _let(_digits(m), image)


def _ssn(key, m):
    area, rest = F.substring(m, 1, 3).cast("long"), (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1
    good = area.between(1, 899) & (area != 666) & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    new = _let(permute(key, "ssn", rank, rest, 898, 99 * 9999), lambda s: F.concat_ws("-", _pad(F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1), 3), _pad(F.floor(s["b"] / 9999) + 1, 2), _pad(s["b"] % 9999 + 1, 4)))
    return F.when(good, new).otherwise(m)


def _ip(key, m):
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))

    def image(o):
        g = lambda k: F.element_at(o, k)
        good = F.forall(o, lambda x: x < 256)
        new = _let(permute(key, "ip", g(1) * 256 + g(2), g(3) * 256 + g(4), 65536, 65536), lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))))
        return F.when(good, new).otherwise(m)

    return _let(octets, image)


#: The Gregorian cycle of 400 years that is permuted, from its first year on: days up to the 12th and days from the 13th on, each as a product.
CYCLE_START = 1800
EARLY_A, EARLY_B = 240, 240
LATE_A, LATE_B = 9, 9833


def _early(year, month, day) -> Column:
    """Number of a day up to the 12th among those since the cycle's start."""
    return ((year - CYCLE_START) * 12 + month - 1) * 12 + day - 1


def _late_before(year, month) -> Column:
    """Days from the 13th on between the cycle's start and a month's first."""
    whole = F.datediff(F.make_date(year, month, F.lit(1)), F.lit(f"{CYCLE_START}-01-01").cast("date"))
    return (whole - 12 * ((year - CYCLE_START) * 12 + month - 1)).cast("long")


def _late_date(rank: Column, base: Column) -> Column:
    """Date of a rank among the days from the 13th on of one cycle that starts `base` years after CYCLE_START."""
    at = lambda y: _late_before(y, F.lit(1))

    def of_year(y):
        left = rank - at(y)
        month = F.size(F.filter(F.sequence(F.lit(1), F.lit(12)), lambda k: _late_before(y, k) - at(y) <= left))
        return _let(month, lambda k: F.make_date((y + base).cast("int"), k, (rank - _late_before(y, k) + 13).cast("int")))

    guess = (CYCLE_START + F.floor(rank * 400 / (LATE_A * LATE_B))).cast("int")
    year = _let(guess, lambda y: (y - 1 + (at(y) <= rank).cast("int") + (at(y + 1) <= rank).cast("int")).cast("int"))
    return _let(year, of_year)


def _date(key, m):
    """Days up to the 12th stay so, and later days too: a slash date that can be read both ways keeps being one, so no two of any form get one pseudonym."""
    iso, us = m.rlike("^[0-9]{4}-"), m.contains("/")
    month_first = F.try_to_date(m, "MM/dd/yyyy").isNotNull()
    day = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "MM/dd/yyyy"), F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "dd.MM.yyyy"))

    def image(d):
        cycle = F.floor((F.year(d) - CYCLE_START) / 400)
        base = cycle * 400
        early = (_early(F.year(d), F.month(d), F.dayofmonth(d)) - base * 144).cast("long")
        late = (_late_before((F.year(d) - base).cast("int"), F.month(d)) + F.dayofmonth(d) - 13).cast("long")
        low = lambda s: _let(s["a"] * EARLY_B + s["b"], lambda v: F.make_date((CYCLE_START + base + F.floor(v / 144)).cast("int"), (F.floor(v / 12) % 12 + 1).cast("int"), (v % 12 + 1).cast("int")))
        high = lambda s: _let((s["a"] * LATE_B + s["b"]).cast("long"), lambda v: _late_date(v, base))
        new = F.when(F.dayofmonth(d) <= 12, _let(permute(key, "date", F.floor(early / EARLY_B), early % EARLY_B, EARLY_A, EARLY_B), low)).otherwise(_let(permute(key, "late date", F.floor(late / LATE_B), late % LATE_B, LATE_A, LATE_B), high))
        form = _let(new, lambda v: F.when(iso, F.date_format(v, "yyyy-MM-dd")).when(us & month_first, F.date_format(v, "MM/dd/yyyy")).when(us, F.date_format(v, "dd/MM/yyyy")).otherwise(F.date_format(v, "dd.MM.yyyy")))
        return F.when(d.isNotNull() & (cycle >= -4) & (cycle <= 19), form).otherwise(m)

    return _let(day, image)


def _email(key, m):
    """The part before the @, letters and digits in runs of at most 20; one character alone is permuted as a number of six by six."""
    local, domain = F.lower(F.substring_index(m, "@", 1)), F.lower(F.substring_index(m, "@", -1))

    def image(chars):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.length(chars) - 1) / 20).cast("int")), lambda k: F.substr(chars, k * 20 + 1, F.lit(20)))
        one = lambda r: _let(F.conv(r, 36, 10).cast("long"), lambda v: _let(permute(key, "email1", F.floor(v / 6), v % 6, 6, 6), lambda s: F.lower(F.conv((s["a"] * 6 + s["b"]).cast("string"), 10, 36))))
        new = F.array_join(F.transform(runs, lambda r: F.when(F.length(r) > 1, permute_letters(key, "email", r)).otherwise(one(r))), "")
        return F.when(F.length(chars) > 0, F.concat(refill(local, new, "a-z0-9"), F.lit("@"), domain)).otherwise(m)

    return _let(F.regexp_replace(local, "[^a-z0-9]", ""), image)


def _access_key(key, m):
    return F.concat(F.lit("AKIA"), F.upper(permute_letters(key, "key", F.lower(F.substring(m, 5, 16)))))


def pseudonym(match: Column, key: str) -> Column:
    """Image of one match."""
    out = F.when(match.contains("@"), _email(key, match)).when(match.startswith("AKIA"), _access_key(key, match))
    for kind, f in (("date", _date), ("ssn", _ssn), ("ip", _ip), ("phone", _phone), ("card", _card)):
        out = out.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), f(key, match))
    return out.otherwise(match)


def pseudonymise(docs: DataFrame, key: str = "test-key", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_replaced."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    found = picked.withColumn("_found", F.regexp_extract_all("_text", F.lit(ANY), 0))
    images = found.withColumn("_new", F.when(F.size("_found") > 0, F.transform("_found", lambda m: pseudonym(m, key))).otherwise(F.array().cast("array<string>")))
    gaps = F.split("_text", ANY, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_new"), i), F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x))
    return images.select("doc_id", F.when(F.size("_found") > 0, joined).otherwise(F.col("_text")).alias("text"), F.greatest(changed, F.lit(0)).cast("long").alias("n_replaced"))


def op10_pii(spark, sf_dir):
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
