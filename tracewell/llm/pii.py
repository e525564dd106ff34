"""PII pseudonyms by format-preserving keyed permutations, in DataFrame operations only.

Found are e-mail addresses, IPv4 addresses, telephone numbers, payment card numbers (Luhn), IBANs (mod 97), US social
security numbers (area, group and serial rules) and calendar dates from 1900 to 2099. IBANs are found without spaces
and, for the countries of IBAN_LENGTHS, in groups of four with single spaces. Dates have day, month and year or year,
month and day, with one or two digits for day and month, between equal signs ``-``, ``/`` or ``.``. Telephone numbers
have a country code with ``+``, or ten digits in groups of 3, 3 and 4. Local parts of e-mail addresses have at most LOCAL
characters, domains at most 127 labels of 63; what is longer is no address. What fails its check stays as it is.

A value is permuted by an alternating Feistel network over a domain that is exactly its format's set of values, so
a pseudonym is valid in the same format, different values of a format get different pseudonyms, and equal values get
equal ones in every document, with no table of them. Each of ROUNDS rounds adds to one half, modulo its size, a number
from SHA-256 over key, kind, round and the other half. Where a set's size has no two halves, the network works on the next
larger product and is repeated until it comes back into the set (at most as often as the product has numbers beyond it).

    kind    kept                              permuted
    card    first digit, separators           the other digits; the last is the Luhn digit again
    iban    country, letters, spaces          digits of the account; check digits follow
    ssn     separators                        (area, group, serial) among the valid ones
    phone   country code, separators          the national number's digits; ten-digit numbers with no code or +1 whose
                                              area and exchange begin with 2 to 9 among those, others among the others
    ip      dots                              the 32 bits
    date    place of the year, separator,     day and month together with the year, among all strings of the form that
            digits of day and month           are a date if read day first or month first
    email   domain, punctuation               letters (lower-cased) and digits of the local part, each among its own,
                                              in blocks of 26 letters and 30 digits

Null texts stay null. Rows are handled each on its own, so repeats, ties and null ids need no rule; an empty table
gives an empty result. The key is a secret, and there is none by default.

Every pattern runs in time proportional to the text, and none calls itself for each repetition, so that no text is too
long for the stack.
"""

from __future__ import annotations

import calendar
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
LOCAL = 256
YEARS = range(1900, 2100)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _spaced_iban(length: int, countries: str) -> str:
    last = length % 4
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{length // 4 - 1}}}" + (f" [A-Z0-9]{{{last}}}" if last else "")


EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,{LOCAL}}}+@(?:[A-Za-z0-9-]{{1,63}}+\.){{1,127}}[A-Za-z]{{2,24}}"
PATTERNS = {
    "email": EMAIL,
    "iban": rf"\b(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{'|'.join(_spaced_iban(n, c) for n, c in IBAN_LENGTHS.items())})\b",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -][0-9]{1,7})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text that doesn't match this has nothing to find.
HINT = r"@|[0-9][0-9 .()/-]*[0-9]"


def _number(key: str, kind: str | Column, step: Column, other: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), step.cast("string"), other.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permute(key: str, kind: str | Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """A struct (a, b) from the pairs with a < size_a and b < size_b, which it permutes."""

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + F.pmod(_number(key, kind, r, s["b"]), size_a), size_a)).otherwise(s["a"]).cast("bigint").alias("a"),
            F.when(~even, F.pmod(s["b"] + F.pmod(_number(key, kind, r, s["a"]), size_b), size_b)).otherwise(s["b"]).cast("bigint").alias("b"),
        )

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_text(key: str, kind: str | Column, text: Column, base: int) -> Column:
    """A string of the digits 0.. of a base up to 26, of the same length; at most 30 decimal digits or 26 others."""

    def with_parts(p: Column) -> Column:
        half = F.floor(F.length(p) / 2).cast("int")
        rest = F.length(p) - half
        size = lambda n: F.pow(F.lit(float(base)), n).cast("bigint")
        number = lambda s: F.coalesce(F.conv(F.when(s != "", s).otherwise("0"), base, 10), F.lit("0")).cast("bigint")
        text_of = lambda x, n: F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), n, "0")
        mixed = permute(key, f"{kind}{base}" if isinstance(kind, str) else kind, number(F.substr(p, F.lit(1), half)), number(F.substr(p, half + 1, rest)), size(half), size(rest))
        return _let(mixed, lambda m: F.concat(F.when(half > 0, text_of(m["a"], half)).otherwise(""), text_of(m["b"], rest)))

    return F.when(text == "", "").otherwise(_let(text, with_parts))


def _permute_blocks(key: str, kind: str, text: Column, base: int, size: int) -> Column:
    """``permute_text`` of each ``size`` characters, every block after the first under a kind of its own."""
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")))

    def block(n: Column) -> Column:
        name = F.when(n == 0, F.lit(f"{kind}{base}")).otherwise(F.concat(F.lit(f"{kind}{base}."), n.cast("string")))
        return permute_text(key, name, F.substr(text, n * size + 1, F.lit(size)), base)

    return F.array_join(F.transform(numbers, block), "")


def _refill(shape: Column, wanted: str, new: Column) -> Column:
    """``shape`` with the characters that match ``wanted`` replaced by those of ``new`` in turn; those beyond it stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(wanted) & (s["k"] <= F.length(new))
        return F.struct(F.concat(s["out"], F.when(own, F.substr(new, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(own, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column, offset: int) -> Column:
    """Luhn sum; offset: 0 if the last digit is the check digit, 1 if that is to come."""
    reverse = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = lambda c, i: F.when((i + offset) % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(reverse, value), F.lit(0), lambda n, x: n + x)


def _mod97(account: Column) -> Column:
    def step(n: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (n * 10 + c.cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(account, ""), lambda c: c != ""), F.lit(0), step)


def _card(key: str, m: Column) -> Column:
    def use(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_text(key, "card", F.substr(d, F.lit(2), F.length(d) - 2), 10))
        whole = _let(body, lambda b: F.concat(b, F.pmod(10 - _luhn(b, 1) % 10, F.lit(10)).cast("string")))
        return F.when(_luhn(d, 0) % 10 == 0, _let(whole, lambda w: _refill(m, "[0-9]", w)))

    return _let(_digits(m), use)


def _iban(key: str, m: Column) -> Column:
    def whole(flat: Column) -> Column:
        country, account = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5), F.length(flat))
        new = _let(permute_text(key, "iban", F.substr(_digits(account), F.lit(1), F.lit(30)), 10), lambda d: _refill(account, "[0-9]", d))
        valid = _mod97(F.concat(account, F.substr(flat, F.lit(1), F.lit(4)))) == 1
        return F.when(valid, _let(new, lambda n: F.concat(country, F.lpad((98 - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n)))

    return _let(_let(F.translate(m, " ", ""), whole), lambda n: F.when(n.isNotNull(), _refill(m, "[A-Z0-9]", n)))


def _ssn(key: str, m: Column) -> Column:
    part = lambda a, n: F.substr(m, F.lit(a), F.lit(n)).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    mixed = permute(key, "ssn", area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))

    def shown(s: Column) -> Column:
        area = s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", area, F.floor(s["b"] / 9999) + 1, s["b"] % 9999 + 1)

    return F.when(valid, _let(mixed, shown))


def _phone(key: str, m: Column) -> Column:
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3})(?=[ .(-])", 1)
    code = F.when(code == "", F.regexp_extract(m, r"^(\+[0-9]{2})", 1)).otherwise(code)

    def ten(d: Column) -> Column:
        """Ten digits: area, exchange, line. The numbers of a plan are 800 x 800 x 10,000; the others are those whose area
        begins with 0 or 1, then those whose exchange does."""
        part = lambda a, n: F.substr(d, F.lit(a), F.lit(n)).cast("bigint")
        area, exchange, line = part(1, 3), part(4, 3), part(7, 4)
        planned = (area >= 200) & (exchange >= 200)
        low = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange) * 10_000 + line
        number = F.when(planned, ((area - 200) * 800 + exchange - 200) * 10_000 + line).otherwise(low)
        side = F.when(planned, 80_000).otherwise(60_000).cast("bigint")
        mixed = permute(key, F.when(planned, "phone+").otherwise("phone-"), F.floor(number / side), number % side, side, side)

        def shown(n: Column) -> Column:
            head = F.floor(n / 10_000)
            other = F.when(head < 200_000, head).otherwise((200 + F.floor((head - 200_000) / 200)) * 1000 + (head - 200_000) % 200)
            return F.format_string("%06d%04d", F.when(planned, (200 + F.floor(head / 800)) * 1000 + 200 + head % 800).otherwise(other), n % 10_000)

        return _let(mixed, lambda s: _let(s["a"] * side + s["b"], shown))

    def use(c: Column) -> Column:
        rest = F.substr(m, F.length(c) + 1, F.length(m))
        new = _let(_digits(rest), lambda d: F.when(c.isin("", "+1") & (F.length(d) == 10), ten(d)).otherwise(permute_text(key, "phone", d, 10)))
        return F.concat(c, _let(new, lambda d: _refill(rest, "[0-9]", d)))

    return _let(code, use)


def _ip(key: str, m: Column) -> Column:
    def use(o: Column) -> Column:
        n = lambda k: o[k].cast("int")
        mixed = permute(key, "ip", n(0) * 256 + n(1), n(2) * 256 + n(3), F.lit(65536), F.lit(65536))
        byte = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
        return _let(mixed, lambda s: F.concat_ws(".", *byte(s["a"]), *byte(s["b"])))

    return _let(F.split(m, r"\."), use)


def _halves(total: int) -> tuple[int, int]:
    """Two sizes near the root whose product is the least that isn't below ``total``."""
    root = math.isqrt(total)
    return min(((a, -(-total // a)) for a in range(max(1, root // 2), root + 1)), key=lambda x: (x[0] * x[1], -x[0]))


def _date_forms() -> list[tuple[list[str], list[str], int, int, int]]:
    """By place of the year (last, first), digits of the first and of the second of the two other numbers: the strings of
    both that are dates in every year, those of leap years alone, how many dates there are, and the sizes of halves."""
    out = []
    leap_years = sum(map(calendar.isleap, YEARS))
    for year_first in (False, True):
        for wide in ((1, 1), (1, 2), (2, 1), (2, 2)):
            found: list[list[str]] = []
            for year in (2001, 2004):
                orders = [(m, d) for m in range(1, 13) for d in range(1, calendar.monthrange(year, m)[1] + 1)]
                pairs = sorted({*orders, *(() if year_first else ((d, m) for m, d in orders))})
                found.append([f"{x:0{wide[0]}d}-{y:0{wide[1]}d}" for x, y in pairs if x < 10 ** wide[0] and y < 10 ** wide[1]])
            common = found[0]
            extra = sorted(set(found[1]) - set(common))
            total = len(YEARS) * len(common) + leap_years * len(extra)
            out.append((common, extra, total, *_halves(total)))
    return out


DATE_FORMS = _date_forms()
_BEYOND = max(a * b - total for _, _, total, a, b in DATE_FORMS)


def _date(key: str, m: Column) -> Column:
    """Dates of a form are numbered: those that every year has by year, then those of leap years."""
    first, leap = YEARS[0], next(y for y in YEARS if calendar.isleap(y))

    def of_form(form: Column, values: list) -> Column:
        picked = None
        for k, v in enumerate(values):
            picked = F.when(form == k, v) if picked is None else picked.when(form == k, v)
        return picked

    def with_form(p: Column) -> Column:
        form, year, written = p["form"], p["year"], p["written"]
        column = lambda k: of_form(form, [F.lit(f[k]).cast("bigint") for f in DATE_FORMS])
        listed = lambda k: of_form(form, [F.split(F.lit(",".join(f[k])), ",") for f in DATE_FORMS])
        many = of_form(form, [F.lit(len(f[0])).cast("bigint") for f in DATE_FORMS])
        extra = of_form(form, [F.lit(len(f[1])).cast("bigint") for f in DATE_FORMS])
        total, size_a, size_b = column(2), column(3), column(4)
        at, late = F.array_position(listed(0), written), F.array_position(listed(1), written)
        is_leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        number = F.when(at > 0, (year - first) * many + at - 1).when((late > 0) & is_leap, len(YEARS) * many + F.floor((year - leap) / 4) * extra + late - 1)

        def step(s: Column, _: Column) -> Column:
            mixed = permute(key, F.concat(F.lit("date"), form.cast("string")), F.floor(s / size_b), s % size_b, size_a, size_b)
            # A number beyond the total has to go on; one below it, but for the first, has arrived and is kept as -1 - n.
            return F.when(s < 0, s).otherwise(_let(_let(mixed, lambda x: x["a"] * size_b + x["b"]), lambda n: F.when(n < total, -1 - n).otherwise(n)))

        def shown(n: Column) -> Column:
            usual = n < len(YEARS) * many
            rest = n - len(YEARS) * many
            new_year = F.when(usual, first + F.floor(n / many)).otherwise(leap + 4 * F.floor(rest / extra)).cast("string")
            day = F.when(usual, F.get(listed(0), (n % many).cast("int"))).otherwise(F.get(listed(1), (rest % extra).cast("int")))
            both = F.replace(day, F.lit("-"), p["sign"])
            return F.when(form >= 4, F.concat(new_year, p["sign"], both)).otherwise(F.concat(both, p["sign"], new_year))

        def walk(n: Column) -> Column:
            return F.when(n.isNotNull(), _let(-1 - F.aggregate(F.sequence(F.lit(0), F.lit(_BEYOND)), n.cast("bigint"), step), shown))

        return _let(number, walk)

    def with_parts(p: Column) -> Column:
        year_first = F.length(p[0]) == 4
        a, b, year = F.when(year_first, p[1]).otherwise(p[0]), F.when(year_first, p[2]).otherwise(p[1]), F.when(year_first, p[0]).otherwise(p[2])
        form = F.when(year_first, 4).otherwise(0) + 2 * (F.length(a) - 1) + F.length(b) - 1
        sign = F.regexp_extract(m, "[-/.]", 0)
        return _let(F.struct(form.alias("form"), year.cast("bigint").alias("year"), F.concat_ws("-", a, b).alias("written"), sign.alias("sign")), with_form)

    return _let(F.split(m, "[-/.]"), with_parts)


def _email(key: str, m: Column) -> Column:
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"

    def use(local: Column) -> Column:
        domain = F.substring_index(m, "@", -1)
        words = F.translate(F.regexp_replace(local, "[^a-z]", ""), letters, digits)
        new = _let(F.translate(_let(words, lambda w: _permute_blocks(key, "email", w, 26, 26)), digits, letters), lambda w: _refill(local, "[a-z]", w))
        numbers = _let(_digits(local), lambda d: _permute_blocks(key, "email", d, 10, 30))
        return F.concat(_let(new, lambda x: _let(numbers, lambda d: _refill(x, "[0-9]", d))), F.lit("@"), domain)

    return _let(F.lower(F.substring_index(m, "@", 1)), use)


def pseudonym(key: str, m: Column) -> Column:
    """struct(kind, value) for a match; value is null if it fails its check."""
    is_kind = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    makers = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    kind = None
    for k in makers:
        kind = F.when(is_kind(k), k) if kind is None else kind.when(is_kind(k), k)

    def use(k: Column) -> Column:
        value = None
        for name, make in makers.items():
            value = F.when(k == name, make(key, m)) if value is None else value.when(k == name, make(key, m))
        return F.struct(k.alias("kind"), value.alias("value"))

    def card_within(p: Column) -> Column:
        """In groups that only look like an IBAN's a card is found as it is elsewhere."""
        groups = F.regexp_extract(m, rf"^[A-Z]{{2}}[0-9]{{2}} .*?({PATTERNS['card']})", 1)
        found = _let(groups, lambda g: _let(_card(key, g), lambda c: F.struct(F.lit("card").alias("kind"), F.replace(m, g, c).alias("value"))))
        return F.when((p["kind"] == "iban") & p["value"].isNull() & (groups != ""), found).otherwise(p)

    return _let(_let(kind, use), card_within)


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: str, keep: list[str] | None = None) -> DataFrame:
    """Per row: id (or the columns ``keep``), text with pseudonyms, and ``found``: array of (kind, value) put in."""
    if not key:
        raise ValueError("a key is needed")
    text = F.col(f"`{text_col}`").cast("string")
    kept = [id_col] if keep is None else keep
    base = docs.select(*[F.col(f"`{k}`").alias(f"_keep{n}") for n, k in enumerate(kept)], text.alias("_text"))
    likely = F.col("_text").rlike(HINT)
    matched = base.withColumn("_matches", F.when(likely, F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    made = matched.withColumn("_made", F.transform("_matches", lambda m: pseudonym(key, m)))
    between = F.split("_text", ANY, -1)
    filled = F.zip_with("_matches", "_made", lambda m, p: F.coalesce(p["value"], m))
    joined = F.array_join(F.zip_with(between, filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return made.select(
        *[F.col(f"_keep{n}").alias(k) for n, k in enumerate(kept) if k != text_col],
        F.when(F.size("_matches") > 0, joined).otherwise(F.col("_text")).alias(text_col),
        F.filter("_made", lambda p: p["value"].isNotNull()).alias("found"),
    )
