import calendar
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F
from tracewell.llm import pii, queries

from .cases import empty, frame, nasty_rows


KEY = "k"


def number(key, kind, step, other):
    return int(hashlib.sha256(f"{key}:{kind}:{step}:{other}".encode()).hexdigest()[:15], 16)


def feistel(key, kind, a, b, m, n):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = (a + number(key, kind, r, b) % m) % m
        else:
            b = (b + number(key, kind, r, a) % n) % n
    return a, b


def digits(key, kind, s):
    half = len(s) // 2
    a, b = feistel(key, f"{kind}10", int(s[:half] or 0), int(s[half:] or 0), 10**half, 10 ** (len(s) - half))
    return (str(a).zfill(half) if half else "") + str(b).zfill(len(s) - half)


def ten_digits(d, key=KEY):
    area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
    inside = area >= 200 and exchange >= 200
    side = 80_000 if inside else 60_000
    if inside:
        n = ((area - 200) * 800 + exchange - 200) * 10_000 + line
    else:
        n = (area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange) * 10_000 + line
    a, b = feistel(key, "phone+" if inside else "phone-", n // side, n % side, side, side)
    head, line = divmod(a * side + b, 10_000)
    if inside:
        return f"{200 + head // 800}{200 + head % 800}{line:04d}"
    return f"{head:06d}{line:04d}" if head < 200_000 else f"{200 + (head - 200_000) // 200}{(head - 200_000) % 200:03d}{line:04d}"


def new_date(text, key=KEY):
    """The form's dates in a list: those of every year by year, then those of leap years; walked until within the list."""
    sign = next(c for c in text if c in "-/.")
    p = text.split(sign)
    year_first = len(p[0]) == 4
    year, own = (int(p[0]), p[1:]) if year_first else (int(p[2]), p[:2])
    wide = tuple(map(len, own))

    def days(y):
        pairs = {(m, d) for m in range(1, 13) for d in range(1, calendar.monthrange(y, m)[1] + 1)}
        pairs |= set() if year_first else {(d, m) for m, d in pairs}
        return [f"{a:0{wide[0]}d}{sign}{b:0{wide[1]}d}" for a, b in sorted(pairs) if a < 10 ** wide[0] and b < 10 ** wide[1]]

    common = days(2001)
    every = [(y, x) for y in range(1900, 2100) for x in common]
    every += [(y, x) for y in range(1900, 2100) if calendar.isleap(y) for x in sorted(set(days(2004)) - set(common))]
    n, (a, b) = every.index((year, sign.join(own))), pii._halves(len(every))
    kind = f"date{4 * year_first + 2 * (wide[0] - 1) + wide[1] - 1}"
    while True:
        x, y = feistel(key, kind, n // b, n % b, a, b)
        n = x * b + y
        if n < len(every):
            y, x = every[n]
            return f"{y}{sign}{x}" if year_first else f"{x}{sign}{y}"


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def iban_of(account, country="DE"):
    check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
    return f"{country}{check:02d}{account}"


def swapped(spark, texts, key=KEY):
    rows = pii.pseudonymise(frame(spark, list(enumerate(texts))), key=key).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_values_against_plain_python(spark):
    card, iban = "4111 1111-1111 1111", iban_of("370400440532013000")
    texts = [f"pay {card} now", f"to {iban}.", "born 1999-12-31 or 31/12/1999, 12/31/1999; 31.12.1999!", "ssn 123-45-6789", "call +49 30 1234 5678 or (212) 555-1234 or 212-555-1234", "at 10.0.0.255, 1.2.3.4", "mail John.Doe-99@Example.com ok"]
    got = swapped(spark, texts)
    d = re.sub("[^0-9]", "", card)
    body = d[0] + digits(KEY, "card", d[1:-1])
    whole = body + next(str(c) for c in range(10) if luhn(body + str(c)))
    it = iter(whole)
    assert got[0] == "pay " + re.sub("[0-9]", lambda m: next(it), card) + " now"
    assert got[1] == "to " + iban_of(digits(KEY, "iban", iban[4:])) + "."
    assert got[2] == f"born {new_date('1999-12-31')} or {new_date('31/12/1999')}, {new_date('12/31/1999')}; {new_date('31.12.1999')}!"
    a, b = feistel(KEY, "ssn", 122, 44 * 9999 + 6788, 898, 99 * 9999)
    assert got[3] == f"ssn {a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    n1, n2 = digits(KEY, "phone", "3012345678"), ten_digits("2125551234")
    assert got[4] == f"call +49 {n1[:2]} {n1[2:6]} {n1[6:]} or ({n2[:3]}) {n2[3:6]}-{n2[6:]} or {n2[:3]}-{n2[3:6]}-{n2[6:]}"
    shown = []
    for ip in ("10.0.0.255", "1.2.3.4"):
        o = [*map(int, ip.split("."))]
        a, b = feistel(KEY, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        shown.append(f"{a // 256}.{a % 256}.{b // 256}.{b % 256}")
    assert got[5] == f"at {shown[0]}, {shown[1]}"
    local, domain = re.search(r"mail (\S+)@(\S+) ok", got[6]).groups()
    assert domain == "Example.com" and re.fullmatch(r"[a-z]{4}\.[a-z]{3}-[0-9]{2}", local) and local != "john.doe-99"


def test_permutations_are_bijections(spark):
    days = spark.range(319 * 229).select(pii.permute("k", "date", F.floor(F.col("id") / 229), F.col("id") % 229, F.lit(319), F.lit(229)).alias("s"))
    assert days.select("s.a", "s.b").distinct().where("a >= 0 AND a < 319 AND b >= 0 AND b < 229").count() == 319 * 229
    for base, n in ((10, 3), (26, 2), (10, 1), (26, 3)):
        size = base**n
        text = F.lpad(F.lower(F.conv(F.col("id").cast("string"), 10, base)), n, "0")
        out = spark.range(size).select(pii.permute_text("k", "t", text, base).alias("s"))
        assert out.where(F.length("s") == n).distinct().count() == size


def test_what_fails_its_check_stays(spark):
    texts = ["4111 1111 1111 1112", "DE00370400440532013000", "2023-02-30 and 99/99/1999", "000-12-3456 666-12-3456 900-12-3456", "300.1.2.3", "no @ here", "12345", ""]
    assert swapped(spark, texts) == texts


def test_links_and_keys(spark):
    texts = ["a 2001-02-03 b", "2001-02-03", "c 2001-02-04"]
    one, two = swapped(spark, texts, "k1"), swapped(spark, texts, "k2")
    assert one[0] == f"a {one[1]} b" and one[2] != f"c {one[1]}" and one != two


def test_validity_of_pseudonyms(spark):
    rows = [(k, f"{4000000000000000 + 7 * k} {iban_of(str(10**17 + k))} {100 + k % 500:03d}-{1 + k % 99:02d}-{1 + k:04d}") for k in range(300)]
    made = [x.asDict() for r in pii.pseudonymise(frame(spark, rows), key=KEY).collect() for x in r["found"]]
    assert {x["kind"] for x in made} == {"card", "iban", "ssn"}
    assert all(luhn(x["value"]) for x in made if x["kind"] == "card") and all(mod97(x["value"]) for x in made if x["kind"] == "iban")
    assert len({x["value"] for x in made if x["kind"] == "ssn"}) == 300


@pytest.mark.parametrize("clash", [False, True])
def test_nasty_rows_keep_their_texts(spark, clash):
    rows = nasty_rows()
    got = pii.pseudonymise(frame(spark, rows, clash), key=KEY).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(repr, rows))
    assert pii.pseudonymise(empty(spark), key=KEY).count() == 0


def test_no_python_in_the_plan(spark, sf_small):
    plan = queries.op2_pii(spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert queries.op2_pii(spark, sf_small).where("n_found > 0").count() > 0


def test_cards_beside_other_numbers(spark):
    card = "4111111111111111"
    alone = swapped(spark, [card])[0]
    texts = [f"5 {card}", f"{card} {card}", f"no-{card}-", f"12 {card} 7", f"{card}."]
    assert swapped(spark, texts) == [t.replace(card, alone) for t in texts] and alone != card


def test_ibans_in_groups_of_four(spark):
    flat = [iban_of("370400440532013000"), iban_of("NWBK60161331926819", "GB"), iban_of("21000418450200051332", "ES"), iban_of("86011117947", "NO")]
    parted = lambda x: " ".join(x[k : k + 4] for k in range(0, len(x), 4))
    groups = ["3704 0044 0532 0130 01", "4111 1111 1111 1111 00", "4111 1111 1111 1112 00"]
    got = swapped(spark, [*flat, *[f"to {parted(x)} 2024 PAID" for x in flat], *groups, *[f"DE12 {g}" for g in groups]])
    assert parted(flat[0]) == "DE89 3704 0044 0532 0130 00" and not set(got[:4]) & set(flat)
    assert got[4:8] == [f"to {parted(x)} 2024 PAID" for x in got[:4]]
    assert got[11:] == [f"DE12 {g}" for g in got[8:11]]


def test_other_dates_and_telephone_numbers(spark):
    texts = ["2021/03/12", "2021.03.12", "12-03-2021", "1/2/2021", "1.2.2021", "2021-2-1", "3/31/2021", "29/02/2000", "2/29/2000"]
    other = "31/2/2021 2021/13/1 2021/03-12 29/02/1900 32/01/1999 00/01/1999"
    phones = ["212 555 1234", "(212) 555 1234", "(017) 555 1234", "+1 212 155 1234"]
    n = [ten_digits(re.sub("[^0-9]", "", p)[-10:]) for p in phones]
    assert swapped(spark, [*texts, other, *phones]) == [
        *map(new_date, texts), other, f"{n[0][:3]} {n[0][3:6]} {n[0][6:]}", *[f"({x[:3]}) {x[3:6]} {x[6:]}" for x in n[1:3]], f"+1 {n[3][:3]} {n[3][3:6]} {n[3][6:]}",
    ]


def accepted(wide, year_first):
    """Every string of a form that is a date if read day first or month first, counted up by the calendar alone."""
    out = []
    for year in range(1900, 2100):
        for x in range(10 ** wide[0]):
            for y in range(10 ** wide[1]):
                if is_date(year, x, y) or (not year_first and is_date(year, y, x)):
                    both = f"{x:0{wide[0]}d}/{y:0{wide[1]}d}"
                    out.append(f"{year}/{both}" if year_first else f"{both}/{year}")
    return out


def is_date(year, month, day):
    return 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]


@pytest.mark.parametrize("year_first", [False, True])
@pytest.mark.parametrize("wide", [(1, 1), (1, 2), (2, 1), (2, 2)])
def test_dates_are_permuted_among_all_of_their_form(spark, wide, year_first):
    given = accepted(wide, year_first)
    assert len(given) == len(set(given))
    if wide == (2, 2) and not year_first:
        assert len(given) == 117_298
    table = spark.createDataFrame([(x,) for x in given], "s string").repartition(8)
    made = [r[0] for r in table.select(pii._date(KEY, F.col("s"))).collect()]
    assert set(made) == set(given)


def test_ten_digit_numbers_keep_to_their_plan(spark):
    """No two get the same pseudonym, and area and exchange begin with 2 to 9 just where they did."""
    given = [f"({a:03d}) {e:03d}-{x:04d}" for a in range(0, 1000, 37) for e in range(0, 1000, 23) for x in (0, 1, 9999)]
    made = [r[0] for r in spark.createDataFrame([(x,) for x in given], "s string").select(pii._phone(KEY, F.col("s"))).collect()]
    planned = lambda p: p[1] > "1" and p[6] > "1"
    assert len(set(made)) == len(given) and [planned(x) for x in made] == [planned(x) for x in given]
    assert all(re.fullmatch(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", x) for x in made)


def test_texts_that_are_long_or_made_to_be_slow(spark):
    texts = [
        "a@" + "b." * 5_000 + "com 12", "a@" + "b." * 20_000 + "com", "x" * 1_000_000, "x" * 1_000_000 + "@example.com", "a." * 500_000 + "@", "1 " * 500_000,
        "a@b." * 200_000, "1" * 1_000_000, "1-" * 400_000, "DE12 " * 200_000, "@" * 300_000, "+1 " * 200_000, "1.2." * 200_000,
    ]
    began = time.monotonic()
    got = swapped(spark, texts)
    assert [len(t) for t in got] == [len(t) for t in texts] and time.monotonic() - began < 60


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(empty(spark), key="")
    with pytest.raises(TypeError):
        pii.pseudonymise(empty(spark))


def test_query_over_the_whole_table_against_plain_python(spark, sf_mid):
    """Everything but what was found stays, and each value found is what plain Python makes of the one it replaces."""
    rows = {r[0]: r[1] for r in spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "text").collect()}
    key, seen = queries.PII_TEST_KEY, 0
    email = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}")
    for r in queries.op2_pii(spark, sf_mid).collect():
        old, new = rows[r["doc_id"]], r["text"]
        if not r["n_found"]:
            assert old == new
            continue
        seen += r["n_found"]
        assert len(old) == len(new) or "ip" in r["kinds"]
        for p in re.findall(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", old):
            d = ten_digits(re.sub("[^0-9]", "", p)[1:], key)
            assert f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}" in new
        for m in email.findall(old):
            assert m.lower() not in new.lower() and m.split("@")[1] in new
    assert seen > 20


def test_long_local_parts_are_permuted_to_their_end(spark):
    local = "".join(chr(97 + k % 26) for k in range(60)) + "0123456789" * 4
    got = swapped(spark, [f"{local}@example.com", f"{local[:26]}@example.com"])
    new = got[0].split("@")[0]
    assert len(new) == len(local) and new[26:52] != local[26:52] and new[52:60] != local[52:60] and new[90:] != local[90:]
    assert new[:26] == got[1].split("@")[0] and new[26:52] != new[:26]
