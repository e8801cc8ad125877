import datetime
import hashlib
import random
import re

import pytest
import regex

from rillframe.llm import pii
from rillframe.llm.pii import pseudonymise


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def card(rng, prefix="4", n=16):
    body = prefix + "".join(rng.choice("0123456789") for _ in range(n - len(prefix) - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, found string").repartition(3)
    return [(r.text, r.n_found, r.kinds) for r in pseudonymise(df, key).orderBy("doc_id").collect()]


FORMS = {
    "card": [r"4\d{15}", r"5[1-5]\d{14}", r"3[47]\d{13}", r"(?:\d{4} ){3}\d{4}", r"(?:\d{4}-){3}\d{4}", r"\d{4} \d{6} \d{5}"],
    "phone": [r"\+1 \(\d{3}\) \d{3}-\d{4}"],
    "mail": [r"[a-z]+\.\d\d@mail\d\.example\.com"],
}


def test_pseudonyms_keep_form_and_validity_and_are_one_to_one(spark):
    rng = random.Random(3)
    cards = [card(rng) for _ in range(200)] + [card(rng, "51"), card(rng, "2221"), card(rng, "34", 15), card(rng, "6011")]
    spaced = [" ".join(c[i:i + 4] for i in range(0, 16, 4)) for c in cards[:20]]
    phones = [f"+1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10000):04d}" for _ in range(200)]
    mails = [f"{rng.choice('abcdefgh')}{rng.choice(['der', 'x', ''])}.{rng.randrange(100):02d}@mail{rng.randrange(9)}.example.com" for _ in range(100)]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(200)]
    dates = [(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(80_000))).isoformat() for _ in range(200)]
    turned = [f"{d[8:]}/{d[5:7]}/{d[:4]}" for d in dates[:60]] + ["12/31/1999", "31.12.1999"]
    ssns = ["123-45-6789", "665-01-0001", "667-99-9999", "899-10-0100"]
    every = {"card": cards + spaced, "phone": phones, "mail": mails, "ip": ips, "date": dates + turned, "ssn": ssns}
    for kind, values in every.items():
        values = list(dict.fromkeys(values))
        got = run(spark, values)
        assert all(n == 1 and k[0].startswith(kind) for _, n, k in got), (kind, [v for v, g in zip(values, got) if g[1] != 1][:3])
        new = [t for t, *_ in got]
        assert sum(a == b for a, b in zip(values, new)) <= len(values) // 20
        shape = lambda s: re.sub(r"[A-Za-z]", "a", re.sub(r"\d+" if kind == "ip" else r"\d", "0", s))
        assert [shape(a) for a in values] == [shape(b) for b in new]
        again = run(spark, new)
        assert all(n == 1 for _, n, _ in again), "a pseudonym validates like its original"
        plain = lambda s: s.replace(" ", "") if kind == "card" else s
        assert len({plain(t) for t in new}) == len({plain(v) for v in values})
        if kind == "card":
            assert all(luhn(re.sub(r"\D", "", t)) and t[:4] == v[:4] for v, t in zip(values, new))
            assert [t.replace(" ", "") for t in new[-20:]] == new[:20], "linked across ways of writing"
        assert run(spark, values[:5], "other key") != got[:5]


def test_texts_around_stay_and_invalid_values_stay(spark):
    rng = random.Random(1)
    c = card(rng)
    bad = c[:-1] + str((int(c[-1]) + 1) % 10)
    texts = [f"a {c}, b {c}$$$ und.34@mail7.example.com! +1 (017) 555-7713 é", bad, "9807915762804490", "1.2.3.999", "2021-02-30", "000-12-3456",
             "token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\"", "v1.2.3.4.5", "12345678901234567890123", "", None, "no @ here + 1", "x" * 200_000 + " " + c + " " + "1." * 50_000,
             "7536784127813050 " + c]
    got = run(spark, texts)
    assert got[0][1:] == (4, ["card", "card", "mail", "phone"]) and got[0][0].startswith("a ") and got[0][0].endswith(" é")
    first, second = re.findall(r"\d{16}", got[0][0])
    assert first == second != c and luhn(first)
    for i in [*range(1, 10), 11]:
        assert got[i] == (texts[i], 0, []), texts[i]
    assert got[10] == (None, 0, [])
    assert got[12][1] == 1 and got[12][0][200_001:200_017] == first
    assert got[13] == ("7536784127813050 " + first, 1, ["card"])
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = pseudonymise(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


@pytest.mark.parametrize("day", ["1800-01-01", "2199-12-31", "2000-02-29"])
def test_edge_dates_stay_dates(spark, day):
    ((text, n, kinds),) = run(spark, [day])
    assert n == 1 and kinds == ["datey"] and 1800 <= datetime.date.fromisoformat(text).year <= 2199


# --- a second implementation in plain Python ---------------------------------

EPOCH = datetime.date(1800, 1, 1)
DAYS = [EPOCH + datetime.timedelta(n) for n in range(146_097)]
LATE = [d for d in DAYS if d.day > 12]
TWO = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98}


def day_of(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d)) if 1800 <= int(y) <= 2199 else None
    except ValueError:
        return None


def network(kind, units, radices, key):
    secret = hashlib.sha256(key.encode()).hexdigest()
    half = len(units) // 2
    parts = [units[:half], units[half:]]
    sizes = [radices[:half], radices[half:]]
    for r in range(10):
        own, other = r % 2, ",".join(map(str, parts[1 - r % 2]))
        parts[own] = [(v + int(hashlib.sha256("|".join([secret, kind[:4], str(r), str(j), other]).encode()).hexdigest()[:12], 16)) % sizes[own][j]
                      for j, v in enumerate(parts[own])]
    return parts[0] + parts[1]


def spread(kind, m, places, key):
    """The characters at ``places`` permuted, letters within their case."""
    units = [int(m[i]) if m[i].isdigit() else ord(m[i].lower()) - 97 for i in places]
    new = network(kind, units, [10 if m[i].isdigit() else 26 for i in places], key)
    out = list(m)
    for i, v in zip(places, new):
        out[i] = str(v) if m[i].isdigit() else chr(v + (97 if m[i].islower() else 65))
    return "".join(out)


def plain(m, key):
    """The pseudonym of a candidate and its kind; None where it doesn't validate."""
    digits = re.sub(r"\D", "", m)
    if "@" in m:
        return spread("mail", m, [i for i in range(m.index("@")) if re.match("[A-Za-z0-9]", m[i])], key), "mail"
    if m[0] == "+" or re.fullmatch(r"(\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}", m):
        if m[0] == "+" and not 8 <= len(digits) <= 15:
            return m, None
        skip = 0 if m[0] != "+" else 1 if digits[0] in "17" else 2 if int(digits[:2]) in TWO else 3
        return spread("phone", m, [i for i, c in enumerate(m) if c.isdigit()][skip:], key), "phone"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        a, b, c = map(int, m.split("-"))
        if a in (0, 666) or a >= 900 or not b or not c:
            return m, None
        areas = [x for x in range(1, 900) if x != 666]
        x, y, z = network("ssn", [areas.index(a), b - 1, c - 1], [898, 99, 9999], key)
        return f"{areas[x]:03d}-{y + 1:02d}-{z + 1:04d}", "ssn"
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4}", m):
        a, b, c = re.split("[-/.]", m)
        if len(a) == 4:
            kind, day = "datey", day_of(a, b, c)
        else:
            kind, day = ("dated", day_of(c, b, a)) if day_of(c, b, a) else ("datem", day_of(c, a, b))
        if day is None:
            return m, None
        of, radix = (LATE, (9, 9833)) if kind == "datem" else (DAYS, (189, 773))
        x, y = network(kind, list(divmod(of.index(day), radix[1])), list(radix), key)
        new = of[x * radix[1] + y]
        form = {"datey": "{y}-{m}-{d}", "dated": "{d}{s}{m}{t}{y}", "datem": "{m}{s}{d}{t}{y}"}[kind]
        return form.format(y=f"{new.year:04d}", m=f"{new.month:02d}", d=f"{new.day:02d}", s=m[2], t=m[5]), kind
    if re.match(r"\d{1,3}\.", m):
        octets = list(map(int, m.split(".")))
        return (".".join(map(str, network("ip", octets, [256] * 4, key))), "ip") if max(octets) <= 255 else (m, None)
    if re.match(pii._ISSUERS, digits) and luhn(digits):
        at = [i for i, c in enumerate(m) if c.isdigit()]
        new = spread("card", m, at[6:-1], key)[:-1]
        return next(new + c for c in "0123456789" if luhn(re.sub(r"\D", "", new + c))), "card"
    return m, None


def both(spark, texts, key="k"):
    got = run(spark, texts, key)
    for text, (new, n, kinds) in zip(texts, got):
        found = [plain(m[0], key) for m in regex.finditer(pii.PATTERN, text)]
        made = iter(found)
        assert (new, n, kinds) == (regex.sub(pii.PATTERN, lambda m: next(made)[0], text), sum(k is not None for _, k in found), sorted(k for _, k in found if k)), text
    return got


def test_a_year_of_both_date_orders_is_one_to_one(spark):
    year = [datetime.date(1999, 1, 1) + datetime.timedelta(n) for n in range(365 * 3)]
    texts = sorted({f"{d:%d/%m/%Y}" for d in year} | {f"{d:%m/%d/%Y}" for d in year})
    new = [t for t, *_ in both(spark, texts)]
    assert len(set(new)) == len(texts) and all(n == 1 for _, n, _ in run(spark, new))


def test_one_phone_number_in_all_writings_is_one_pseudonym(spark):
    forms = ["+1 (555) 123-4567", "+1 555 123 4567", "+15551234567", "+1-555-123-4567", "(555) 123-4567", "555-123-4567"]
    got = [re.sub(r"\D", "", t)[-10:] for t, *_ in both(spark, forms)]
    assert len(set(got)) == 1 and got[0] != "5551234567"
    other = ["+353 1 234 5678", "+35312345678", "+44 20 7946 0958", "+442079460958", "+7 (495) 123-45-67"]
    new = [re.sub(r"\D", "", t) for t, *_ in both(spark, other)]
    assert new[0] == new[1] and new[2] == new[3] and [n[:3] for n in new[::2]] == ["353", "442"[:2] + new[2][2], "7" + new[4][1:3]]


def test_whole_texts_equal_the_plain_implementation(spark):
    rng = random.Random(11)
    piece = [lambda: card(rng), lambda: card(rng, "34", 15), lambda: f"+{rng.randrange(1, 999)} {rng.randrange(10, 9999)} {rng.randrange(10, 9999)}-{rng.randrange(1000)}",
             lambda: f"{rng.choice('abC')}{rng.randrange(99)}.x@m{rng.randrange(9)}.example.org", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
             lambda: f"{rng.randrange(1000):03d}-{rng.randrange(100):02d}-{rng.randrange(10000):04d}", lambda: f"{rng.randrange(1, 14):02d}/{rng.randrange(1, 32):02d}/{rng.randrange(1790, 2210)}",
             lambda: f"{rng.randrange(1, 32):02d}.{rng.randrange(1, 13):02d}.{rng.randrange(1900, 2100)}", lambda: f"({rng.randrange(1000):03d}) 555-{rng.randrange(10000):04d}",
             lambda: rng.choice(["word", "12", "é", "2021-02-30", "1.2.3.4.5", "x@y", "\n"])]
    both(spark, [" ".join(rng.choice(piece)() for _ in range(rng.randrange(1, 12))) for _ in range(300)], "another key")
