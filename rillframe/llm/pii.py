"""Format-preserving Feistel pseudonyms for personal numbers and dates.

Candidates are found by one pattern and validated (card issuer, length and Luhn digit;
calendar dates; address octets; social security ranges; phone and mail forms).  Each
value becomes a list of units with radices, and a keyed Feistel network adds a hash of
one half to the other half, unit by unit and modulo its radix: a permutation of the
format's values.  Equal values get equal pseudonyms in every document, different
values different ones, and the pseudonym passes the same validation.  A phone number is
its digits after the country code, so one number has one pseudonym in all its writings.
A day whose writing could be read either way is taken day first; those that can only
be month first are permuted among themselves, so the two never meet.  The domain of a
mail address stays as it is.

Everything is Spark SQL expressions over single rows: no Python, no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# The forms, in Java's syntax.  Every quantifier is bounded or possessive, so a pass is linear in the text.
_WORD = r"[\p{L}\p{N}_]"
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
# with a country code (ten digits after +1), and ten digits in the national forms that belong to +1
_PHONE = (rf"(?<!{_WORD}|\+)\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}(?!{_WORD})"
          rf"|(?<!{_WORD}|\+)\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?\d{{1,4}}){{2,5}}(?!{_WORD})"
          rf"|(?<!{_WORD}|[/.-])(?:\(\d{{3}}\) ?\d{{3}}-\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}})(?!{_WORD}|-\d)")
_DATE = rf"(?<!{_WORD}|[/.-])(?:\d{{4}}-\d\d-\d\d|\d\d/\d\d/\d{{4}}|\d\d\.\d\d\.\d{{4}})(?!{_WORD}|[/-]\d)"
_SSN = rf"(?<!{_WORD}|-)\d{{3}}-\d\d-\d{{4}}(?!{_WORD}|-\d)"
_IP = rf"(?<!{_WORD}|\.)(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!{_WORD}|\.\d)"
_CARD = (rf"(?<!{_WORD})(?:\d{{13,19}}|\d{{4}} \d{{4}} \d{{4}} \d{{4}}|\d{{4}}-\d{{4}}-\d{{4}}-\d{{4}}"
         rf"|\d{{4}} \d{{6}} \d{{5}}|\d{{4}}-\d{{6}}-\d{{5}})(?!{_WORD}|-\d)")
PATTERN = "|".join((_MAIL, _PHONE, _DATE, _SSN, _IP, _CARD))

#: Issuer prefixes and lengths of payment cards.
_ISSUERS = (r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}"
            r"|3(?:0[0-5]|[68]\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12}|(?:6011|65\d\d|64[4-9]\d)\d{12}|62\d{14,17})$")

#: Country calling codes of one and two digits; all others have three.
_CALLING = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: First day and number of days of the dates that are permuted: 400 Gregorian years, 189 x 773 days.
EPOCH, YEARS = "1800-01-01", (1800, 2199)
_RADIX_DATE = (189, 773)
#: Days after the twelfth of their month among them, 9 x 9833: what only reads as a date with the month first.
_RADIX_LATE = (9, 9833)

_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_CHARS = "transform(sequence(1, length(x.m)), i -> substring(x.m, i, 1))"


def _luhn(digits: str, first_doubled: bool) -> str:
    """Luhn sum; with ``first_doubled`` the last digit counts double (a number without its check digit)."""
    v = f"cast(substring({digits}, -i, 1) as int)"
    return f"""aggregate(sequence(1, length({digits})), 0L, (s, i) -> s + if(i % 2 = {1 if first_doubled else 0},
        (2 * {v}) div 10 + (2 * {v}) % 10, {v}))"""


def _date_order() -> str:
    """How the date is written: y (year first), d (day first), m (month first), null if it is no date."""
    y, a, b = "cast(right(x.m, 4) as int)", "left(x.m, 2)", "substring(x.m, 4, 2)"
    inside = f"between {YEARS[0]} and {YEARS[1]}"
    day = lambda d, m: f"try_to_date(concat(right(x.m, 4), '-', {m}, '-', {d}), 'yyyy-MM-dd') is not null and {y} {inside}"
    return f"""case when x.m rlike r'^\\d{{4}}-' then if(try_to_date(x.m, 'yyyy-MM-dd') is not null and cast(left(x.m, 4) as int) {inside}, 'y', null)
        when {day(a, b)} then 'd' when {day(b, a)} then 'm' end"""


def _kind() -> str:
    ssn = ("left(x.m, 3) not in ('000', '666') and left(x.m, 1) <> '9' and substring(x.m, 5, 2) <> '00' and right(x.m, 4) <> '0000'")
    return rf"""case
        when contains(x.m, '@') then 'mail'
        when startswith(x.m, '+') then if(length({_DIGITS}) between 8 and 15, 'phone', null)
        when x.m rlike r'^(?:\(\d{{3}}\) ?|\d{{3}}-)\d{{3}}-\d{{4}}$' then 'phone'
        when x.m rlike r'^\d{{3}}-\d\d-\d{{4}}$' then if({ssn}, 'ssn', null)
        when x.m rlike r'^(?:\d{{4}}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{{4}})$' then concat('date', {_date_order()})
        when x.m rlike r'^\d{{1,3}}\.' then if(forall(split(x.m, r'\.'), o -> cast(o as int) <= 255), 'ip', null)
        when {_DIGITS} rlike r'{_ISSUERS}' and {_luhn(_DIGITS, False)} % 10 = 0 then 'card' end"""


def _at() -> str:
    """Positions (from 1) of the characters that are permuted one by one."""
    chars = "sequence(1, length(x.m))"
    return rf"""case x.kind
        when 'mail' then filter({chars}, i -> i < instr(x.m, '@') and substring(x.m, i, 1) rlike '[A-Za-z0-9]')
        when 'phone' then filter({chars}, i -> substring(x.m, i, 1) rlike '[0-9]' and length(regexp_replace(left(x.m, i), '[^0-9]', ''))
            > if(startswith(x.m, '+'), length(regexp_extract({_DIGITS}, r'{_CALLING}', 0)), 0))
        when 'card' then filter({chars}, i -> substring(x.m, i, 1) rlike '[0-9]'
            and length(regexp_replace(left(x.m, i), '[^0-9]', '')) between 7 and length({_DIGITS}) - 1)
        else cast(array() as array<int>) end"""


def _units() -> str:
    day = f"datediff(to_date(case x.kind when 'datey' then x.m when 'dated' then concat(right(x.m, 4), '-', substring(x.m, 4, 2), '-', left(x.m, 2)) "\
          f"else concat(right(x.m, 4), '-', left(x.m, 2), '-', substring(x.m, 4, 2)) end, 'yyyy-MM-dd'), date'{EPOCH}')"
    area = "cast(left(x.m, 3) as int)"
    # twelve days of every month, this one included, come before and are left out
    late = f"({day} - 12 * ((cast(right(x.m, 4) as int) - {YEARS[0]}) * 12 + cast(left(x.m, 2) as int)))"
    return rf"""case
        when x.kind = 'datem' then array(cast({late} div {_RADIX_LATE[1]} as int), {late} % {_RADIX_LATE[1]})
        when x.kind = 'ip' then transform(split(x.m, r'\.'), o -> cast(o as int))
        when startswith(x.kind, 'date') then array(cast(({day}) div {_RADIX_DATE[1]} as int), ({day}) % {_RADIX_DATE[1]})
        when x.kind = 'ssn' then array({area} - if({area} > 666, 2, 1), cast(substring(x.m, 5, 2) as int) - 1, cast(right(x.m, 4) as int) - 1)
        else transform(x.at, i -> if(substring(x.m, i, 1) rlike '[0-9]', cast(substring(x.m, i, 1) as int), ascii(lower(substring(x.m, i, 1))) - 97)) end"""


def _radices() -> str:
    return f"""case
        when x.kind = 'datem' then array({_RADIX_LATE[0]}, {_RADIX_LATE[1]})
        when x.kind = 'ip' then array(256, 256, 256, 256)
        when startswith(x.kind, 'date') then array({_RADIX_DATE[0]}, {_RADIX_DATE[1]})
        when x.kind = 'ssn' then array(898, 99, 9999)
        else transform(x.at, i -> if(substring(x.m, i, 1) rlike '[0-9]', 10, 26)) end"""


def _feistel(key: str) -> str:
    """Units after all rounds; ``key`` is hexadecimal."""

    def add(to: str, radix: str, other: str) -> str:
        prf = f"cast(conv(left(sha2(concat_ws('|', '{key}', left(x.kind, 4), acc_round, j, array_join({other}, ',')), 256), 12), 16, 10) as bigint)"
        return f"transform({to}, (v, j) -> cast((v + {prf}) % {radix}[j] as int))"

    half = "cast(size(x.units) div 2 as int)"
    left, right = f"slice(x.units, 1, {half})", f"slice(x.units, {half} + 1, size(x.units))"
    rl, rr = f"slice(x.radix, 1, {half})", f"slice(x.radix, {half} + 1, size(x.radix))"
    step = (f"if(acc_round % 2 = 0, named_struct('a', {add('acc.a', rl, 'acc.b')}, 'b', acc.b), "
            f"named_struct('a', acc.a, 'b', {add('acc.b', rr, 'acc.a')}))")
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', {left}, 'b', {right}), (acc, acc_round) -> {step}, acc -> concat(acc.a, acc.b))"


def _written() -> str:
    """The pseudonym in the original's form."""
    char = """if(array_position(x.at, i) = 0, substring(x.m, i, 1), case
        when substring(x.m, i, 1) rlike '[0-9]' then cast(x.new[cast(array_position(x.at, i) as int) - 1] as string)
        when substring(x.m, i, 1) rlike '[a-z]' then char(97 + x.new[cast(array_position(x.at, i) as int) - 1])
        else char(65 + x.new[cast(array_position(x.at, i) as int) - 1]) end)"""
    text = f"array_join(transform(sequence(1, length(x.m)), i -> {char}), '')"
    payload = f"left(regexp_replace({text}, '[^0-9]', ''), length({_DIGITS}) - 1)"
    day = f"date_add(date'{EPOCH}', x.new[0] * {_RADIX_DATE[1]} + x.new[1])"
    rank = f"(x.new[0] * {_RADIX_LATE[1]} + x.new[1])"
    first = f"(datediff(add_months(date'{EPOCH}', mo), date'{EPOCH}') - 12 * mo)"  # late days before the month
    # months have 16 to 19 late days, 18.4369 on average: two months to either side are enough
    month = f"array_max(filter(sequence(greatest(0, cast({rank} / 18.4369 as int) - 2), cast({rank} / 18.4369 as int) + 2), mo -> {first} <= {rank}))"
    late = f"element_at(transform(array({month}), mo -> date_add(add_months(date'{EPOCH}', mo), {rank} - {first} + 12)), 1)"
    area = "(x.new[0] + if(x.new[0] >= 665, 2, 1))"
    return f"""case
        when x.kind is null then x.m
        when x.kind = 'card' then concat(left({text}, length(x.m) - 1), (10 - {_luhn(payload, True)} % 10) % 10)
        when x.kind = 'ip' then array_join(x.new, '.')
        when x.kind = 'datey' then date_format({day}, 'yyyy-MM-dd')
        when x.kind = 'dated' then date_format({day}, concat('dd', substring(x.m, 3, 1), 'MM', substring(x.m, 6, 1), 'yyyy'))
        when x.kind = 'datem' then date_format({late}, concat('MM', substring(x.m, 3, 1), 'dd', substring(x.m, 6, 1), 'yyyy'))
        when x.kind = 'ssn' then concat(lpad({area}, 3, '0'), '-', lpad(x.new[1] + 1, 2, '0'), '-', lpad(x.new[2] + 1, 4, '0'))
        else {text} end"""


def _found(column: str, key: str) -> str:
    """SQL of ARRAY<STRUCT<m, kind, text>> for the candidates of a text, in order; kind is null where validation fails."""
    secret = hashlib.sha256(key.encode()).hexdigest()
    out = f"transform(regexp_extract_all({column}, r'{PATTERN}', 0), m -> named_struct('m', m))"
    kept = ["m"]
    for added in ({"kind": _kind()}, {"at": _at()}, {"units": _units(), "radix": _radices()}, {"new": _feistel(secret)}, {"text": _written()}):
        fields = [f"'{n}', x.{n}" for n in kept] + [f"'{n}', {sql}" for n, sql in added.items()]
        out = f"transform({out}, x -> named_struct({', '.join(fields)}))"
        kept += added
    return f"transform({out}, x -> named_struct('m', x.m, 'kind', left(x.kind, 5), 'text', x.text))"


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_found, kinds (sorted, one entry a value found).

    ``kinds`` are card, phone, mail, ip, ssn and the dates datey, dated and datem (year,
    day or month first).  What doesn't validate stays as it is, so a document without
    personal values comes back unchanged.  A null text stays null with nothing found,
    an empty one empty; repeated rows all come back alike; other columns are ignored.
    The same key gives the same pseudonyms at any time and place.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # most texts hold no candidate: for them one search is all, and nothing is split or joined
    rows = rows.select("doc_id", "text", F.expr(f"case when text rlike r'{PATTERN}' then {_found('text', key)} else cast(array() as array<struct<m:string,kind:string,text:string>>) end").alias("found"))
    pieces = f"split(text, r'{PATTERN}', -1)"
    rebuilt = f"array_join(zip_with({pieces}, found, (p, x) -> concat(coalesce(p, ''), coalesce(x.text, ''))), '')"
    return rows.select(
        "doc_id", F.expr(f"case when size(found) > 0 then {rebuilt} else text end").alias("text"),
        F.expr("cast(size(filter(found, x -> x.kind is not null)) as bigint)").alias("n_found"),
        F.expr("array_sort(transform(filter(found, x -> x.kind is not null), x -> x.kind))").alias("kinds"))
