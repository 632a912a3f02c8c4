"""Format-preserving pseudonyms for personal data, in DataFrame and SQL functions only.

Numbers and dates are validated (Luhn digit, calendar day, number plan, octets, mod 97) and moved by a keyed Feistel
permutation of their own format's domain: equal values get equal pseudonyms in every document, different values of a format
different ones, and the pseudonym is valid in the same format. A card keeps its length, separators and a right check digit;
an account number its country, letters and right check digits. The rounds add HMAC-SHA-256 of the other half by turns; the
domains are products of two factors, but for days, which walk on until they are in the domain again. An address is its value:
octets with leading zeros and the ways to write an IPv6 address have one pseudonym (the latter as eight full groups). The
local part of an e-mail address, which is no number, becomes a keyed digest. Who has the key can undo what is permuted, so it
has no default; it stands in the query plan.

Days are read as year-month-day, as day/month/year, and as month/day/year where only that is a date; the last kind is
permuted among its own. Months by name are not found, nor phone numbers of other national formats without a plus sign.

Defined results: a null text stays null and has no spans; any id is passed through; repeated rows give repeated results; an
empty table gives an empty result; extra columns are ignored (``pseudonymise`` keeps them, whatever their names).
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_row, text_or_empty, unused
from .spans import matches, quoted

#: The formats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
#: Three, three and four digits with or without a country code, or a plus sign and 7 digits and more in groups.
PHONE = (
    r"(?<![0-9+])(?<![0-9][.-])(?:(?:\+[1-9][0-9]{0,2}[ .-]?|1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|\+[1-9](?=(?:[ .()-]{0,2}[0-9]){6})(?:[0-9]{6,14}|[0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)|[ .-][0-9]{1,4}){1}(?:[ .-][0-9]{2,4}|(?<=\))[0-9]{2,4}){1,3}))(?![0-9]|[.-][0-9])"
)
#: The digits of a phone number that stay.
CODE = r"^(?:\+[0-9]{1,3}(?![0-9])|\+[0-9]|1(?=[^0-9]))"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ISO = r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])"
SLASHED = r"(?<![0-9/.])[0-9]{1,2}([/.])[0-9]{1,2}\1(?:19|20)[0-9]{2}(?![0-9]|[/.][0-9])"
DATE = f"{ISO}|{SLASHED}"
CARD = r"(?<![0-9])(?:[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IP6 = (
    r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:]|\.[0-9])"
)
ANY = "|".join((EMAIL, IP6, IP, IBAN, PHONE, SSN, DATE, CARD))
KINDS = ("email", "ip", "phone", "ssn", "date", "card", "iban", "ip6")
ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, and the two factors of the domain that they are walked in.
FIRST_DAY, DAYS, FACTORS = datetime.date(1900, 1, 1), 73_049, (271, 270)


class Keyed:
    """The round function for one key, as SQL and (for what is known before the query runs) as numbers."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("pseudonyms need a key")
        block = key.encode()
        block = hashlib.sha256(block).digest() if len(block) > 64 else block
        self.block = block.ljust(64, b"\0")
        self.inner, self.outer = (bytes(b ^ pad for b in self.block).hex() for pad in (0x36, 0x5C))

    def digest(self, message: str) -> str:
        """SQL: HMAC-SHA-256 of a string expression, in hexadecimal."""
        return f"sha2(concat(X'{self.outer}', unhex(sha2(concat(X'{self.inner}', cast({message} as binary)), 256))), 256)"

    def number(self, message: str) -> str:
        """SQL: 60 bits of it."""
        return f"cast(conv(substring({self.digest(message)}, 1, 15), 16, 10) as bigint)"

    def moved(self, left: str, right: str, a: str, b: str, kind: int) -> str:
        """SQL: a struct ``l, r``, the place of (left, right) under the permutation of [0, a) x [0, b)."""
        message = lambda half: f"concat_ws(':', {kind}, {a}, {b}, k, {half})"
        step = (
            f"named_struct('l', if(k % 2 = 0, pmod(s.l + {self.number(message('s.r'))}, {a}), s.l), "
            f"'r', if(k % 2 = 1, pmod(s.r + {self.number(message('s.l'))}, {b}), s.r))"
        )
        return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, k) -> {step}, s -> s)"

    def place(self, number: str, a: str, b: str, kind: int) -> str:
        """SQL: the place of a number below a * b."""
        return _let("q", self.moved(f"({number}) div ({b})", f"({number}) % ({b})", a, b, kind), f"q.l * ({b}) + q.r")

    def digits(self, digits: str, kind: int) -> str:
        """SQL: a string of digits moved among those of its length."""
        left = f"length({digits}) div 2"
        a, b = f"cast(pow(10, {left}) as bigint)", f"cast(pow(10, length({digits}) - {left}) as bigint)"
        moved = self.moved(f"concat('0', left({digits}, cast({left} as int)))", f"substring({digits}, cast({left} as int) + 1)", a, b, kind)
        return _let("q", moved, f"concat(lpad(q.l, cast({left} as int), '0'), lpad(q.r, cast(length({digits}) - {left} as int), '0'))")

    def day(self, n: int) -> int:
        """One pass over the domain of days."""
        a, b = FACTORS
        left, right = divmod(n, b)
        for k in range(ROUNDS):
            half = right if k % 2 == 0 else left
            more = int(hmac.new(self.block, f"4:{a}L:{b}L:{k}:{half}".replace("L", "").encode(), hashlib.sha256).hexdigest()[:15], 16)
            left, right = ((left + more) % a, right) if k % 2 == 0 else (left, (right + more) % b)
        return left * b + right

    def walked(self, number: str, wanted: Callable[[str], str], passes: int) -> str:
        """SQL: a day moved until it is wanted again, in ``passes`` passes at most."""
        once = self.place("p", f"{FACTORS[0]}L", f"{FACTORS[1]}L", 4)
        return f"aggregate(sequence(1, {passes}), {number}, (p, i) -> if(i = 1 or not ({wanted('p')}), {once}, p))"


@lru_cache
def longest_walks(key: str) -> tuple[int, int]:
    """Passes until every day is a day again, and until every day after the twelfth of a month is one again."""
    keyed, found = Keyed(key), []
    known = [keyed.day(n) for n in range(FACTORS[0] * FACTORS[1])]
    late = [n < DAYS and (FIRST_DAY + datetime.timedelta(n)).day > 12 for n in range(len(known))]
    for wanted in ([n < DAYS for n in range(len(known))], late):
        away, passes = [m for n, m in enumerate(known) if wanted[n] and not wanted[m]], 1
        while away:
            away, passes = [m for m in map(known.__getitem__, away) if not wanted[m]], passes + 1
        found.append(passes)
    return found[0], found[1]


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a digit string, the last digit not doubled."""
    one = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + if(i % 2 = 1, if({one} > 4, 2 * {one} - 9, 2 * {one}), {one}))"


def _rest_97(code: str) -> str:
    """SQL: a string of digits and letters (A is 10) modulo 97."""
    return f"aggregate(split({code}, ''), 0, (t, c) -> if(c = '', t, if(c rlike '[0-9]', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97)))"


def _check_digits(country: str, rest: str) -> str:
    """SQL: the two check digits of an account number."""
    code = f"concat({rest}, {country}, '00')"
    return f"lpad(98 - {_rest_97(code)}, 2, '0')"


def _refilled(shape: str, digits: str) -> str:
    """SQL: ``shape`` with its digits replaced in turn."""
    return (
        f"array_join(transform(sequence(1, length({shape})), i -> if(substring({shape}, i, 1) rlike '[0-9]', "
        f"substring({digits}, length(regexp_replace(substring({shape}, 1, i), '[^0-9]', '')), 1), substring({shape}, i, 1))), '')"
    )


def _slashed_day(value: str, first: int, second: int) -> str:
    """SQL: the day of three numbers with the day and the month at these places; null if there is none."""
    parts = f"split({value}, '[/.]')"
    day, month = (f"lpad(element_at({parts}, {k}), 2, '0')" for k in (first, second))
    return f"try_to_date(concat_ws('-', element_at({parts}, 3), {month}, {day}), 'yyyy-MM-dd')"


def _groups(value: str) -> str:
    """SQL: the 32 hexadecimal digits of an IPv6 address."""
    sides = f"split(lower({value}), '::')"
    full = lambda side: f"transform(filter(split({side}, ':'), g -> g <> ''), g -> lpad(g, 4, '0'))"
    left, right = full(f"element_at({sides}, 1)"), full(f"coalesce(try_element_at({sides}, 2), '')")
    return _let("l", left, _let("r", right, "array_join(concat(l, array_repeat('0000', 8 - size(l) - size(r)), r), '')"))


def kind_of(value: str) -> str:
    """SQL: which kind a match is, -1 if it is not valid."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    plain = f"replace({value}, ' ', '')"
    return (
        f"case when {value} like '%@%' then 0 "
        f"when {value} like '%:%' then if({value} rlike '[0-9]' and if({value} like '%::%', size(filter(split({value}, ':'), g -> g <> '')) between 2 and 7, true), 7, -1) "
        f"when {value} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then if(forall(split({value}, '[.]'), o -> cast(o as int) <= 255), 1, -1) "
        f"when {value} rlike '^[A-Z]{{2}}[0-9]{{2}}' then if(length({plain}) between 15 and 34 and {_check_digits(f'left({plain}, 2)', f'substring({plain}, 5)')} = substring({plain}, 3, 2), 6, -1) "
        f"when {value} rlike {quoted('^(?:' + PHONE + ')$')} then 2 "
        f"when {value} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({value} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)', 3, -1) "
        f"when {value} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then if(try_to_date({value}, 'yyyy-MM-dd') is not null, 4, -1) "
        f"when {value} rlike '^[0-9]{{1,2}}[/.]' then if({_slashed_day(value, 1, 2)} is not null or {_slashed_day(value, 2, 1)} is not null, 4, -1) "
        f"when {_let('d', digits, _luhn('d') + ' % 10 = 0')} then 5 else -1 end"
    )


def pseudonym(value: str, kind: str, key: str) -> str:
    """SQL: the replacement of a valid match of this kind."""
    keyed = Keyed(key)
    address = f"concat('0:', lower(substring_index({value}, '@', 1)), '@', lower(substring_index({value}, '@', -1)))"
    email = f"concat('u', substring({keyed.digest(address)}, 1, 16), '@', substring_index({value}, '@', -1))"
    octet = lambda k: f"cast(element_at(split({value}, '[.]'), {k}) as bigint)"
    ip = _let(
        "q", keyed.moved(f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", "65536L", "65536L", 1),
        "concat_ws('.', q.l div 256, q.l % 256, q.r div 256, q.r % 256)",
    )
    # a phone: the country code stays; of ten further digits, area and exchange from 200 on stay so, and those below stay below
    code = f"regexp_replace(regexp_extract({value}, {quoted(CODE)}, 0), '[^0-9]', '')"
    plan = "((n div 10000000 - (a - 200) div 3) * b + (n div 10000) % 1000 - (b - 200) div 3) * 10000 + n % 10000"
    ten = "concat(lpad(p div (b * 10000) + (a - 200) div 3, 3, '0'), lpad((p div 10000) % b + (b - 200) div 3, 3, '0'), lpad(p % 10000, 4, '0'))"
    ten = _let("p", keyed.place(plan, "a * 100", "b * 100", 2), ten)
    ten = _let("a", "if(n div 10000000 >= 200, 800L, 200L)", _let("b", "if((n div 10000) % 1000 >= 200, 800L, 200L)", ten))
    ten = _let("n", "cast(d as bigint)", ten)
    phone = f"if(length(d) = 10, {ten}, {keyed.digits('d', 2)})"
    phone = _let("d", f"substring(regexp_replace({value}, '[^0-9]', ''), length(c) + 1)", _let("moved", phone, _let("e", "concat(c, moved)", _refilled(value, "e"))))
    phone = _let("c", code, phone)
    area = f"cast(substring({value}, 1, 3) as bigint)"
    ssn = _let(
        "q", keyed.moved(f"if({area} > 666, {area} - 2, {area} - 1) * 99 + cast(substring({value}, 5, 2) as bigint) - 1", f"cast(substring({value}, 8, 4) as bigint) - 1", "88902L", "9999L", 3),
        "concat_ws('-', lpad(if(q.l div 99 >= 665, q.l div 99 + 2, q.l div 99 + 1), 3, '0'), lpad(q.l % 99 + 1, 2, '0'), lpad(q.r + 1, 4, '0'))",
    )
    all_days, late_days = longest_walks(key)
    number = lambda day: f"cast(datediff({day}, date'{FIRST_DAY}') as bigint)"
    dated = lambda n: f"date_add(date'{FIRST_DAY}', cast({n} as int))"
    any_day = lambda day: _let("n", number(day), dated(keyed.walked("n", lambda p: f"{p} < {DAYS}", all_days)))
    late_day = lambda day: _let("n", number(day), dated(keyed.walked("n", lambda p: f"{p} < {DAYS} and day({dated(p)}) > 12", late_days)))
    iso = f"date_format({any_day(f'to_date({value}, {chr(39)}yyyy-MM-dd{chr(39)})')}, 'yyyy-MM-dd')"
    # two digits are written where two were read, or where two are needed
    sign, wide = f"substring(regexp_extract({value}, '[/.]', 0), 1, 1)", f"{value} rlike '^0|[/.]0'"
    two = lambda x: f"if({wide}, lpad({x}, 2, '0'), cast({x} as string))"
    day_first = _let("t", any_day(_slashed_day(value, 1, 2)), f"concat_ws({sign}, {two('day(t)')}, {two('month(t)')}, year(t))")
    month_first = _let("t", late_day(_slashed_day(value, 2, 1)), f"concat_ws({sign}, {two('month(t)')}, {two('day(t)')}, year(t))")
    date = f"if({value} rlike '^[0-9]{{4}}', {iso}, if({_slashed_day(value, 1, 2)} is not null, {day_first}, {month_first}))"
    # a card: all digits but the last are permuted among as many, the last is the Luhn digit of the rest
    checked = _let("m", keyed.digits("h", 5), _let("z", "concat(m, '0')", f"concat(m, cast(pmod(10 - {_luhn('z')} % 10, 10) as string))"))
    card = _let("d", f"regexp_replace({value}, '[^0-9]', '')", _let("h", "left(d, length(d) - 1)", _let("c", checked, _refilled(value, "c"))))
    plain = f"replace({value}, ' ', '')"
    own = _let("d", "regexp_replace(h, '[^0-9]', '')", _let("m", keyed.digits("d", 6), _refilled("h", "m")))
    iban = _let("h", f"substring({plain}, 5)", _let("g", own, _let("e", f"concat({_check_digits(f'left({plain}, 2)', 'g')}, regexp_replace(g, '[^0-9]', ''))", _refilled(value, "e"))))
    bits = lambda half: f"cast(conv(substring({keyed.digest(half)}, 1, 16), 16, -10) as bigint)"
    step = f"named_struct('l', if(k % 2 = 0, s.l ^ {bits(chr(34) + '7:' + chr(34) + ' || k || ' + chr(34) + ':' + chr(34) + ' || s.r')}, s.l), 'r', if(k % 2 = 1, s.r ^ {bits(chr(34) + '7:' + chr(34) + ' || k || ' + chr(34) + ':' + chr(34) + ' || s.l')}, s.r))".replace('"', "'")
    moved = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast(conv(left(h, 16), 16, -10) as bigint), 'r', cast(conv(right(h, 16), 16, -10) as bigint)), (s, k) -> {step}, s -> s)"
    ip6 = _let("h", _groups(value), _let("q", moved, "regexp_replace(lower(concat(lpad(hex(q.l), 16, '0'), lpad(hex(q.r), 16, '0'))), '(....)(?=.)', '$1:')"))
    cases = " ".join(f"when {k} then {x}" for k, x in enumerate((email, ip, phone, ssn, date, card, iban, ip6)))
    return f"case {kind} {cases} end"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows and columns, the text with pseudonyms, and ``pii_`` (array of ``start, end, kind, pseudonym``); no shuffle.

    If the table has a column ``pii_``, the new one gets further low lines.
    """
    named = (
        f"transform(transform(found, m -> named_struct('start', m.start, 'end', m.end, 'kind', {kind_of('m.value')}, 'value', m.value)), m -> "
        f"named_struct('start', m.start, 'end', m.end, 'kind', m.kind, 'pseudonym', if(m.kind < 0, m.value, {pseudonym('m.value', 'm.kind', key)})))"
    )
    between = f"split(whole, {quoted(ANY)}, -1)"
    clean = f"if(exists(named, m -> m.kind >= 0), array_join(transform({between}, (x, i) -> if(i < size(named), concat(x, element_at(named, i + 1).pseudonym), x)), ''), row.`{text_col}`)"
    rows = packed_row(docs, whole=text_or_empty(text_col)).withColumn("found", matches("whole", ANY)).withColumn("named", F.expr(named))
    return rows.select(
        *[F.expr(clean).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.expr("filter(named, m -> m.kind >= 0)").alias(unused("pii_", docs))
    )
