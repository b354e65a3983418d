"""Format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions only.

Personal numbers, dates and addresses are found by pattern and validated; each
valid value is replaced by the value to which a keyed permutation of its own
format maps it.  Equal values so become equal pseudonyms in every document,
different ones stay different, and a pseudonym passes the same validation.

    card    13 to 19 digits, Luhn valid, also beside a shorter number: all digits but the check digit, which is computed anew
    iban    valid by its check digits, solid or with single spaces: letters and digits of the account, check digits anew
    ssn     valid area, group and serial, permuted within the valid ones
    phone   international in any grouping, or ten-digit: all digits behind the country code
    ip      four octets below 256
    date    ISO, with slashes (month first where both readings are possible) or dots (day first), years 1900-2099
    email   letters and digits before the @

A value is a vector of small numbers with a radix each.  A round adds to one
half of it, position by position, numbers drawn from SHA-256 of key, kind, round
and the other half; the halves take turns.  This permutes all vectors of these
radices exactly, so nothing has to be drawn again to stay within a format.

Defined results: a null text stays null and has no values; text that is not
part of a valid value stays as it is; repeated rows are treated alike; other
columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrid.llm.text import free_name

ROUNDS = 8

_L, _R = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: Characters of an IBAN by country; with spaces in it nothing else tells where it ends.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "IS TR", 27: "BF BI BJ CF CG CI CM DJ FR GA GR IT MC MG ML MR NE SM SN TD TG", 28: "AL AZ BY CY DO GT HN HU KM LB MA NI PL SV YE",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_SPACED = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: Written as these, digits are no part of a card.
_OTHER = r"(?:[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"
#: In the order in which they are tried at a place of the text.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9A-Za-z_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_]|\.[0-9])",
    "date": _L + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _R,
    "ssn": _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R,
    "iban": _L + f"(?:{_SPACED}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}})" + _R,
    # five groups of four are a card and a number before or behind it
    "card": _L + f"(?!{_OTHER})(?:[0-9]{{4}}(?:[ -][0-9]{{4}}){{4}}(?![ -]?[0-9])|(?:[0-9](?:[ -](?!{_OTHER}))?){{12,18}}[0-9])" + _R,
    "phone": r"(?:(?<![0-9A-Za-z_+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})|(?<![0-9A-Za-z_])(?:\([0-9]{3}\)|[0-9]{3}))[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}" + _R
    + r"|(?<![0-9A-Za-z_+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]){6,12}" + _R,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No text without one of these holds a value.
HINT = "[0-9@]"

FIRST_DAY = "1900-01-01"
#: 73,049 days of two centuries are 319 x 229.
DAY_RADICES = (319, 229)


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def feistel(values: Column, radices: Column, kind: str, key: str, rounds: int = ROUNDS) -> Column:
    """Permute an array of numbers below their radices."""
    half = F.floor(F.size(values) / 2).cast("int")

    def turn(state: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, F.lit(1), half))

        def move(seen: Column) -> Column:
            def step(x: Column, i: Column) -> Column:
                drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), i.cast("string"), seen).cast("binary"), 256), 1, 12), 16, 10)
                moved = (x + F.pmod(drawn.cast("long"), F.get(radices, i).cast("long"))) % F.get(radices, i)
                return F.when((i < half) == left, moved.cast("long")).otherwise(x)

            return F.transform(state, step)

        return bind(F.array_join(F.transform(other, lambda x: x.cast("string")), ","), move)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.transform(values, lambda x: x.cast("long")), turn)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, "", -1), lambda c: c != "")


def permuted_text(s: Column, kind: str, key: str) -> Column:
    """Letters and digits permuted within their class; other characters stay."""
    zero = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)
    radix = lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26)
    compact = _chars(F.regexp_replace(s, "[^A-Za-z0-9]", ""))

    def fill(cs: Column) -> Column:
        moved = feistel(F.transform(cs, lambda c: F.ascii(c) - zero(c)), F.transform(cs, radix), kind, key)
        made = F.zip_with(moved, cs, lambda v, c: F.char((v + zero(c)).cast("int")))

        def place(new: Column) -> Column:
            def at(c: Column, i: Column) -> Column:
                before = F.length(F.regexp_replace(F.substring(s, F.lit(1), i), "[^A-Za-z0-9]", ""))
                return F.when(c.rlike("[A-Za-z0-9]"), F.get(new, before)).otherwise(c)

            return F.array_join(F.transform(_chars(s), at), "")

        return bind(made, place)

    return bind(compact, fill)


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn_sum(digits: Column) -> Column:
    """Sum over digits with every second one doubled, the last but one first."""
    n = F.size(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, doubled(d)).otherwise(d))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b)


def luhn_valid(s: Column) -> Column:
    return bind(_digits(s), lambda d: (luhn_sum(d) % 10 == 0) & F.size(d).between(13, 19) & F.exists(d, lambda x: x > 0))


def _card(s: Column, key: str) -> Column:
    def make(t: Column) -> Column:
        check = (10 - bind(_digits(F.concat(t, F.lit("0"))), luhn_sum) % 10) % 10
        return F.concat(t, check.cast("string"))

    def spell(c: Column) -> Column:
        return bind(permuted_text(F.substring(c, F.lit(1), F.length(c) - 1), "card", key), make)

    def part(groups: Column) -> Column:
        """The card among the groups of digits, the longest run first; what stands before and behind it stays."""
        number = F.sequence(F.lit(0), F.size(groups) - 1)
        length = lambda n: F.aggregate(F.slice(groups, 1, n), F.lit(0), lambda a, g: a + F.length(g) + 1)
        run = lambda i, j: F.struct(
            (length(i) - length(j + 1)).alias("less"), length(i).alias("at"), F.substring(s, length(i) + 1, length(j + 1) - length(i) - 1).alias("c")
        )
        runs = F.flatten(F.transform(number, lambda i: F.transform(F.filter(number, lambda j: j >= i), lambda j: run(i, j))))
        valid = F.array_sort(F.filter(runs, lambda r: luhn_valid(r["c"])))
        put = lambda r: F.concat(F.substring(s, F.lit(1), r["at"]), spell(r["c"]), F.substring(s, r["at"] + F.length(r["c"]) + 1, F.length(s)))
        return F.when(F.size(valid) > 0, bind(F.get(valid, F.lit(0)), put)).otherwise(s)

    whole = luhn_valid(s)
    return F.when(whole, spell(s)).when(s.rlike("[ -]"), bind(F.split(s, "[ -]"), part)).otherwise(s)


def mod97(s: Column) -> Column:
    """The number that an IBAN spells, its first four characters moved to the end, mod 97."""
    solid = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(solid, F.lit(5), F.length(solid)), F.substring(solid, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(turned), F.lit(0), step)


def _iban(s: Column, key: str) -> Column:
    def make(account: Column) -> Column:
        country = F.substring(s, 1, 2)
        check = 98 - mod97(F.concat(country, F.lit("00"), account))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)

    return F.when(mod97(s) == 1, bind(permuted_text(F.substring(s, F.lit(5), F.length(s)), "iban", key), make)).otherwise(s)


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (F.substring(s, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1)
    radices = F.array(F.lit(898), F.lit(99), F.lit(9999))

    def spell(v: Column) -> Column:
        a = F.get(v, F.lit(0)) + 1
        parts = ((a + F.when(a >= 666, 1).otherwise(0), 3), (F.get(v, F.lit(1)) + 1, 2), (F.get(v, F.lit(2)) + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, bind(feistel(values, radices, "ssn", key), spell)).otherwise(s)


def _ip(s: Column, key: str) -> Column:
    octets = F.transform(F.split(s, r"\."), lambda o: o.cast("int"))
    spell = lambda v: F.array_join(F.transform(v, lambda o: o.cast("string")), ".")
    moved = bind(octets, lambda o: feistel(o, F.transform(o, lambda x: F.lit(256)), "ip", key))
    return F.when(F.forall(octets, lambda o: o < 256), bind(moved, spell)).otherwise(s)


def _date(s: Column, key: str) -> Column:
    iso, slash = s.rlike("^[0-9]{4}-"), s.rlike("/")
    first, second = F.substring(s, 1, 2), F.substring(s, 4, 2)
    month_first = slash & (first.cast("int") <= 12)
    year = F.when(iso, F.substring(s, 1, 4)).otherwise(F.substring(s, 7, 4))
    month = F.when(iso, F.substring(s, 6, 2)).when(month_first, first).otherwise(second)
    day = F.when(iso, F.substring(s, 9, 2)).when(month_first, second).otherwise(first)
    parsed = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    a, b = DAY_RADICES
    start = F.lit(FIRST_DAY).cast("date")

    def spell(v: Column) -> Column:
        d = F.date_add(start, (F.get(v, F.lit(0)) * b + F.get(v, F.lit(1))).cast("int"))
        return (
            F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(month_first, F.date_format(d, "MM/dd/yyyy"))
            .when(slash, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
        )

    def move(index: Column) -> Column:
        values = F.array(F.floor(index / b).cast("long"), (index % b).cast("long"))
        made = bind(feistel(values, F.array(F.lit(a), F.lit(b)), "date", key), spell)
        return F.when(index.between(0, a * b - 1), made).otherwise(s)

    return F.coalesce(bind(F.datediff(parsed, start), move), s)


def _phone(s: Column, key: str) -> Column:
    country = F.regexp_extract(s, r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9]{1,2})", 0)
    rest = F.substring(s, F.length(country) + 1, F.length(s))
    return F.concat(country, permuted_text(rest, "phone", key))


def _email(s: Column, key: str) -> Column:
    local = F.substring_index(s, "@", 1)
    return F.concat(permuted_text(local, "email", key), F.substring(s, F.length(local) + 1, F.length(s)))


def kind_of(s: Column) -> Column:
    """Which pattern a found value follows, in the order of ``PATTERNS``."""
    whole = None
    for kind, pattern in PATTERNS.items():
        test = s.rlike(f"^(?:{pattern})$")
        whole = F.when(test, F.lit(kind)) if whole is None else whole.when(test, F.lit(kind))
    return whole


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of a found value; the value itself when it is not valid."""

    def by_kind(kind: Column) -> Column:
        return (
            F.when(kind == "email", _email(s, key)).when(kind == "ip", _ip(s, key)).when(kind == "date", _date(s, key))
            .when(kind == "ssn", _ssn(s, key)).when(kind == "iban", _iban(s, key)).when(kind == "card", _card(s, key))
            .when(kind == "phone", _phone(s, key)).otherwise(s)
        )

    return bind(kind_of(s), by_kind)


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Replace valid values in ``column``; adds ``pii``, the kinds replaced, in order of place."""
    text = F.col(f"`{column}`")
    found, made, added = free_name(docs, "found_"), free_name(docs, "made_"), free_name(docs, "pii")
    hint = text.rlike(HINT)
    none = F.array().cast("array<string>")
    step = docs.withColumn(found, F.when(hint, F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(none))
    step = step.withColumn(made, F.transform(found, lambda s: pseudonym(s, key)))
    # what stands between the values, then each value's pseudonym, in turn
    between = F.split(text, ANY, -1)
    woven = F.array_join(F.flatten(F.zip_with(between, F.col(made), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    new = F.when(F.size(found) > 0, woven).otherwise(text)
    kinds = F.transform(F.filter(F.arrays_zip(F.col(found).alias("a"), F.col(made).alias("b")), lambda p: p["a"] != p["b"]), lambda p: kind_of(p["a"]))
    return step.withColumns({column: new, added: F.coalesce(kinds, none)}).drop(found, made)
