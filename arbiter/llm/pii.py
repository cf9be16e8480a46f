"""PII: format-preserving Feistel pseudonyms, in DataFrame operations only.

Candidates are found by one pattern.  Each is validated for its kind (Luhn for
cards, modulo 97 for IBANs, octets of addresses, number plan of telephone and
social security numbers, the calendar for dates) and then permuted inside its
own format by a keyed Feistel network: the value is a list of symbols with
their radices, and in every round the symbols at even (or odd) places are
shifted by a keyed digest of the other ones.  This is a permutation of the
format, so equal values get equal pseudonyms in all documents, different values
of a format stay different, and with the key it can be undone.  Check digits
are computed anew.  A candidate that fails validation stays as it is.

Edge cases: a null text stays null, with no values; an empty text stays empty;
texts of any length are handled whole; repeated rows get equal results; columns
of the input keep their names whatever they are; an empty table stays empty.
Slashed dates are read month first, and day first only if they are no date
otherwise.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "arbiter-public-test-key"
#: Characters of a token that are permuted together.
PIECE = 256
DIGITS, HEX = string.digits, "0123456789abcdef"
#: One 400-year cycle of the calendar: 146097 = 189 * 773 days from 1800-01-01.
DAY_ZERO, DAY_RADICES = "1800-01-01", (189, 773)

_L, _R = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: Names whose assigned values are secrets, and the signs of an assignment.
_NAMES = "(?:password|passwd|secret|token|api_key)"
_SIGN = "(?: ?[=:] ?)"
_LABEL = r"[A-Za-z0-9-]{1,63}+"
#: Kind: (pattern before, pattern of the value, pattern after), in order of precedence.
KINDS: dict[str, tuple[str, str, str]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])", rf"[A-Za-z0-9._%+-]{{1,128}}+@{_LABEL}(?:\.{_LABEL}){{1,8}}+", ""),
    "access_key": (_L, r"(?:AKIA|ASIA)[A-Z0-9]{16}", _R),
    "secret": (rf"(?:(?<={_NAMES}=)|(?<={_NAMES}{_SIGN})(?=[A-Za-z]*[0-9]))", r"[A-Za-z0-9]{8,}+", ""),
    "hex_token": (_L, r"[0-9a-f]{32,}+", _R),
    "iban": (_L, r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", _R),
    "ip": (r"(?<![0-9.])", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", r"(?![0-9]|\.[0-9])"),
    "date": (r"(?<![0-9/.-])", r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})", r"(?![0-9/-]|\.[0-9])"),
    "ssn": (r"(?<![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![0-9-])"),
    "card": (
        r"(?<![0-9])",
        r"(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})",
        r"(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9A-Za-z+])",
        r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})",
        r"(?![0-9])",
    ),
}
#: A value begins where no letter or digit stands before, or at a digit after a letter; inside words nothing else is tried.
CANDIDATE = r"(?:(?<![A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9]))(?:" + "|".join(f"{a}{b}{c}" for a, b, c in KINDS.values()) + ")"
#: Every candidate has a digit or an @, or follows an assignment; texts without any are passed through.
HINT = "[0-9@=]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(symbols: Column, radices: Column, tweak: str, key: str = KEY, decrypt: bool = False) -> Column:
    """Permute ``symbols`` (array of int) inside ``radices`` by ``ROUNDS`` keyed rounds."""
    order = range(ROUNDS - 1, -1, -1) if decrypt else range(ROUNDS)
    sign = -1 if decrypt else 1

    def one(state: Column, rnd: Column, radix: Column) -> Column:
        fixed = F.filter(state, lambda _, i: i % 2 == rnd % 2)
        seed = F.sha2(F.concat_ws(",", F.lit(key), F.lit(tweak), rnd.cast("string"), F.array_join(F.transform(fixed, lambda x: x.cast("string")), ".")), 256)

        def shifted(digest: Column) -> Column:
            def step(x: Column, i: Column) -> Column:
                amount = F.conv(F.substring(F.sha2(F.concat_ws(",", digest, i.cast("string")), 256), 1, 13), 16, 10).cast("long")
                return F.when(i % 2 == rnd % 2, x).otherwise(F.pmod(x + F.lit(sign) * (amount % F.get(radix, i)), F.get(radix, i)).cast("int"))

            return F.transform(state, step)

        return let(seed, shifted)

    both = F.struct(symbols.cast("array<int>").alias("v"), radices.cast("array<int>").alias("r"))
    rounds = F.array(*(F.lit(r) for r in order))
    return let(both, lambda s: F.aggregate(rounds, s["v"], lambda state, rnd: one(state, rnd, s["r"])))


def permute_chars(value: Column, alphabets: Callable[[Column, Column], Column], tweak: str, key: str, decrypt: bool) -> Column:
    """Permute the characters of ``value``; ``alphabets(char, place)`` is the alphabet of a place, empty where it stays."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def with_alphabets(s: Column) -> Column:
        # Places that stay are left out, so that a value written with other separators gets the same symbols.
        moving = F.filter(F.zip_with(s["c"], s["a"], lambda c, a: F.struct(c.alias("c"), a.alias("a"))), lambda x: x["a"] != "")
        symbols = F.transform(moving, lambda x: F.instr(x["a"], x["c"]) - 1)
        out = feistel(symbols, F.transform(moving, lambda x: F.length(x["a"])), tweak, key, decrypt)

        def rebuilt(v: Column) -> Column:
            def char(c: Column, i: Column) -> Column:
                a = F.get(s["a"], i)
                nth = F.size(F.filter(F.slice(s["a"], F.lit(1), i), lambda x: x != ""))
                return F.when(a == "", c).otherwise(F.substring(a, F.get(v, nth) + 1, F.lit(1)))

            return F.array_join(F.transform(s["c"], char), "")

        return let(out, rebuilt)

    return let(chars, lambda c: let(F.struct(c.alias("c"), F.transform(c, alphabets).alias("a")), with_alphabets))


def by_class(c: Column) -> Column:
    """The alphabet of a character's own class."""
    return (
        F.when(c.between("0", "9"), DIGITS).when(c.between("a", "z"), string.ascii_lowercase).when(c.between("A", "Z"), string.ascii_uppercase).otherwise("")
    )


def _ints(text: Column, sep: str) -> Column:
    return F.transform(F.split(text, sep), lambda x: x.cast("int"))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last one is the check digit."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def mod97(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(
        chars, F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str, decrypt: bool) -> Column:
    def changed(p: Column) -> Column:
        body = F.substring(p, F.lit(1), F.length(p) - 1)
        return F.concat(body, ((10 - luhn_sum(F.concat(_digits(body), F.lit("0"))) % 10) % 10).cast("string"))

    end = F.length(m) - 1
    out = let(permute_chars(m, lambda c, i: F.when((i == 0) | (i == end), "").when(c.between("0", "9"), DIGITS).otherwise(""), "card", key, decrypt), changed)
    return F.when(luhn_sum(_digits(m)) % 10 == 0, out)


def _iban(m: Column, key: str, decrypt: bool) -> Column:
    plain = F.regexp_replace(m, " ", "")
    rearranged = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def changed(p: Column) -> Column:
        q = F.regexp_replace(p, " ", "")
        rest = F.concat(F.substring(q, F.lit(5), F.length(q)), F.substring(q, 1, 2), F.lit("00"))
        return F.concat(F.substring(p, 1, 2), F.lpad((98 - mod97(rest)).cast("string"), 2, "0"), F.substring(p, F.lit(5), F.length(p)))

    # The check digits are set to 0 before the network, as they follow from the rest.
    start = F.concat(F.substring(m, 1, 2), F.lit("00"), F.substring(m, F.lit(5), F.length(m)))
    out = let(permute_chars(start, lambda c, i: F.when(i < 4, "").otherwise(by_class(c)), "iban", key, decrypt), changed)
    return F.when(F.length(plain).between(15, 34) & (mod97(rearranged) == 1), out)


def _ip(m: Column, key: str, decrypt: bool) -> Column:
    octets = _ints(m, r"\.")
    out = F.array_join(F.transform(feistel(octets, F.array(*[F.lit(256)] * 4), "ip", key, decrypt), lambda x: x.cast("string")), ".")
    return F.when(F.array_max(octets) <= 255, out)


def _ssn(m: Column, key: str, decrypt: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    # Areas 1..899 without 666, groups 1..99, serials 1..9999.
    symbols = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    out = let(
        feistel(symbols, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key, decrypt),
        lambda v: F.concat_ws(
            "-", F.lpad(F.when(v[0] >= 665, v[0] + 2).otherwise(v[0] + 1).cast("string"), 3, "0"),
            F.lpad((v[1] + 1).cast("string"), 2, "0"), F.lpad((v[2] + 1).cast("string"), 4, "0"),
        ),
    )
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), out)


def _date(m: Column, key: str, decrypt: bool) -> Column:
    def part(a: int, n: int) -> Column:
        return F.substring(m, a, n)

    def day(y: Column, mo: Column, d: Column) -> Column:
        return F.concat_ws("-", y, mo, d).try_cast("date")

    month_first = day(part(7, 4), part(1, 2), part(4, 2))
    day_first = day(part(7, 4), part(4, 2), part(1, 2))
    parsed = F.when(part(5, 1) == "-", m.try_cast("date")).when(part(3, 1) == ".", day_first).otherwise(F.coalesce(month_first, day_first))
    pattern = F.when(part(5, 1) == "-", "yyyy-MM-dd").when(part(3, 1) == ".", "dd.MM.yyyy").when(month_first.isNotNull(), "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    zero = F.lit(DAY_ZERO).cast("date")
    high, low = DAY_RADICES

    def changed(n: Column) -> Column:
        symbols = F.array(F.floor(n / low).cast("int"), (n % low).cast("int"))
        return let(feistel(symbols, F.array(F.lit(high), F.lit(low)), "date", key, decrypt), lambda v: v[0] * low + v[1])

    def text(n: Column) -> Column:
        d = F.date_add(zero, n)
        y, mo, dd = F.lpad(F.year(d).cast("string"), 4, "0"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.day(d).cast("string"), 2, "0")
        return (
            F.when(pattern == "yyyy-MM-dd", F.concat_ws("-", y, mo, dd))
            .when(pattern == "dd.MM.yyyy", F.concat_ws(".", dd, mo, y))
            .when(pattern == "MM/dd/yyyy", F.concat_ws("/", mo, dd, y))
            .otherwise(F.concat_ws("/", dd, mo, y))
        )

    number = F.datediff(parsed, zero)
    return F.when(number.between(0, high * low - 1), let(changed(number), text))


def _phone(m: Column, key: str, decrypt: bool) -> Column:
    digits = _digits(m)
    plus = F.startswith(m, F.lit("+"))
    national = F.when(plus & F.startswith(m, F.lit("+1")), F.substring(digits, F.lit(2), F.length(digits))).when(~plus, digits)
    plan = F.coalesce(F.length(national) == 10, F.lit(False))
    plan_ok = plan & F.substring(national, 1, 1).between("2", "9") & F.substring(national, 4, 1).between("2", "9")
    # The country code stays; in a ten-digit plan area and exchange begin with 2..9, and where they do not they never will.
    code = F.when(plus & plan, F.lit(1)).when(plus, F.least(F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)), F.lit(2))).otherwise(F.lit(0))

    def alphabet(s: Column) -> Callable[[Column, Column], Column]:
        def of(c: Column, i: Column) -> Column:
            place = F.length(_digits(F.substring(m, F.lit(1), i))) - s["code"]
            return (
                F.when(~c.between("0", "9") | (place < 0), "")
                .when(s["plan"] & ((place == 0) | (place == 3)), F.when(c >= "2", "23456789").otherwise("01"))
                .otherwise(DIGITS)
            )

        return of

    out = let(F.struct(code.alias("code"), plan.alias("plan")), lambda s: permute_chars(m, alphabet(s), "phone", key, decrypt))
    return F.when(plan_ok | (plus & F.length(digits).between(8, 15)), out)


def _email(m: Column, key: str, decrypt: bool) -> Column:
    top = F.length(m) - F.instr(F.reverse(m), ".") + 1
    return permute_chars(m, lambda c, i: F.when(i >= top - 1, "").otherwise(by_class(c)), "email", key, decrypt)


def _in_pieces(m: Column, alphabets: Callable[[Column, Column], Column], tweak: str, key: str, decrypt: bool) -> Column:
    """``permute_chars`` of a token of any length, ``PIECE`` characters at a time."""
    starts = F.sequence(F.lit(0), F.floor((F.length(m) - 1) / PIECE).cast("int"))
    return F.array_join(F.transform(starts, lambda i: permute_chars(F.substring(m, i * PIECE + 1, F.lit(PIECE)), alphabets, tweak, key, decrypt)), "")


def pseudonym(m: Column, key: str = KEY, decrypt: bool = False, assigned: Column | None = None) -> Column:
    """(kind, value) of a candidate; ``value`` is null where it is not valid; ``assigned``: it is the value of a secret's name."""
    makers = {
        "email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone,
        "access_key": lambda m, k, d: permute_chars(m, lambda c, i: F.when(i < 4, "").otherwise(by_class(c)), "access_key", k, d),
        "secret": lambda m, k, d: _in_pieces(m, lambda c, _: by_class(c), "secret", k, d),
        "hex_token": lambda m, k, d: _in_pieces(m, lambda c, _: F.lit(HEX), "hex_token", k, d),
    }
    kind = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    given = (F.lit(False) if assigned is None else assigned) & m.rlike("^[A-Za-z0-9]+$")
    for name in reversed([k for k in KINDS if k != "secret"]):
        fits = m.rlike(f"^(?:{KINDS[name][1]})$") & (F.lit(name == "access_key") | ~given)
        kind = F.when(fits, F.lit(name)).otherwise(kind)
        value = F.when(fits, makers[name](m, key, decrypt)).otherwise(value)
    # Only the text before it makes a value a secret, so what fits no other kind is one.
    return F.struct(F.coalesce(kind, F.lit("secret")).alias("kind"), F.when(kind.isNull(), makers["secret"](m, key, decrypt)).otherwise(value).alias("value"))


def pseudonymize(docs: DataFrame, text_col: str = "text", payload: Column | None = None, key: str = KEY, decrypt: bool = False) -> DataFrame:
    """(row, text, kinds): ``text`` with pseudonyms, ``kinds`` of the values replaced in order; ``row`` is ``payload``, by default all columns."""
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(payload.alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    # Texts with candidates only: the pieces between them are found by the same pattern.
    rows = rows.withColumn("found", found)
    some = F.size("found") > 0
    rows = rows.withColumn("between", F.when(some, F.split("text", CANDIDATE, -1))).withColumn(
        "changed", F.when(some, F.zip_with("found", F.slice("between", F.lit(1), F.size("found")), lambda m, b: pseudonym(m, key, decrypt, b.rlike(f"{_NAMES}{_SIGN}$"))))
    )
    # Materialised by a generator, so that the network runs once for a value although it is used twice.
    rows = rows.withColumn("changed", F.explode(F.array("changed")))
    values = F.zip_with("found", "changed", lambda m, c: F.coalesce(c["value"], m))
    joined = F.array_join(F.zip_with("between", values, lambda b, v: F.concat(b, F.coalesce(v, F.lit("")))), "")
    kinds = F.transform(F.filter("changed", lambda c: c["value"].isNotNull()), lambda c: c["kind"])
    empty = F.array().cast("array<string>")
    return rows.select("row", F.when(some, joined).otherwise(F.col("text")).alias("text"), F.coalesce(F.when(some, kinds), empty).alias("kinds"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymize(docs, payload=F.col("doc_id")).select(
        F.col("row").alias("doc_id"), "text", F.size("kinds").cast("long").alias("n_values"), "kinds"
    )
