"""Format-preserving pseudonyms for personal data, by Feistel networks in SQL.

One pattern finds candidates; each is validated for its kind (Luhn, mod 97, octets,
calendar, ranges).  A valid value becomes a list of small numbers with a radix each
- digits, octets, letters, a day number in two parts - and a ten-round Feistel
network over that list, keyed by SHA-512, permutes the values of its format.  So the
result has the same format and passes the same validation, equal values get equal
pseudonyms in all documents however they are punctuated, and different values
different ones.  Invalid look-alikes stay as they are.

Everything is DataFrame expressions: no Python runs on the executors, and there is
no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# Patterns of each kind, in the order in which they are tried at a place.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?i:(?<![\p{L}\p{N}])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\"? ?[=:] ?[\"']?)[A-Za-z0-9_+/-]{16,128}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ipv4": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])",
    "phone": r"(?<![\p{L}\p{N}.+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9]|\.[0-9])",
}
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: Dates of 1900 to 2099 are FIRST_DAY plus a number below 319 * 229.
FIRST_DAY, DAY_RADICES = "1900-01-01", (319, 229)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """Keyed permutation of lists of numbers, each below its radix; the radices and the kind choose the permutation."""
    size = F.size(values)
    half = F.floor(size / 2).cast("int")
    of = F.concat_ws(",", F.transform(radices, lambda x: x.cast("string")))

    def round_(state: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(state, half + 1, size - half)).otherwise(F.slice(state, F.lit(1), half))
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), of, F.concat_ws(",", F.transform(other, lambda x: x.cast("string"))))
        return _let(
            F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("|more")), 512)),
            lambda digest: F.transform(
                state,
                lambda v, i: F.when(
                    (i < half) == left,
                    (v + F.conv(F.substr(digest, (F.when(i < half, i).otherwise(i - half) % 64) * 4 + 1, F.lit(4)), 16, 10).cast("int")) % F.get(radices, i),
                ).otherwise(v),
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, round_)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _numbers(digits: Column) -> Column:
    return F.transform(F.split(digits, ""), lambda c: c.cast("int"))


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    values = _numbers(digits)
    return F.concat_ws("", F.transform(feistel(values, F.transform(values, lambda _: F.lit(10)), key, kind), lambda v: v.cast("string")))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in turn."""
    at = lambda i: F.substr(shape, i, F.lit(1))
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(at(i).rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(at(i))))


def _same_classes(s: Column, key: str, kind: str, letters: int = 26) -> Column:
    """Digits, the first ``letters`` letters and small Latin-1 letters permuted within their class, other characters as they are."""
    chars = F.split(s, "")
    classes = ((DIGITS, 10), (LOWER, letters), (UPPER, letters), (LATIN, len(LATIN)))

    def choose(of: Callable[[str, int], Column], c: Column, other: Column) -> Column:
        found = other
        for alphabet, radix in reversed(classes):
            found = F.when(F.instr(F.lit(alphabet), c) > 0, of(alphabet, radix)).otherwise(found)
        return found

    values = F.transform(chars, lambda c: choose(lambda alphabet, _: F.instr(F.lit(alphabet), c) - 1, c, F.lit(0)))
    radices = F.transform(chars, lambda c: choose(lambda _, radix: F.lit(radix), c, F.lit(1)))
    back = lambda c, v: choose(lambda alphabet, _: F.substr(F.lit(alphabet), v + 1, F.lit(1)), c, c)
    return F.concat_ws("", F.zip_with(chars, feistel(values, radices, key, kind), back))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(_same_classes(local, key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9_+/-]{16,128}$", 0)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), F.when(value.rlike("^[0-9a-f]+$"), _same_classes(value, key, "secret", 6)).otherwise(_same_classes(value, key, "secret")))


def _luhn_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` and it pass the Luhn test."""
    doubled = lambda d, i: F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    total = F.aggregate(F.transform(_numbers(digits), doubled), F.lit(0), lambda a, x: a + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = _let(_permuted_digits(body, key, "card"), lambda d: F.concat(d, _luhn_digit(d)))
    return F.when(_luhn_digit(body) == F.substr(digits, F.length(digits), F.lit(1)), _let(new, lambda d: _refill(m, d)))


def _mod97(s: Column) -> Column:
    """The remainder of an IBAN's characters (letters: 10 to 35) by 97."""
    number = lambda c: F.when(c.rlike("^[A-Z]$"), F.instr(F.lit(UPPER), c) + 9).otherwise(c.cast("int"))
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: _let(number(c), lambda n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97))


def _iban(m: Column, key: str) -> Column:
    flat = F.regexp_replace(m, " ", "")
    country, body = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5), F.length(flat))
    valid = (_mod97(F.concat(body, F.substr(flat, F.lit(1), F.lit(4)))) == 1) & (F.length(flat) >= 15)
    new = _let(_refill(body, _permuted_digits(_digits(body), key, "iban")), lambda b: F.concat(F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    at = lambda i: F.substr(m, i, F.lit(1))
    plain = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i), " ", ""))
    put = lambda s: F.concat(country, F.concat_ws("", F.transform(F.sequence(F.lit(3), F.length(m)), lambda i: F.when(at(i) == " ", F.lit(" ")).otherwise(F.substr(s, plain(i) - 2, F.lit(1))))))
    return F.when(valid & (F.length(_digits(body)) > 0), _let(new, put))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("int") for i in (1, 2, 3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    back = lambda v: F.format_string("%03d-%02d-%04d", F.when(F.get(v, F.lit(0)) > 664, F.get(v, F.lit(0)) + 2).otherwise(F.get(v, F.lit(0)) + 1), F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) + 1)
    return F.when(valid, _let(new, back))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return F.concat_ws(".", F.transform(feistel(octets, F.transform(octets, lambda _: F.lit(256)), key, "ipv4"), lambda x: x.cast("string")))


def _date(m: Column, key: str) -> Column:
    mark = F.regexp_extract(m, "[./-]", 0)
    ymd = F.when(mark == "-", m).otherwise(F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))))
    day = F.date_diff(ymd.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    a, b = DAY_RADICES
    new = lambda d: F.date_add(F.lit(FIRST_DAY).cast("date"), _let(feistel(F.array(F.floor(d / b).cast("int"), d % b), F.array(F.lit(a), F.lit(b)), key, "date"), lambda v: F.get(v, F.lit(0)) * b + F.get(v, F.lit(1))))
    text = lambda d: F.when(mark == "-", F.date_format(d, "yyyy-MM-dd")).when(mark == "/", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    return F.when(day.isNotNull(), _let(day, lambda d: _let(new(d), text)))


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^(?:\+[0-9]{1,3}(?=[ .(-])|\+[0-9])", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    return F.when(F.length(_digits(m)).between(7, 15), F.concat(code, _let(_permuted_digits(_digits(rest), key, "phone"), lambda d: _refill(rest, d))))


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ssn": _ssn, "card": _card, "ipv4": _ipv4, "date": _date, "phone": _phone}


def pseudonym(m: Column, key: str) -> Column:
    """kind and value of a found string's pseudonym; null where it is no valid value of its kind."""
    made = None
    for kind, pattern in PATTERNS.items():
        value = F.struct(F.lit(kind).alias("kind"), _MAKERS[kind](m, key).alias("value"))
        test = m.rlike(f"^(?:{pattern})$")
        made = F.when(test, value) if made is None else made.when(test, value)
    return made


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with personal data in ``text`` replaced, and kinds and n_pseudonyms.

    A null text stays null, an empty one empty, each with no kinds.  Rows are handled
    one by one, so repeated rows and empty tables need no care; a column that is
    already called kinds or n_pseudonyms is replaced.  ``kinds`` lists the kind of each
    replaced value in order; n_pseudonyms is their number.
    """
    pattern = "|".join(f"(?:{p})" for p in PATTERNS.values())
    text = F.col("text")
    pairs = F.when(text.rlike("[0-9]|@|[=:]"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p"))))
    out = docs.withColumn("__found", pairs)
    some = F.size("__found") > 0
    pieces = F.split(text, pattern, -1)
    joined = F.concat(
        F.concat_ws("", F.zip_with(F.slice(pieces, F.lit(1), F.size("__found")), F.col("__found"), lambda a, x: F.concat(a, F.coalesce(x["p"]["value"], x["m"])))),
        F.element_at(pieces, -1),
    )
    valid = F.filter("__found", lambda x: x["p"]["value"].isNotNull())
    kinds = F.when(some, F.transform(valid, lambda x: x["p"]["kind"])).otherwise(F.array().cast("array<string>"))
    return out.withColumn("text", F.when(some, joined).otherwise(text)).withColumn("kinds", kinds).withColumn("n_pseudonyms", F.size("kinds")).drop("__found")
