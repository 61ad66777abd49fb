"""Format-preserving pseudonyms: keyed Feistel permutations of validated numbers and dates.

Card numbers, IBANs, nine-digit identity numbers, telephone numbers, network addresses and dates in a text are replaced by others of
the same kind and layout. The replacement permutes the values of a format under a key, so equal
values stay equal everywhere, different values stay different, and whoever has the key can go back. A card number whose
check digit is right gets a right one, and so does an IBAN; a date becomes a date from 1900 to 2099; an address stays an
address. The name of a mail address is no number: it becomes a keyed digest.

Only DataFrame functions are used, row by row: no shuffle.

Left out: dates with the month first in numbers, with ordinals or years beyond 1900-2099; telephone numbers without country
code, bracket, leading 0 or 3-3-4 layout; addresses that begin with ``::``; an IBAN with wrong check digits is
permuted as a plain number from 13 digits on and else stays.

Defined cases: a null text stays null, an empty one empty; what looks like a date or an address
but is none (30 February, 300.1.1.1) stays; long digit runs with a wrong check digit are permuted as plain numbers;
repeated rows are replaced alike; other columns pass through, and ``n_replaced`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# The layouts that are looked for, the first that matches at a place counts. No group repeats
# without a bound, as each repeat of one takes a frame of the matcher's stack; a domain has at most 127 labels.
# No layout goes over a line, and each holds a digit or an @.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_H = "[0-9A-Fa-f]{1,4}"
ADDRESS6 = (
    rf"(?<![0-9A-Za-z:.])(?:{_H}:){{7}}{_H}(?![0-9A-Za-z:])"
    rf"|(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9]){_H}(?::{_H}){{0,5}}::(?:{_H}(?::{_H}){{0,5}})?(?![0-9A-Za-z:])"
)
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
#: Ten digits as 3-3-4, with a country code or without.
PHONE = r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?|(?<![0-9])[0-9]{3}[ .-][0-9]{3}[ .-])[0-9]{4}(?![0-9])"
ABROAD = (
    r"(?<![0-9])\+[0-9]{1,3}[ .-][0-9](?:[ .-][0-9]{2}){4}(?![0-9])|(?<![0-9])\+[0-9]{8,15}(?![0-9])"
    r"|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,8})){1,3}(?![0-9])"
)
AT_HOME = r"(?<![0-9+])0[0-9](?:[ .][0-9]{2}){4}(?![0-9])|(?<![0-9+])\(?0[0-9]{1,4}\)?[ /-][0-9]{3,8}(?:[ -][0-9]{3,4})?(?![0-9])"
CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = (
    r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|(?<![0-9])3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])"
    r"|(?<![0-9])[0-9]{13,19}(?![0-9])"
)
_LONG = "January|February|March|April|May|June|July|August|September|October|November|December"
_MONTH = f"(?:{_LONG}|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE = (
    r"(?<![0-9])(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}(?![0-9])"
    r"|(?<![0-9])[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}(?![0-9])|(?<![0-9])[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}(?![0-9])"
    rf"|(?<![0-9])[0-9]{{1,2}} {_MONTH} (?:19|20)[0-9]{{2}}(?![0-9])|(?<![0-9A-Za-z]){_MONTH} [0-9]{{1,2}},? (?:19|20)[0-9]{{2}}(?![0-9])"
)
ANY = "|".join((MAIL, ADDRESS6, IBAN, PHONE, ABROAD, DATE, ADDRESS, AT_HOME, IDENTITY, CARD))
#: 1900-01-01 to 2099-12-31 are 73,049 days, 17 times 4,297: a product, so the permutation stays inside.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1900-01-01", 17, 4297


def round_value(key: str, purpose: str, number: Column, value: Column) -> Column:
    """48 keyed bits of a half, for one round."""
    seed = F.concat(F.lit(f"{key}|{purpose}|"), number.cast("string"), F.lit("|"), value.cast("string"))
    return F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def permuted_digits(digits: Column, key: str, purpose: str) -> Column:
    """A permutation of the digit strings of each length (of two or more), as a Feistel network on two halves."""
    half = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(digits.substr(F.lit(1), half).alias("l"), digits.substr(half + 1, F.length(digits)).alias("r"))

    def step(state: Column, i: Column) -> Column:
        size = F.length(state["l"])
        limit = F.rpad(F.lit("1"), size + 1, F.lit("0")).cast("long")
        moved = (state["l"].cast("long") + round_value(key, purpose, i, state["r"]) % limit) % limit
        return F.struct(state["r"].alias("l"), F.lpad(moved.cast("string"), size, F.lit("0")).alias("r"))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(last["l"], last["r"])


def permuted_pair(left: Column, right: Column, a: int, b: int, key: str, purpose: str) -> Column:
    """A permutation of the numbers left * b + right, with left below a and right below b, as one number."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(state: Column, i: Column) -> Column:
        moved = (state["l"] + round_value(key, purpose + "l", i, state["r"])) % a
        return F.struct(moved.alias("l"), ((state["r"] + round_value(key, purpose + "r", i, moved)) % b).alias("r"))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step)
    return last["l"] * b + last["r"]


def laid_out(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in order."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(value)),
            lambda i: F.when(
                value.substr(i, F.lit(1)).rlike("[0-9]"),
                digits.substr(F.length(F.regexp_replace(value.substr(F.lit(1), i), "[^0-9]", "")), F.lit(1)),
            ).otherwise(value.substr(i, F.lit(1))),
        ),
        "",
    )


def card(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    valid = F.call_function("luhn_check", digits)
    body = permuted_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
    check = F.filter(
        F.sequence(F.lit(0), F.lit(9)), lambda k: F.call_function("luhn_check", F.concat(body, k.cast("string")))
    )[0].cast("string")
    return laid_out(value, F.when(valid, F.concat(body, check)).otherwise(permuted_digits(digits, key, "number")))


def phone(value: Column, key: str) -> Column:
    """The country code stays."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    code = F.length(digits) - 10
    national = permuted_digits(digits.substr(code + 1, F.lit(10)), key, "phone")
    return laid_out(value, F.concat(digits.substr(F.lit(1), code), national))


def phone_abroad(value: Column, key: str) -> Column:
    """The country code stays; with fewer digits than a telephone number nothing changes, with more it is a plain number."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    code = F.length(F.regexp_extract(digits, CODE, 0))
    national = permuted_digits(digits.substr(code + 1, F.length(digits)), key, "phone")
    new = laid_out(value, F.concat(digits.substr(F.lit(1), code), national))
    return F.when(F.length(digits) < 8, value).when(F.length(digits) > 15, card(value, key)).otherwise(new)


def phone_at_home(value: Column, key: str) -> Column:
    """The leading 0 stays; what has not the digits of a telephone number does too."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    new = laid_out(value, F.concat(F.lit("0"), permuted_digits(digits.substr(F.lit(2), F.length(digits)), key, "phone")))
    return F.when(F.length(digits).between(8, 13), new).when(F.length(digits) > 13, card(value, key)).otherwise(value)


def identity(value: Column, key: str) -> Column:
    """Areas 000, 666 and from 900, group 00 and serial 0000 are not given out: such values stay and none becomes one."""
    area, group, serial = (value.substr(F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    left = area - F.when(area > 666, 2).otherwise(1)
    new = permuted_pair(left, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "identity")
    part = F.floor(new / (99 * 9999)).cast("long")
    rest = new % (99 * 9999)
    digits = (
        F.lpad((part + F.when(part > 664, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.floor(rest / 9999).cast("long") + 1).cast("string"), 2, "0"),
        F.lpad((rest % 9999 + 1).cast("string"), 4, "0"),
    )
    return F.when(valid, F.concat_ws("-", *digits)).otherwise(value)


def mod_97(text: Column) -> Column:
    """Letters count as 10 to 35."""

    def step(state: Column, sign: Column) -> Column:
        number = F.conv(sign, 36, 10).cast("long")
        return (state * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)


def iban(value: Column, key: str) -> Column:
    """Country and letters stay; the check digits are right again."""
    plain = F.regexp_replace(value, " ", "")
    country, body = plain.substr(F.lit(1), F.lit(2)), plain.substr(F.lit(5), F.length(plain))
    valid = mod_97(F.concat(body, plain.substr(F.lit(1), F.lit(4)))) == 1
    digits = F.regexp_replace(body, "[^0-9]", "")
    new = laid_out(body, permuted_digits(digits, key, "iban"))
    check = F.lpad((F.lit(98) - mod_97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    right = laid_out(value, F.concat(check, F.regexp_replace(new, "[^0-9]", "")))
    wrong = F.when(F.length(digits) > 10, card(value, key)).otherwise(value)
    return F.when(valid & (F.length(digits) > 1), right).otherwise(wrong)


def address6(value: Column, key: str) -> Column:
    """The eight groups in full; a short form with eight groups or more is none and stays."""
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    head, tail = groups(F.substring_index(value, "::", 1)), groups(F.when(value.contains("::"), F.substring_index(value, "::", -1)).otherwise(""))
    missing = F.lit(8) - F.size(head) - F.size(tail)
    whole = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
    numbers = F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long"))
    start = F.struct(F.slice(numbers, 1, 4).alias("l"), F.slice(numbers, 5, 4).alias("r"))

    def step(state: Column, i: Column) -> Column:
        other = F.array_join(F.transform(state["r"], lambda n: n.cast("string")), ":")
        moved = F.transform(state["l"], lambda n, k: (n + round_value(key, "address6", i * 4 + k, other)) % 65536)
        return F.struct(state["r"].alias("l"), moved.alias("r"))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    new = F.array_join(F.transform(F.concat(last["l"], last["r"]), lambda n: F.lower(F.hex(n))), ":")
    return F.when(F.when(value.contains("::"), missing > 0).otherwise(missing == 0), new).otherwise(value)


def address(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    number = permuted_pair(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 65536, 65536, key, "address")
    octets = [F.floor(number / (1 << shift)).cast("long") % 256 for shift in (24, 16, 8, 0)]
    return F.when(F.forall(parts, lambda p: p < 256), F.concat_ws(".", *octets)).otherwise(value)


def date(value: Column, key: str) -> Column:
    long = value.rlike(_LONG)
    form = (
        F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "yyyy-MM-dd").when(value.contains("-"), "yyyy-M-d")
        .when(value.rlike("^[0-9]{2}/[0-9]{2}/"), "dd/MM/yyyy").when(value.contains("/"), "d/M/yyyy")
        .when(value.rlike(r"^[0-9]{2}\.[0-9]{2}\."), "dd.MM.yyyy").when(value.contains("."), "d.M.yyyy")
        .when(value.rlike("^[0-9]"), F.when(long, "d MMMM yyyy").otherwise("d MMM yyyy"))
        .when(value.contains(","), F.when(long, "MMMM d, yyyy").otherwise("MMM d, yyyy"))
        .otherwise(F.when(long, "MMMM d yyyy").otherwise("MMM d yyyy"))
    )
    plain = F.regexp_replace(value, "(?<![0-9])0([0-9] )", "$1")
    plain = F.when(value.rlike("[A-Za-z]"), F.regexp_replace(plain, "(?<![0-9])0([0-9],)", "$1")).otherwise(value)
    day = F.datediff(F.try_to_timestamp(plain, form).cast("date"), F.lit(FIRST_DAY).cast("date"))
    moved = permuted_pair(F.floor(day / DAYS_RIGHT), day % DAYS_RIGHT, DAYS_LEFT, DAYS_RIGHT, key, "date")
    given = F.call_function("date_format", F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), form)
    return F.coalesce(given, value)


def mail(value: Column, key: str) -> Column:
    name = F.substring_index(value, "@", 1)
    digest = F.substring(F.sha2(F.concat(F.lit(f"{key}|mail|"), F.lower(name)).cast("binary"), 256), 1, 16)
    return F.concat(F.lit("u"), digest, F.lit("@"), F.substring_index(value, "@", -1))


def pseudonym(value: Column, key: str) -> Column:
    def whole(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    return (
        F.when(whole(MAIL), mail(value, key))
        .when(whole(ADDRESS6), address6(value, key))
        .when(whole(IBAN), iban(value, key))
        .when(whole(PHONE), phone(value, key))
        .when(whole(ABROAD), phone_abroad(value, key))
        .when(whole(DATE), date(value, key))
        .when(whole(ADDRESS), address(value, key))
        .when(whole(AT_HOME), phone_at_home(value, key))
        .when(whole(IDENTITY), identity(value, key))
        .otherwise(card(value, key))
    )


def replaced(line: Column, key: str) -> Column:
    """(line, n): the line with its values replaced, and how many of them changed.

    The values are taken out and what stands between them is kept. Arrays of one element keep Spark
    from copying the search into every use of its result.
    """
    found = F.array(F.struct(
        F.regexp_extract_all(line, F.lit(ANY), F.lit(0)).alias("values"), F.split(line, ANY, -1).alias("between")
    ))
    made = F.transform(found, lambda cut: F.struct(
        cut["values"].alias("values"), cut["between"].alias("between"),
        F.transform(cut["values"], lambda v: pseudonym(v, key)).alias("new"),
    ))

    def joined(cut: Column) -> Column:
        parts = F.flatten(F.zip_with(cut["between"], cut["new"], lambda gap, v: F.array(gap, F.coalesce(v, F.lit("")))))
        changed = F.filter(F.arrays_zip(cut["values"].alias("a"), cut["new"].alias("b")), lambda v: v["a"] != v["b"])
        return F.struct(F.array_join(parts, "").alias("line"), F.size(changed).alias("n"))

    return F.transform(made, joined)[0]


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the new text and ``n_replaced``, how many values in it were changed.

    Only lines with a digit or an @ are searched.
    """
    kept = [c for c in docs.columns if c != "n_replaced"]
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda line: F.when(line.rlike("[0-9@]"), replaced(line, key)).otherwise(
            F.struct(line.alias("line"), F.lit(0).alias("n"))
        ),
    )
    cut = docs.select(*kept, F.explode(F.array(lines)).alias("_lines"))
    count = F.aggregate("_lines", F.lit(0).cast("long"), lambda total, line: total + line["n"])
    new = F.array_join(F.transform("_lines", lambda line: line["line"]), "\n")
    return cut.select(
        *(F.when(F.col(text).isNotNull(), new).alias(c) if c == text else F.col(c) for c in kept), count.alias("n_replaced")
    )
