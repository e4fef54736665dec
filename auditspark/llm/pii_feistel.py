"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates; each is validated (Luhn and mod-97 check digits, calendar dates, octets, numbering plans) and, if
valid, mapped by a keyed Feistel network within its own format. A value is a row of symbols, each with a radix: a digit has 10,
an octet 256, a date the days of its class and 400 years. The row is cut in halves, and in each of ROUNDS rounds one
half is shifted, symbol by symbol and modulo its radix, by digits of SHA-256 over the key, the kind, the round and the other
half. That is a permutation of all values of the format, so equal values get equal pseudonyms in every document, different ones
different pseudonyms, and who has the key can undo it (`undo=True`). Check digits are computed anew, so pseudonyms validate.

Dates are permuted within classes (day below 10, 10 to 12, or above; month below 10 or not; the leap day by itself), so that a
pseudonym has the widths of its original, reads in the same order of day and month, and is a date.

Kinds: e-mail (local part), card (13 to 19 digits that begin with 2 to 6, Luhn; of a longer run the longest part between
separators that validates), IBAN, phone (+country code, or ten digits of the North American plan),
social security number, IPv4 address, date (ISO, or day and month with slashes or dots and a year of 1800 to 2199), credential
(the value of password=, token=, key= and the like, of any length and with parts after dots, and access key ids). Separators, country codes, a card's first digit and
an e-mail's domain stay. Candidates that do not validate stay as they are, so texts without personal data are unchanged.

Defined cases: null stays null and the empty text empty; whole texts are read, of any length; every occurrence is replaced.
Columns of the same names as the output's are replaced, all others kept.
"""

from __future__ import annotations

import secrets
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting that holds the secret key.
KEY_SETTING = "spark.auditspark.pii.key"

ROUNDS = 10
FIRST_YEAR, YEARS = 1800, 400

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9\-])"
CREDENTIAL = r"(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api_?key|access_?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_\-]{8,}+(?:\.[A-Za-z0-9+/_\-]{8,}+){0,64}+)|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
DATE = r"(?<![\d./\-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([/.])\d{1,2}\1\d{4})(?![\d]|[./\-]\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
CARD = r"(?<![\d+.\-])\d(?:[ \-]?\d){12,18}(?![\d]|[.\-]\d)"
PHONE = r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d(?:[ .\-]?\d){3,12}(?!\d)|(?<![\d.\-(])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?![\d]|[.\-]\d)"
#: Later alternatives are tried only where earlier ones do not match.
ANY = "|".join([EMAIL, CREDENTIAL, IBAN, IPV4, DATE.replace("\\1", "[/.]").replace("([/.])", "[/.]"), SSN, PHONE, CARD])


#: Every match of ANY has some of this; few texts have, and it is found much sooner.
PRESENT = r"[0-9@]|AKIA|ASIA|(?i:password|passwd|pwd|secret|token|key)"

_MADE_KEYS: dict[str, str] = {}


def configured_key(spark: SparkSession) -> str:
    """The key that the session is configured with; whoever has it can undo the pseudonyms.

    Where none is set, one is made at random, for this application alone, and a warning says so: its pseudonyms link equal values
    within the application, not those of two.
    """
    if key := spark.conf.get(KEY_SETTING, None):
        return key
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a random key, for this application alone", stacklevel=2)
    return _MADE_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(values: Column, radices: Column, kind: str | Column, key: str, undo: bool = False) -> Column:
    """values (array of long, each below its radix) permuted; a radix of 1 leaves its symbol alone."""
    sign = -1 if undo else 1
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def shifted(mine: Column, radix: Column, seed: Column) -> Column:
        def symbol(x: Column, p: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", seed, F.floor(p / 8).cast("string")), 256)
            drawn = F.conv(F.substr(digest, (p % 8) * 8 + 1, F.lit(8)), 16, 10).cast("long")
            return F.pmod(x + sign * drawn, F.get(radix, p))

        return F.transform(mine, symbol)

    def network(w: Column) -> Column:
        told = lambda other, i: F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.array_join(other.cast("array<string>"), ","), F.array_join(w["r"].cast("array<string>"), ","))

        def one_round(s: Column, i: Column) -> Column:
            even, odd = i % 2 == 0, i % 2 == 1
            return _let(
                F.struct(F.when(even, told(s["b"], i)).otherwise(told(s["a"], i)).alias("seed"), s["a"].alias("a"), s["b"].alias("b")),
                lambda x: F.struct(F.when(odd, x["a"]).otherwise(shifted(x["a"], w["ra"], x["seed"])).alias("a"), F.when(even, x["b"]).otherwise(shifted(x["b"], w["rb"], x["seed"])).alias("b")),
            )

        return _let(F.aggregate(rounds, F.struct(w["a"].alias("a"), w["b"].alias("b")), one_round), lambda end: F.concat(end["a"], end["b"]))

    def halves(w: Column) -> Column:
        half = F.greatest(F.lit(1), F.floor(F.size(w["v"]) / 2).cast("int"))
        rest = F.size(w["v"])
        return F.struct(w["r"].alias("r"), F.slice(w["v"], F.lit(1), half).alias("a"), F.slice(w["v"], half + 1, rest).alias("b"), F.slice(w["r"], F.lit(1), half).alias("ra"), F.slice(w["r"], half + 1, rest).alias("rb"))

    return _let(F.struct(values.alias("v"), radices.alias("r")), lambda w: _let(halves(w), network))


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), 0)


def _joined(numbers: Column) -> Column:
    return F.array_join(numbers.cast("array<string>"), "")


def _permuted_chars(s: Column, kind: str, key: str, undo: bool) -> Column:
    """Letters and digits within their own class; a value of lower-case hex digits alone within those."""

    def of(w: Column) -> Column:
        symbols = F.transform(w["chars"], lambda c: F.struct(
            F.when(w["hex"], 16).when(c.rlike("[0-9]"), 10).when(c.rlike("[a-zA-Z]"), 26).otherwise(1).cast("long").alias("r"),
            F.when(w["hex"], F.conv(c, 16, 10).cast("int")).when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[a-z]"), F.ascii(c) - 97).when(c.rlike("[A-Z]"), F.ascii(c) - 65).otherwise(0).cast("long").alias("v"),
        ))
        return _let(symbols, lambda x: _let(feistel(F.transform(x, lambda y: y["v"]), F.transform(x, lambda y: y["r"]), kind, key, undo), lambda new: F.array_join(F.zip_with(w["chars"], new, lambda c, v: shown(w, c, v)), "")))

    def shown(w: Column, c: Column, v: Column) -> Column:
        return F.when(w["hex"], F.lower(F.conv(v.cast("string"), 10, 16))).when(c.rlike("[0-9]"), v.cast("string")).when(c.rlike("[a-z]"), F.char(v + 97)).when(c.rlike("[A-Z]"), F.char(v + 65)).otherwise(c)

    return _let(F.struct(_chars(s).alias("chars"), s.rlike("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$").alias("hex")), of)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _weave(s: Column, symbols: Column, kind: str = r"\d") -> Column:
    """s with its characters of a kind replaced by others, in order."""
    step = lambda t, c: F.struct(F.concat(t["out"], F.when(c.rlike(kind), F.substr(t["left"], F.lit(1), F.lit(1))).otherwise(c)).alias("out"), F.when(c.rlike(kind), F.substr(t["left"], F.lit(2))).otherwise(t["left"]).alias("left"))
    return F.aggregate(_chars(s), F.struct(F.lit("").alias("out"), symbols.alias("left")), step)["out"]


def _numbers(digits: Column) -> Column:
    return F.transform(_chars(digits), lambda c: c.cast("long"))


def _repeat(radix: int, n: Column) -> Column:
    return F.array_repeat(F.lit(radix).cast("long"), n.cast("int"))


def _luhn_digit(digits: Column) -> Column:
    """The check digit behind these digits."""
    step = lambda t, c: F.struct(
        (t["sum"] + F.when(t["twice"], c * 2 - F.when(c > 4, 9).otherwise(0)).otherwise(c)).cast("long").alias("sum"), (~t["twice"]).alias("twice")
    )
    return F.pmod(-F.aggregate(F.reverse(_numbers(digits)), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(True).alias("twice")), step)["sum"], F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    """An IBAN's characters, the first four last, as a number modulo 97."""
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    add = lambda t, c: F.when(c.rlike("[0-9]"), (t * 10 + (F.ascii(c) - 48)) % 97).otherwise((t * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(_chars(turned), F.lit(0), add)


def _email(m: Column, key: str, undo: bool) -> Column:
    return F.concat(_permuted_chars(F.substring_index(m, "@", 1), "email", key, undo), F.regexp_extract(m, "(@.*)$", 1))


def _credential(m: Column, key: str, undo: bool) -> Column:
    head = F.regexp_extract(m, r"^(AKIA|ASIA|[A-Za-z_]+\s*[=:]\s*[\"']?)", 1)
    return _let(head, lambda h: F.concat(h, _permuted_chars(F.substr(m, F.length(h) + 1), "credential", key, undo)))


def _card(m: Column, key: str, undo: bool) -> Column:
    def valid(d: Column) -> Column:
        return d.rlike("^[2-6][0-9]{12,18}$") & (_luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1)))

    def new(d: Column) -> Column:
        # The first digit stays.
        own = F.substr(d, F.lit(2), F.length(d) - 2)
        return _let(F.concat(F.substr(d, F.lit(1), F.lit(1)), _joined(feistel(_numbers(own), _repeat(10, F.length(d) - 2), "card", key, undo))), lambda n: F.concat(n, _luhn_digit(n)))

    def part(groups: Column) -> Column:
        """Of the runs of whole groups that validate the one of most digits; of these the first."""
        n = F.size(groups)
        spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.struct(F.array_join(F.slice(groups, i, j - i + 1), "").alias("d"), i.alias("i"), j.alias("j")))))
        best = lambda t, x: F.when(valid(x["d"]) & (F.length(x["d"]) > F.length(F.coalesce(t["d"], F.lit("")))), x).otherwise(t)
        chosen = F.aggregate(spans, F.struct(F.lit(None).cast("string").alias("d"), F.lit(0).alias("i"), F.lit(0).alias("j")), best)
        at = lambda k: F.aggregate(F.slice(groups, F.lit(1), k), F.lit(0), lambda t, x: t + F.length(x)) + k  # noqa: E731  where the groups behind the k-th begin
        woven = lambda c: F.concat(F.substr(m, F.lit(1), at(c["i"] - 1)), _weave(F.substr(m, at(c["i"] - 1) + 1, at(c["j"]) - 1 - at(c["i"] - 1)), new(c["d"])), F.substr(m, at(c["j"])))
        return _let(chosen, lambda c: F.when(c["d"].isNotNull(), woven(c)))

    whole = _let(_digits(m), lambda d: F.when(valid(d), _weave(m, new(d))))
    return F.coalesce(whole, F.when(m.rlike("[ -]"), _let(F.split(m, "[ -]"), part)))


def _iban(m: Column, key: str, undo: bool) -> Column:
    def of(s: Column) -> Column:
        country = F.substr(s, F.lit(1), F.lit(2))
        check = lambda body: F.lpad((F.lit(98) - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
        new = _let(_permuted_chars(F.substr(s, F.lit(5)), "iban", key, undo), lambda body: _weave(m, F.concat(country, check(body), body), "[^ ]"))
        return F.when(F.length(s).between(15, 34) & (_mod97(s) == 1), new)

    return _let(F.regexp_replace(m, " ", ""), of)


def _ip(m: Column, key: str, undo: bool) -> Column:
    mapped = lambda o: F.when(F.forall(o, lambda x: x <= 255), F.array_join(feistel(o, _ints(256, 256, 256, 256), "ip", key, undo).cast("array<string>"), "."))
    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), mapped)


def _date_classes() -> list[list[int]]:
    """100 * month + day of the days of a common year, by class."""
    lengths = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    days = [(month, day) for month, n in enumerate(lengths, 1) for day in range(1, n + 1)]
    return [[100 * m + d for m, d in days if (m < 10) == low and first <= d <= last] for low in (True, False) for first, last in ((1, 9), (10, 12), (13, 31))]


def _date(m: Column, key: str, undo: bool) -> Column:
    """In the format it stands in: ISO, else day first, else month first."""
    classes = _date_classes()
    leap_years = [y for y in range(FIRST_YEAR, FIRST_YEAR + YEARS) if y % 4 == 0 and (y % 100 or y % 400 == 0)]

    def read(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        date = lambda y, mo, d: F.try_to_date(F.concat_ws("-", part(y), F.lpad(part(mo), 2, "0"), F.lpad(part(d), 2, "0")), "yyyy-MM-dd")
        order = F.when(m.contains("-"), F.when(date(0, 1, 2).isNotNull(), 0)).when(date(2, 1, 0).isNotNull(), 1).when(date(2, 0, 1).isNotNull(), 2)
        number = lambda iso, by_day, by_month: F.when(order == 0, part(iso)).when(order == 1, part(by_day)).when(order == 2, part(by_month)).cast("int")
        return F.struct(order.alias("order"), number(0, 2, 2).alias("y"), number(1, 1, 0).alias("m"), number(2, 0, 1).alias("d"), parts.alias("parts"))

    def mapped(w: Column) -> Column:
        late = F.when(w["d"] > 12, 2).when(w["d"] > 9, 1).otherwise(0) + F.when(w["m"] > 9, 3).otherwise(0)
        of = (100 * w["m"] + w["d"]).cast("long")
        own = F.when(of == 229, len(classes)).otherwise(late)
        slots = F.get(F.array(*[_ints(*days) for days in classes], _ints(*leap_years)), own)
        told = F.struct(own.alias("class"), (own == len(classes)).alias("leap"), slots.alias("slots"), of.alias("of"))
        known = w["order"].isNotNull() & w["y"].between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
        return F.when(known, _let(told, lambda c: _let(permuted(w, c), lambda x: shown(w, x))))

    def permuted(w: Column, c: Column) -> Column:
        """Of the leap day the year alone, of other days the place in their class and the year."""
        slot = (F.array_position(c["slots"], F.when(c["leap"], w["y"].cast("long")).otherwise(c["of"])) - 1).cast("long")
        year = F.when(c["leap"], 0).otherwise(w["y"] - FIRST_YEAR).cast("long")
        radices = F.array(F.size(c["slots"]).cast("long"), F.when(c["leap"], 1).otherwise(YEARS).cast("long"))
        new = feistel(F.array(slot, year), radices, F.concat(F.lit("date "), c["class"].cast("string")), key, undo)
        at = lambda n: F.get(c["slots"], F.get(n, F.lit(0)).cast("int"))
        return _let(new, lambda n: F.struct(F.when(c["leap"], at(n)).otherwise(F.get(n, F.lit(1)) + FIRST_YEAR).alias("y"), F.when(c["leap"], 229).otherwise(at(n)).cast("long").alias("of")))

    def shown(w: Column, x: Column) -> Column:
        width = lambda value, i: F.lpad(value.cast("string"), F.length(F.get(w["parts"], F.lit(i))), F.lit("0"))
        year, month, day, sign = x["y"], F.floor(x["of"] / 100), x["of"] % 100, F.regexp_extract(m, "([-/.])", 1)
        iso, by_day, by_month = (year, month, day), (day, month, year), (month, day, year)
        text = lambda values: F.concat_ws("", width(values[0], 0), sign, width(values[1], 1), sign, width(values[2], 2))
        return F.when(w["order"] == 0, text(iso)).when(w["order"] == 1, text(by_day)).otherwise(text(by_month))

    return _let(F.split(m, r"[-/.]"), lambda parts: _let(read(parts), mapped))


def _ssn(m: Column, key: str, undo: bool) -> Column:
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def of(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        new = feistel(F.array(area - 1 - (area > 666).cast("long"), group - 1, serial - 1), _ints(898, 99, 9999), "ssn", key, undo)
        # The 666th area number is not given out.
        return F.when(valid, _let(new, lambda n: F.concat_ws("-", pad(F.get(n, F.lit(0)) + 1 + (F.get(n, F.lit(0)) >= 665).cast("long"), 3), pad(F.get(n, F.lit(1)) + 1, 2), pad(F.get(n, F.lit(2)) + 1, 4))))

    return _let(F.transform(F.split(m, "-"), lambda x: x.cast("long")), of)


def _phone(m: Column, key: str, undo: bool, any_plan: bool = False) -> Column:
    """any_plan: a number with +1 that does not meet the numbering plan is mapped too. The first digits of area code and exchange
    stay 0 or 1, or 2 to 9, as they are, so numbers that meet the plan and those that do not are permuted apart."""

    def of(d: Column) -> Column:
        plus = m.startswith("+")
        code = F.when(~plus, "").when(d.startswith("1"), "1").otherwise(F.coalesce(F.nullif(F.regexp_extract(m, r"^\+(\d{1,3})(?=\D)", 1), F.lit("")), F.substr(d, F.lit(1), F.lit(2))))
        return _let(F.struct(d.alias("d"), code.alias("code"), F.substr(d, F.length(code) + 1).alias("own"), (~plus | (code == "1")).alias("american")), mapped)

    def mapped(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.lit(9))
        high = F.transform(at, lambda i: i.isin(0, 3) & (F.get(_numbers(w["own"]), i) >= 2))
        lead = F.transform(high, lambda x: F.when(x, 2).otherwise(0).cast("long"))
        radices = F.zip_with(at, high, lambda i, x: F.when(~i.isin(0, 3), 10).when(x, 8).otherwise(2).cast("long"))
        nanp = feistel(F.zip_with(_numbers(w["own"]), lead, lambda x, y: x - y), radices, "phone", key, undo)
        other = feistel(_numbers(w["own"]), _repeat(10, F.length(w["own"])), "phone", key, undo)
        weave = lambda new: _weave(m, F.concat(w["code"], _joined(new)))
        ten = w["own"].rlike(r"^[2-9]\d{2}[2-9]\d{6}$") | (F.lit(any_plan) & (w["code"] == "1") & (F.length(w["own"]) == 10))
        american = F.when(ten, weave(F.zip_with(nanp, lead, lambda x, y: x + y)))
        strict = w["american"] if not any_plan else w["american"] & ((w["code"] == "") | (F.length(w["own"]) == 10))
        return F.when(strict, american).when(F.length(w["d"]).between(8, 15) & (F.length(w["own"]) >= 4), weave(other))

    return _let(_digits(m), of)


KINDS = (("email", EMAIL, _email), ("credential", CREDENTIAL, _credential), ("iban", IBAN, _iban), ("ip", IPV4, _ip), ("date", DATE.replace("\\1", "[/.]"), _date), ("ssn", SSN, _ssn), ("phone", PHONE, _phone), ("card", CARD, _card))


def _one(m: Column, key: str, undo: bool, any_plan: bool = False) -> Column:
    """kind and pseudonym of a match; the match itself, without a kind, if it does not validate."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    found = F.coalesce(*[F.when(whole(pattern), F.struct(F.lit(kind).alias("kind"), maps(m, key, undo, *[any_plan] * (kind == "phone")).alias("out"))) for kind, pattern, maps in KINDS])
    return _let(found, lambda f: F.struct(F.when(f["out"].isNotNull(), f["kind"]).alias("kind"), F.coalesce(f["out"], m).alias("out")))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", undo: bool = False, any_plan: bool = False) -> DataFrame:
    """docs with the text's personal data replaced, and pii_kinds: the kind of each replacement, in order of the text.

    any_plan: numbers with +1 that do not meet the North American plan are replaced too; undo needs the same.
    """
    found = F.when(F.rlike(F.col(text), F.lit(PRESENT)), F.regexp_extract_all(F.col(text), F.lit(ANY), 0)).when(F.col(text).isNotNull(), F.array().cast("array<string>"))
    matches = docs.withColumn("__matches", found)
    some = F.size("__matches") > 0
    mapped = matches.withColumn("__mapped", F.when(some, F.transform("__matches", lambda m: _one(m, key, undo, any_plan))))
    changed = F.exists("__mapped", lambda x: x["kind"].isNotNull())
    pieces = F.zip_with(F.split(F.col(text), ANY, -1), "__mapped", lambda gap, x: F.concat(gap, F.coalesce(x["out"], F.lit(""))))
    new = F.when(F.coalesce(changed, F.lit(False)), F.array_join(pieces, "")).otherwise(F.col(text))
    kinds = F.coalesce(F.filter(F.transform("__mapped", lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    kept = [c for c in docs.columns if c.lower() != "pii_kinds"]
    return mapped.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in kept], kinds.alias("pii_kinds"))


__all__ = ["feistel", "pseudonymize"]
