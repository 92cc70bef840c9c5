"""Pseudonyms that keep the format, by keyed Feistel permutations; DataFrame and SQL functions only.

Found values are permuted within the values of their format, so the same value gets the same pseudonym in every
document, different values get different ones, and a card number stays one with a right check digit, an address
an address, a date a date:

  card    13 to 19 digits with a right Luhn digit, single or grouped by spaces or hyphens: all digits before it
          are permuted, then the Luhn digit is computed anew; separators stay. A run of groups is searched from left to
          right, at each group for a date, ssn or phone and else the longest card, so what stands next to one hides none
  phone   North American (area and exchange 200-999): the 6.4e9 numbers are permuted; international with "+":
          the digits after the first two
  ssn     three, two and four digits (no 000, 666, 9xx; no 00; no 0000): permuted among those
  ip      four numbers up to 255: permuted as 32 bits
  date    a true calendar date from 1900 to 2100: the days are permuted, the separators stay, and so does the order of the
          parts, but that a date with the month first (its day over 12 shows it) comes out day first where the new day is
          12 or less: kept, it would read as another day, and two values would share a pseudonym
  iban    of the length of its country, with right check digits: the account's digits are permuted and its letters
          shifted by a keyed hash of the digits, check digits computed anew
  email   name and domain are replaced by letters from a keyed hash under the reserved domain example.com
  secret  the value of password=, token=, api_key= and the like: every hex digit or letter from a keyed hash

Null texts stay null, empty ones empty; texts without a value stay as they are. Rows are never merged or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fresh

ROUNDS = 8
#: Where a session names its key. Whoever has the key can undo the pseudonyms, so the operator has none of its own.
KEY_CONF = "quarry.pii.key"
#: Dates start here; the days are permuted as DAYS[0] * DAYS[1] values.
FIRST_DAY, DAYS = "1900-01-01", (271, 270)

# Patterns, Java's. The order is that of the alternatives: the first that matches at a place counts.
_END = r"(?![\w])"
SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.\-]{6,}+"
EMAIL = r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])"
#: Countries by the length of their IBAN.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FO FK GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<!\w)(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}}" for n, c in IBANS.items()) + ")" + _END
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])"
DATE = r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?:(?![\w/-])|(?=T[0-9]{2}))"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
PHONE = r"(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![\w])|(?<![\w.-])(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![\w-])"
CARD = r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|-[0-9])"
#: All groups of digits up to the next other character; what is in it is found by _split.
RUN = r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,}+\w*+"
KINDS = {"secret": SECRET, "email": EMAIL, "iban": IBAN, "ip": IP, "date": DATE, "ssn": SSN, "run": RUN, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A cheap look before the full pattern.
HINT = r"@|[0-9]|(?i:passw|passwd|pwd|secret|token|key)"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _hash(key: str, *parts: Column) -> Column:
    """A keyed 60-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("bigint")


def feistel(x: Column, y: Column, a: Column, b: Column, kind: str, key: str) -> Column:
    """struct(x, y) permuted over 0 <= x < a, 0 <= y < b: by turns one half is shifted by a keyed hash of the other."""

    def step(s: Column, i: Column) -> Column:
        tweak = F.concat(F.lit(kind), a.cast("string"), F.lit("x"), b.cast("string"), F.lit("#"), i.cast("string"))
        return F.when(i % 2 == 0, F.struct(((s["x"] + _hash(key, tweak, s["y"].cast("string")) % a) % a).alias("x"), s["y"].alias("y"))).otherwise(
            F.struct(s["x"].alias("x"), ((s["y"] + _hash(key, tweak, s["x"].cast("string")) % b) % b).alias("y"))
        )

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _permuted(d: Column, kind: str, key: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    n = F.length(d)
    half = (n / 2).cast("int")

    def ten(k: Column) -> Column:
        return F.rpad(F.lit("1"), k + 1, "0").cast("bigint")

    whole = _let(feistel(F.substring(d, F.lit(1), half), F.substring(d, half + 1, n - half), ten(half), ten(n - half), kind, key), lambda s: F.concat(F.lpad(s["x"].cast("string"), half, "0"), F.lpad(s["y"].cast("string"), n - half, "0")))
    return F.when((n < 2) | (n > 36), d).otherwise(whole)


def _fill(form: Column, digits: Column) -> Column:
    """form with its digits replaced by those of `digits`, in order."""
    chars = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.substring(form, i, F.lit(1)))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))

    def put(s: Column, c: Column) -> Column:
        isd = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["s"], F.when(isd, F.substring(digits, s["n"] + 1, F.lit(1))).otherwise(c)).alias("s"), (s["n"] + isd.cast("int")).alias("n"))

    return F.aggregate(chars, start, put, lambda s: s["s"])


def _luhn(d: Column) -> Column:
    """The check digit for the digits before it."""
    n = F.length(d)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(d, i, F.lit(1)).cast("int").alias("v"), ((n - i) % 2).alias("odd")))
    total = F.aggregate(F.transform(at, lambda e: F.when(e["odd"] == 0, F.when(e["v"] > 4, 2 * e["v"] - 9).otherwise(2 * e["v"])).otherwise(e["v"])), F.lit(0), lambda s, x: s + x)
    return ((10 - total % 10) % 10).cast("string")


def luhn_ok(d: Column) -> Column:
    return _luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1))


def _card(m: Column, key: str) -> Column:
    body = _let(_digits(m), lambda d: _permuted(F.substring(d, F.lit(1), F.length(d) - 1), "card", key))
    return _fill(m, _let(body, lambda p: F.concat(p, _luhn(p))))


def _ip(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    two = _let(p, lambda o: feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), "ip", key))
    part = lambda v: F.concat(F.floor(v / 256).cast("string"), F.lit("."), (v % 256).cast("string"))
    return _let(two, lambda s: F.concat(part(s["x"]), F.lit("."), part(s["y"])))


def _nanp(d: Column, key: str) -> Column:
    """Ten digits, area and exchange 200-999."""
    area, rest = F.substring(d, 1, 3).cast("bigint") - 200, F.substring(d, 4, 3).cast("bigint") - 200
    line = F.substring(d, 7, 4).cast("bigint")
    size = F.lit(80_000).cast("bigint")
    n = (area * 800 + rest) * 10_000 + line
    out = lambda v: F.concat((F.floor(v / 8_000_000) + 200).cast("string"), (F.floor(v / 10_000) % 800 + 200).cast("string"), F.lpad((v % 10_000).cast("string"), 4, "0"))
    return _let(_let(n, lambda v: feistel(F.floor(v / 80_000), v % 80_000, size, size, "nanp", key)), lambda s: _let(s["x"] * 80_000 + s["y"], out))


def _phone(m: Column, key: str) -> Column:
    def by(d: Column) -> Column:
        ten, us = F.right(d, F.lit(10)), d.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$")
        lead = F.substring(d, F.lit(1), F.length(d) - 10)
        other = F.concat(F.substring(d, 1, 2), _permuted(F.substring(d, F.lit(3), F.length(d)), "phone", key))
        return F.when(us, F.concat(lead, _nanp(ten, key))).otherwise(other)

    return _fill(m, _let(_let(_digits(m), by), lambda d: d))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666 (898), groups 01-99, serials 0001-9999: 898 * 99 by 9999 values."""
    area, group, serial = F.substring(m, 1, 3).cast("bigint"), F.substring(m, 5, 2).cast("bigint"), F.substring(m, 8, 4).cast("bigint")
    at = F.when(area > 666, area - 2).otherwise(area - 1)
    out = lambda s: F.concat(
        F.lpad(_let(F.floor(s["x"] / 99), lambda a: F.when(a >= 665, a + 2).otherwise(a + 1)).cast("string"), 3, "0"), F.lit("-"), F.lpad((s["x"] % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s["y"] + 1).cast("string"), 4, "0")
    )
    return _let(feistel(at * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), "ssn", key), out)


def _parts(m: Column) -> Column:
    """struct(y, mo, d, first): a date's parts; first is which of them comes first: y, d or m."""
    p = F.transform(F.split(m, "[./-]"), lambda x: x.cast("int"))

    def by(o: Column) -> Column:
        ymd = F.length(F.regexp_extract(m, "^[0-9]+", 0)) == 4
        month_first = ~ymd & m.contains("/") & (o[1] > 12)
        return F.struct(
            F.when(ymd, o[0]).otherwise(o[2]).alias("y"), F.when(month_first, o[0]).otherwise(o[1]).alias("mo"), F.when(ymd, o[2]).when(month_first, o[1]).otherwise(o[0]).alias("d"), F.when(ymd, "y").when(month_first, "m").otherwise("d").alias("first")
        )

    return _let(p, by)


def _day(m: Column) -> Column:
    """Days since FIRST_DAY; null where it is no true date in range."""
    text = _let(_parts(m), lambda p: F.format_string("%04d-%02d-%02d", p["y"], p["mo"], p["d"]))
    day = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), day)


def _date(m: Column, key: str) -> Column:
    a, b = (F.lit(n).cast("bigint") for n in DAYS)
    sep = F.regexp_extract(m, "[./-]", 0)

    def out(s: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["x"] * DAYS[1] + s["y"]).cast("int"))
        y, mo, d = F.date_format(new, "yyyy"), F.date_format(new, "MM"), F.date_format(new, "dd")
        # Month first is kept only where the new day shows it; else the other order is as good.
        return F.when(_parts(m)["first"] == "y", F.concat(y, sep, mo, sep, d)).when((_parts(m)["first"] == "m") & (d.cast("int") > 12), F.concat(mo, sep, d, sep, y)).otherwise(F.concat(d, sep, mo, sep, y))

    return _let(_let(_day(m), lambda n: feistel(F.floor(n / DAYS[1]), n % DAYS[1], a, b, "date", key)), out)


def _mod97(digits: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int"))
    return F.aggregate(each, F.lit(0), lambda s, x: (s * 10 + x) % 97)


def _country(m: Column) -> Column:
    return F.concat((F.ascii(F.substring(m, 1, 1)) - 55).cast("string"), (F.ascii(F.substring(m, 2, 1)) - 55).cast("string"))


def _numeric(s: Column) -> Column:
    """Letters as two digits, A as 10."""
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def _iban_ok(m: Column) -> Column:
    return _let(F.replace(m, F.lit(" "), F.lit("")), lambda s: _mod97(F.concat(_numeric(F.substring(s, F.lit(5), F.length(s))), _country(m), F.substring(s, 3, 2)))) == 1


def _iban(m: Column, key: str) -> Column:
    rest = F.substring(m, F.lit(5), F.length(m))

    def shifted(d: Column) -> Column:
        """The letters of the rest; the digits come back from the permuted ones, so the shifts can be undone."""
        place = lambda i: F.length(F.replace(F.substring(rest, F.lit(1), i), F.lit(" "), F.lit(""))).cast("string")  # noqa: E731  spaces don't count
        new = lambda c, i: F.chr(65 + (F.ascii(c) - 65 + _hash(key, F.lit("iban"), d, place(i)) % 26) % 26)
        return F.array_join(F.transform(F.split(rest, ""), lambda c, i: F.when(c.rlike("[A-Z]"), new(c, i)).otherwise(c)), "")

    body = _let(_digits(rest), lambda d: _fill(shifted(d), _permuted(d, "iban", key)))
    check = lambda p: F.lpad((98 - _mod97(F.concat(_numeric(F.replace(p, F.lit(" "), F.lit(""))), _country(m), F.lit("00")))).cast("string"), 2, "0")
    return _let(body, lambda p: F.concat(F.substring(m, 1, 2), check(p), p))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.com"))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"(?s)^(.*?[=:]\s*[\"']?)", 1)
    value = F.substring(m, F.length(name) + 1, F.length(m))

    def stream(h: Column) -> Column:
        """As long as the value: its keyed hash, then hashes of that and the chunk's number."""
        more = F.transform(F.sequence(F.lit(0), F.floor((F.length(value) - 1) / 64).cast("int")), lambda i: F.when(i == 0, h).otherwise(F.sha2(F.concat_ws("|", F.lit(key), h, i.cast("string")), 256)))
        return F.substring(F.array_join(more, ""), F.lit(1), F.length(value))

    return F.concat(name, _let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), stream))


def kind_of(m: Column) -> Column:
    """The kind of a match; null where the value isn't valid for its pattern."""
    whole = lambda p: m.rlike(f"^(?:{p})$")  # noqa: E731  lookarounds hold at the ends
    d = _digits(m)
    return (
        F.when(whole(SECRET), "secret")
        .when(whole(EMAIL), "email")
        .when(whole(IBAN) & _iban_ok(m), "iban")
        .when(whole(IP), "ip")
        .when(whole(DATE) & _day(m).isNotNull(), "date")
        .when(whole(SSN) & ~m.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn")
        .when(whole(CARD) & luhn_ok(d), "card")
        .when(whole(PHONE) & F.length(d).between(7, 15), "phone")
    )


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, text) of one match."""

    def by(k: Column) -> Column:
        text = F.when(k == "secret", _secret(m, key)).when(k == "email", _email(m, key)).when(k == "iban", _iban(m, key)).when(k == "ip", _ip(m, key))
        text = text.when(k == "date", _date(m, key)).when(k == "ssn", _ssn(m, key)).when(k == "card", _card(m, key)).when(k == "phone", _phone(m, key)).otherwise(m)
        return F.struct(k.alias("kind"), text.alias("text"))

    return _let(kind_of(m), by)


def _split(m: Column) -> Column:
    """A match as pieces: each value of a run of digit groups, and what is between; other matches whole."""

    def values(t: Column) -> Column:
        n = F.size(t)

        def ends(i: Column) -> Column:
            """Where a value from piece i ends, the best first: date, ssn or phone, else the longest card; pieces of odd place separate."""

            def ok(j: Column) -> Column:
                free = F.coalesce(F.get(t, i - 1), F.lit("")).isin("", " ") | (i == 0)
                free &= (j == n - 1) | (F.get(t, j + 1) != "-")
                sub = F.array_join(F.slice(t, i + 1, j - i + 1), "")
                known = lambda v: F.when(v.rlike(f"^(?:{SSN}|{DATE}|{PHONE})$"), kind_of(v)).when(v.rlike(f"^(?:{CARD})$") & luhn_ok(_digits(v)), F.lit("card"))
                return F.when(free, _let(sub, known))

            last = F.least(i + 36, n - 1)
            return F.array_sort(F.filter(F.transform(F.sequence(i, last, F.lit(2)), lambda j: F.struct((ok(j) == "card").alias("card"), (-j).alias("j"))), lambda s: s["card"].isNotNull()))

        def step(s: Column, i: Column) -> Column:
            def by(e: Column) -> Column:
                to = -e[0]["j"] + 1
                got = F.array_compact(F.array(F.when(i > s["at"], F.array_join(F.slice(t, s["at"] + 1, i - s["at"]), "")), F.array_join(F.slice(t, i + 1, to - i), "")))
                return F.when(F.size(e) > 0, F.struct(to.cast("int").alias("at"), F.concat(s["out"], got).alias("out"))).otherwise(s)

            return F.when(i < s["at"], s).otherwise(_let(ends(i), by))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        rest = lambda s: F.when(s["at"] < n, F.concat(s["out"], F.array(F.array_join(F.slice(t, s["at"] + 1, n - s["at"]), "")))).otherwise(s["out"])
        return F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(2)), start, step, rest)

    return F.when(m.rlike(f"^(?:{RUN})$") & ~m.rlike(f"^(?:{DATE}|{SSN})$"), _let(F.regexp_extract_all(m, F.lit("[ -]|[^ -]+"), F.lit(0)), values)).otherwise(F.array(m))


def key_of(spark: SparkSession, otherwise: str | None = None) -> str:
    """The session's key (conf quarry.pii.key); without one `otherwise`, for tables that hold no real person, or an error."""
    key = spark.conf.get(KEY_CONF, otherwise) if otherwise is not None else spark.conf.get(KEY_CONF, "")
    if not key:
        raise ValueError(f"set {KEY_CONF}")
    return key


def pseudonymized(df: DataFrame, text: str = "text", out: str = "text", found: str = "pii_kinds", key: str | None = None) -> DataFrame:
    """df with `out` (the text with pseudonyms) and `found` (the kind of each replaced value, in order). The key is the
    session's where none is given; an existing column `out` or `found` is replaced, no other."""
    key = key or key_of(df.sparkSession)
    t = F.col(text)
    hit = F.regexp_count(t, F.lit(ANY)) > 0
    new = F.transform(F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1)), lambda m: F.transform(_split(m), lambda v: pseudonym(v, key)))
    held = fresh([*df.columns, out, found], "__new")
    named = df.withColumn(held, F.when(t.rlike(HINT) & hit, new))
    n = F.col(held)
    # A value that isn't valid keeps its own text, so both lists stay in step.
    joined = F.array_join(F.flatten(F.zip_with(F.split(t, ANY, -1), F.transform(n, lambda x: F.array_join(x["text"], "")), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    kinds = F.filter(F.transform(F.flatten(n), lambda x: x["kind"]), lambda k: k.isNotNull())
    return named.withColumns({out: F.when(n.isNull(), t).otherwise(joined), found: F.coalesce(kinds, F.array().cast("array<string>"))}).drop(held)
