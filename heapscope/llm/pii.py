"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame operations only.

Method: candidates are found by one pattern and validated by kind (Luhn for payment cards, remainder 97 for account numbers, ranges
for social security numbers and addresses, the calendar for dates). A valid value is reduced to its letters and digits and permuted by a
keyed Feistel network among the values of that format: letters stay letters, digits digits, check digits are made anew, dates stay
dates (of the years 1 to 9999, permuted within eras of 73,000 days). The result is written in the spelling that was found: same
separators, same cases, same order of day and month. The permutation depends on the key and the kind's own tweak only, so equal values have
equal pseudonyms in all documents and spellings. What fails validation stays as it is. The text between the values is not touched.

The network has two halves with moduli a and b (the numbers of left and right halves of that format; one character is split by
its number) and ROUNDS rounds that add, in turn, SHA-256 of key, tweak, round and the other half.

The key is an argument. The registered query and the pipeline take it from the session's setting KEY_SETTING; without one they use TEST_KEY,
which is public and for test tables only.

Edge cases: a null text stays null and an empty one empty; rows are independent, so ties and repeated rows need no rule; a
text without values is unchanged; a text of any length is done as a whole, in one row; columns other than the text are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

KEY_SETTING, TEST_KEY = "spark.heapscope.pii.key", "public key of the test tables"

ROUNDS = 10
#: Characters of a value permuted together: two halves of 12 letters stay below 2^63.
CHUNK = 24
#: Dates are permuted among DAYS_HIGH * DAYS_LOW days counted from EPOCH, about 200 years; later and earlier ones in eras of that length.
DAYS_HIGH, DAYS_LOW, EPOCH = 250, 292, "1900-01-01"
#: The first and the last era have only days of the years 1 to 9999: era, its first day, high, low.
SHORT_ERAS = [(-10, 36_405, 65, 563), (40, 0, 64, 601)]

#: Lengths of account numbers by country code, where they are fixed.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "") + "(?![A-Za-z0-9])"


#: A number of its country's length where there is one, so that it takes nothing of the words after it; else any.
_IBAN = "|".join([*(_account(n, c) for n, c in IBAN_LENGTHS.items()), r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"])
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})",
    "ip": rf"(?<![A-Za-z0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![A-Za-z0-9]|[./-][0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "card": r"(?<![A-Za-z0-9.-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![A-Za-z0-9]|[.-][0-9])",
    "phone": r"(?<![A-Za-z0-9+(.-])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9]|[.-][0-9])",
}
#: Country calling codes: one digit, two digits, else up to three.
COUNTRY = r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})[ .-]?)?"
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def network(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """struct(l, r): the permutation of the pairs (left < a, right < b)."""

    def prf(i: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i, x), 256), 1, 15), 16, 10).cast("bigint")

    def step(state: Column, i: Column) -> Column:
        l, r = state["l"], state["r"]
        return F.when(i % 2 == 1, F.struct(((l + prf(i, r) % a) % a).alias("l"), r.alias("r"))).otherwise(F.struct(l.alias("l"), ((r + prf(i, l) % b) % b).alias("r")))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).otherwise(26).cast("bigint")


def base(c: Column) -> Column:
    return F.when(c.between("0", "9"), 48).otherwise(97).cast("bigint")


def chars(s: Column) -> Column:
    return F.transform(F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(s, i, F.lit(1)))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def number(cs: Column) -> Column:
    return F.aggregate(cs, F.lit(0).cast("bigint"), lambda n, c: n * radix(c) + F.ascii(c) - base(c))


def count(cs: Column) -> Column:
    return F.aggregate(cs, F.lit(1).cast("bigint"), lambda n, c: n * radix(c))


def spelled(n: Column, like: Column) -> Column:
    """The n-th string of the format of `like`."""
    start = F.struct(n.alias("n"), F.lit("").alias("s"))
    step = lambda t, c: F.struct(div(t["n"], radix(c)).alias("n"), F.concat(F.char(base(c) + t["n"] % radix(c)), t["s"]).alias("s"))
    return F.aggregate(F.reverse(like), start, step, lambda t: t["s"])


def permuted(s: Column, key: str, kind: Column | str) -> Column:
    """s, of digits and lower-case letters, permuted among the strings of its format, CHUNK characters at a time."""
    shape = F.regexp_replace(F.regexp_replace(s, "[0-9]", "9"), "[a-z]", "a")
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def chunk(i: Column) -> Column:
        tweak = F.concat_ws("|", kind, shape, i)

        def halves(cs: Column) -> Column:
            half = F.floor(F.size(cs) / 2).cast("int")
            left, right = F.slice(cs, F.lit(1), half), F.slice(cs, half + 1, F.size(cs) - half)
            several = network(number(left), number(right), count(left), count(right), key, tweak)
            first = F.slice(cs, F.lit(1), F.lit(1))
            fives = div(radix(F.element_at(cs, 1)), F.lit(2).cast("bigint"))  # a character's number is one of two halves of 5 or 13
            single = network(div(number(first), fives), number(first) % fives, F.lit(2).cast("bigint"), fives, key, tweak)
            return F.when(half > 0, let(several, lambda x: F.concat(spelled(x["l"], left), spelled(x["r"], right)))).otherwise(let(single, lambda x: spelled(x["l"] * fives + x["r"], first)))

        return let(chars(F.substring(s, i * CHUNK + 1, F.lit(CHUNK))), halves)

    chunks = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / CHUNK).cast("int"))
    return F.when(F.length(s) > 0, F.array_join(F.transform(chunks, chunk), "")).otherwise(s)


def compact(s: Column) -> Column:
    """The letters and digits of s, in lower case."""
    return F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", ""))


def respelled(new: Column, like: Column) -> Column:
    """The letters and digits of `new` in the places and cases of those of `like`."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("s"))

    def step(t: Column, c: Column) -> Column:
        mark = F.substring(new, t["i"], F.lit(1))
        next_char = F.when(c.rlike("^[A-Z]$"), F.upper(mark)).when(c.rlike("^[a-z0-9]$"), mark).otherwise(c)
        return F.struct((t["i"] + F.when(c.rlike("^[A-Za-z0-9]$"), 1).otherwise(0)).alias("i"), F.concat(t["s"], next_char).alias("s"))

    return F.aggregate(chars(like), start, step, lambda t: t["s"])


def part(s: Column, start: int, length: int | None = None) -> Column:
    return F.substring(s, F.lit(start), F.lit(length) if length is not None else F.length(s))


def email(m: Column, key: str) -> Column:
    """Another name at the same domain; names at each domain have their own permutation."""
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    places = F.regexp_replace(name, "[A-Za-z0-9]", "a")
    made = permuted(compact(name), key, F.concat_ws("|", F.lit("email"), places, F.lower(domain)))
    return F.when(compact(name) != "", F.concat(let(made, lambda p: respelled(p, name)), F.lit("@"), domain))


def remainder97(s: Column) -> Column:
    return F.aggregate(chars(s), F.lit(0), lambda n, c: F.when(c.between("0", "9"), n * 10 + F.ascii(c) - 48).otherwise(n * 100 + F.ascii(c) - 55) % 97)


def iban(m: Column, key: str) -> Column:
    """The longest reading of m that is valid; the groups after it stay."""
    groups = F.split(m, " ")
    readings = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))

    def valid(reading: Column) -> Column:
        plain = F.regexp_replace(reading, " ", "")
        return F.length(plain).between(15, 34) & (remainder97(F.concat(part(plain, 5), part(plain, 1, 4))) == 1)

    def made(reading: Column) -> Column:
        country = part(m, 1, 2)

        def checked(account: Column) -> Column:
            check = 98 - remainder97(F.concat(F.upper(account), country, F.lit("00")))
            return respelled(F.concat(F.lower(country), F.lpad(check.cast("string"), 2, "0"), account), reading)

        other = permuted(part(compact(reading), 5), key, F.concat(F.lit("iban|"), country))
        return F.when(reading.isNotNull(), F.concat(let(other, checked), F.substring(m, F.length(reading) + 1, F.length(m))))

    return let(F.get(F.filter(readings, valid), F.lit(0)), made)


def ip(m: Column, key: str) -> Column:
    octet = [F.split(m, r"\.")[i].cast("bigint") for i in range(4)]
    side = F.lit(65536).cast("bigint")
    made = network(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], side, side, key, F.lit("ip"))
    byte = F.lit(256).cast("bigint")
    return let(made, lambda x: F.concat_ws(".", div(x["l"], byte), x["l"] % 256, div(x["r"], byte), x["r"] % 256))


def other_day(days: Column, key: str) -> Column:
    """The date for a number of days since EPOCH, permuted within its era."""
    era_days = DAYS_HIGH * DAYS_LOW
    era = F.floor(days / era_days).cast("bigint")

    def of_era(at: int, usual: int) -> Column:
        out = F.lit(usual)
        for short in SHORT_ERAS:
            out = F.when(era == short[0], short[at]).otherwise(out)
        return out.cast("bigint")

    first, high, low = of_era(1, 0), of_era(2, DAYS_HIGH), of_era(3, DAYS_LOW)
    index = F.pmod(days, F.lit(era_days)) - first
    made = network(div(index, low), index % low, high, low, key, F.concat_ws("|", F.lit("date"), era))
    return let(made, lambda x: F.date_add(F.lit(EPOCH).cast("date"), (era * era_days + first + x["l"] * low + x["r"]).cast("int")))


def date(m: Column, key: str) -> Column:
    formats = {r"^[0-9]{4}-": ("yyyy-MM-dd",), r"^[0-9]{2}/": ("dd/MM/yyyy", "MM/dd/yyyy"), r"^[0-9]{2}\.": ("dd.MM.yyyy",)}
    out = F.lit(None).cast("string")
    for start, patterns in formats.items():
        for pattern in reversed(patterns):  # the first that the calendar allows
            days = F.datediff(F.try_to_date(m, pattern), F.lit(EPOCH).cast("date")).cast("bigint")
            out = F.when(m.rlike(start) & (F.try_to_date(m, pattern) >= F.lit("0001-01-01").cast("date")), F.date_format(other_day(days, key), pattern)).otherwise(out)
    return out


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (part(m, 1, 3).cast("bigint"), part(m, 5, 2).cast("bigint"), part(m, 8, 4).cast("bigint"))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    areas, rest, serials = F.lit(898).cast("bigint"), F.lit(99 * 9999).cast("bigint"), F.lit(9999).cast("bigint")
    made = network(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, areas, rest, key, F.lit("ssn"))

    def text(x: Column) -> Column:
        a = F.when(x["l"] >= 665, x["l"] + 2).otherwise(x["l"] + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((div(x["r"], serials) + 1).cast("string"), 2, "0"), F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, let(made, text))


def card(m: Column, key: str) -> Column:
    def checked(payload: Column) -> Column:
        right = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(payload, d)))
        return respelled(F.concat(payload, F.element_at(right, 1)), m)

    digits = compact(m)
    return F.when(F.call_function("luhn_check", digits), let(permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card"), checked))


def phone(m: Column, key: str) -> Column:
    """The country code stays; the number without it is permuted, whether the code is there or not."""
    country = F.regexp_extract(m, COUNTRY, 0)
    national = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, let(permuted(compact(national), key, "phone"), lambda p: respelled(p, national)))


KINDS = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a candidate, null if it is not valid."""
    out = F.lit(None).cast("string")
    for kind, make in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), make(m, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count_as: str | None = None) -> DataFrame:
    """docs with the values in `text` replaced under the key, and a column with their number if `count_as` names one."""
    if not key:
        raise ValueError("pseudonyms need a key")
    whole = F.col(f"`{text}`")
    found_as, made_as = fresh([*docs.columns, *([count_as] if count_as else [])], "found", "made")
    found = docs.withColumn(found_as, F.when(whole.rlike("[0-9@]"), F.regexp_extract_all(whole, F.lit(PATTERN), F.lit(0))))
    made = found.withColumn(made_as, F.transform(found_as, lambda m: pseudonym(m, key)))
    between = F.split(whole, PATTERN, -1)
    values = F.zip_with(found_as, made_as, lambda m, p: F.coalesce(p, m))
    replaced = F.array_join(F.flatten(F.zip_with(between, values, lambda t, v: F.array(t, F.coalesce(v, F.lit(""))))), "")
    done = F.when(F.size(F.coalesce(found_as, F.array().cast("array<string>"))) > 0, replaced).otherwise(whole)
    chosen = [done.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if count_as:
        chosen.append(F.coalesce(F.size(F.filter(made_as, lambda p: p.isNotNull())), F.lit(0)).alias(count_as))
    return made.select(*chosen)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or TEST_KEY


def op5_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_values."""
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark), count_as="n_values")
