import datetime
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from heapscope.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def done(docs, texts, **options):
    rows = pii.pseudonymised(docs(list(enumerate(texts))), **{"key": "k", "count_as": "n", **options}).collect()
    return {r["doc_id"]: (r["text"], r["n"]) for r in rows}


def test_formats_are_kept_and_values_linked(docs):
    a = "x und.34@mail7.example.com, +1 (017) 555-7713 and 4041894974608795 4845168114407329 from 97.51.17.173."
    b = "born 1984-02-29 or 31/12/1999, 13.05.2001; 123-45-6789; DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432"
    got = done(docs, [a, b, "again: 4041894974608795"])
    assert got[0][1] == 5 and got[1][1] == 6 and got[2][1] == 1
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[0-9]", "9", t))
    ip = r"\d+\.\d+\.\d+\.\d+"
    assert shape(re.sub(ip, "", got[0][0])) == shape(re.sub(ip, "", a))
    assert shape(got[1][0]).replace("A", "") == shape(got[1][0]).replace("A", "") and len(got[1][0]) == len(b)
    cards = re.findall(r"\d{16}", got[0][0])
    assert len(cards) == 2 and all(map(luhn, cards)) and cards[0] in got[2][0]
    assert not set(cards) & {"4041894974608795", "4845168114407329"} and "555-7713" not in got[0][0] and "97.51.17.173" not in got[0][0]
    for account in (re.search(r"DE\d\d(?: \d{4}){4} \d\d", got[1][0])[0], re.search(r"GB\d\d[A-Z]{4}\d{14}", got[1][0])[0]):
        compact = account.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def test_invalid_values_and_other_text_stay(docs):
    texts = ["1234567812345678 2001-13-45 666-12-1234 999.1.1.1", "version 4.0. of 2.0., see 1.2.3", "no digits at all", "", None, "é 𝄞 mail @ home"]
    got = done(docs, texts)
    assert [got[i] for i in range(len(texts))] == [(t, 0) for t in texts]


def test_permutations_are_one_to_one(spark):
    three = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert three.select(pii.permuted(F.col("v"), "k", "t").alias("p")).distinct().count() == 1000
    day = F.date_format(F.date_add(F.lit(pii.EPOCH).cast("date"), (F.col("id") * 7).cast("int")), "yyyy-MM-dd")
    days = spark.range(5000).select(pii.date(day, "k").alias("p"))
    assert days.distinct().count() == 5000 and days.where("p rlike '^(19|20)[0-9]{2}-(0[1-9]|1[0-2])-[0-3][0-9]$'").count() == 5000
    numbers = spark.range(2000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 600 + 1, F.col("id") % 99 + 1, F.col("id") + 1).alias("v"))
    made = numbers.select(pii.ssn(F.col("v"), "k").alias("p"))
    assert made.distinct().count() == 2000 and made.where("p rlike '^(000|666|9..)|-00-|-0000$'").count() == 0


def test_keys_long_values_and_columns(docs, spark):
    text = "a" * 70 + "." + "b1" * 20 + "@x.org"
    first, second = done(docs, [text])[0], done(docs, [text], key="other")[0]
    assert first[1] == 1 and first[0] != text and first[0] != second[0] and len(first[0]) == len(text)
    df = docs([(1, "4041894974608795")]).withColumn("found", F.lit(1)).withColumn("Made", F.lit("v")).withColumn("n.x", F.lit(2))
    out = pii.pseudonymised(df, "k", count_as="made_")
    assert out.columns == [*df.columns, "made_"] and tuple(out.first()[5:]) == (1, "v", 2, 1)
    assert pii.pseudonymised(docs([]), "k").count() == 0
    for none in ("", None):
        with pytest.raises(ValueError):
            pii.pseudonymised(df, none)


def test_equal_values_are_linked_across_spellings(docs):
    same = [
        ["4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795"],
        ["1984-02-29", "29.02.1984", "29/02/1984", "02/29/1984"],
        ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"],
        ["+1 (415) 555-7713", "+1 415 555 7713", "+14155557713", "415-555-7713"],
        ["x.Und34@Mail.example.com", "X.und34@mail.example.com"],
    ]
    flat = [v for vs in same for v in vs]
    got = done(docs, flat)
    assert all(got[i][1] == 1 and got[i][0] != v for i, v in enumerate(flat)), got
    out = {v: got[i][0] for i, v in enumerate(flat)}
    plain = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    for vs in (same[0], same[2], same[4]):
        assert len({plain(out[v]) for v in vs}) == 1
    assert len({plain(out[v])[-10:] for v in same[3]}) == 1 and out["+14155557713"].startswith("+1")
    y, m, d = out["1984-02-29"].split("-")
    assert out["29.02.1984"] == f"{d}.{m}.{y}" and out["29/02/1984"] == f"{d}/{m}/{y}" and out["02/29/1984"] == f"{m}/{d}/{y}"


def feistel(n, a, b, key, tweak):
    """The network written again, on plain integers."""
    left, right = divmod(n, b)
    prf = lambda *x: int(hashlib.sha256("|".join(map(str, (key, tweak, *x))).encode()).hexdigest()[:15], 16)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + prf(i, right) % a) % a
        else:
            right = (right + prf(i, left) % b) % b
    return left * b + right


def string_feistel(s, key, kind):
    shape, out = re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)), ""
    radix = lambda t: math.prod(10 if c.isdigit() else 26 for c in t)
    for i in range(0, len(s), pii.CHUNK):
        part = s[i : i + pii.CHUNK]
        n = 0
        for c in part:
            n = n * radix(c) + (int(c) if c.isdigit() else ord(c) - 97)
        b = radix(part) // 2 if len(part) == 1 else radix(part[len(part) // 2 :])
        n, made = feistel(n, radix(part) // b, b, key, f"{kind}|{shape}|{i // pii.CHUNK}"), ""
        for c in reversed(part):
            n, x = divmod(n, radix(c))
            made = (str(x) if c.isdigit() else chr(97 + x)) + made
        out += made
    return out


def test_equals_a_network_on_plain_integers(docs, spark):
    rng = random.Random(3)
    names = ["a", "7", "z", *("".join(rng.choices("abcxyz0189", k=rng.randint(1, 60))) for _ in range(40))]
    cards = [p + next(d for d in "0123456789" if luhn(p + d)) for p in ("".join(rng.choices("0123456789", k=n)) for n in (12, 14, 15, 18))]
    addresses = [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(10)]
    days = [datetime.date(rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)) for _ in range(20)]
    got = done(docs, [*(f"{n}@x.org" for n in names), *cards, *addresses, *map(str, days)])
    want = [string_feistel(n, "k", f"email|{'a' * len(n)}|x.org") + "@x.org" for n in names]
    for c in cards:
        p = string_feistel(c[:-1], "k", "card")
        want.append(p + next(d for d in "0123456789" if luhn(p + d)))
    for a in addresses:
        n = feistel(int.from_bytes(bytes(map(int, a.split(".")))), 65536, 65536, "k", "ip")
        want.append(".".join(map(str, n.to_bytes(4))))
    zero = datetime.date.fromisoformat(pii.EPOCH)
    for d in days:
        want.append(str(zero + datetime.timedelta(feistel((d - zero).days, pii.DAYS_HIGH, pii.DAYS_LOW, "k", "date|0"))))
    assert [got[i][0] for i in range(len(want))] == want
    letters = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyz"], "v string").select(pii.permuted(F.col("v"), "k", "t").alias("p"), "v").collect()
    assert len({r["p"] for r in letters}) == 26 and len({(ord(r["p"]) - ord(r["v"])) % 26 for r in letters}) > 5  # no shift


def test_very_long_text(docs):
    filler = "words and words " * 60_000
    got = done(docs, [f"{filler}4041894974608795 {filler}"])[0]
    assert got[1] == 1 and got[0].startswith(filler) and got[0].endswith(" " + filler) and "4041894974608795" not in got[0]


def test_accounts_before_upper_case_words_and_numbers(docs):
    accounts = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT611904300234573201", "AT61 1904 3002 3457 3201", "PL61 1090 1014 0000 0712 1981 2874", "NO93 8601 1117 947"]
    unlisted = "ZZ12 1904 3002 3457 3201"
    assert int("".join(str(int(c, 36)) for c in (unlisted[4:] + unlisted[:4]).replace(" ", ""))) % 97 == 1
    after = [" EUR 500", " BIC", " PAID", " 2024", " DE89 3704 0044 0532 0130 00", "."]
    texts = [a + b for a in [*accounts, unlisted] for b in after]
    got = done(docs, texts)
    alone = {a: t for a, (t, _) in zip([*accounts, unlisted], (done(docs, [*accounts, unlisted])[i] for i in range(7)), strict=True)}
    for i, text in enumerate(texts):
        a, b = [*accounts, unlisted][i // len(after)], after[i % len(after)]
        assert alone[a] != a and got[i][0].startswith(alone[a]), text
        if not b.startswith(" DE"):
            assert got[i] == (alone[a] + b, 1)
        elif a != unlisted:
            assert got[i][1] == 2 and "0532" not in got[i][0]


def test_dates_of_all_eras(docs, spark):
    texts = ["1899-12-31", "14.03.1879", "2100-01-01", "0001-01-01", "31.12.9999", "31/12/1492"]
    got = done(docs, texts)
    shape = lambda t: re.sub("[0-9]", "9", t)
    for i, text in enumerate(texts):
        assert got[i][1] == 1 and got[i][0] != text and shape(got[i][0]) == shape(text)
    for start, n in (("0001-01-01", 37_000), ("9894-01-01", 38_700)):  # a short era whole, and the edge of the one beside it
        day = F.date_format(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
        days = spark.range(n).select(pii.date(day, "k").alias("p"))
        assert days.distinct().count() == n and days.where("p rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' and p between '0001-01-01' and '9999-12-31'").count() == n
    assert done(docs, ["0000-01-01 2023-02-29"])[0][1] == 0
