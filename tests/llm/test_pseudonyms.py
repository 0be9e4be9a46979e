from __future__ import annotations

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from driftgrid.llm.pseudonyms import ANY, CALLING, DATE, DATE_LEFT, DATE_RIGHT, IPV4, PHONE, ROUNDS, SSN, feistel, permute, pseudonymize
from tests.llm.data import frame


def feistel_by_hand(key, kind, left, right, m, n):
    f = lambda *x: int(hashlib.sha256("|".join(map(str, (key, kind, *x))).encode()).hexdigest()[:15], 16)
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = (left + f(i, right)) % m
        else:
            right = (right + f(i, left)) % n
    return left, right


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def run(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonymize(df, key).orderBy("doc_id").collect()]


def test_feistel_is_the_permutation_by_hand(spark):
    df = spark.range(7 * 5)
    out = df.select("id", feistel("k", F.lit("x"), F.expr("id div 5"), F.expr("id % 5"), F.lit(7), F.lit(5)).alias("f")).collect()
    assert {(r.f.l, r.f.r) for r in out} == {(a, b) for a in range(7) for b in range(5)}
    assert all((r.f.l, r.f.r) == feistel_by_hand("k", "x", r.id // 5, r.id % 5, 7, 5) for r in out)
    got = spark.range(1000).select(permute("k", F.lit("n"), F.lpad(F.col("id").cast("string"), 3, F.lit("0")), 10).alias("p")).collect()
    assert len({r.p for r in got}) == 1000 and all(re.fullmatch(r"\d{3}", r.p) for r in got)


def test_formats_stay_valid(spark):
    cards = ["4111 1111 1111 1111", "4041894974608795", "378282246310005"]
    others = ["2024-02-29", "02/29/2024", "192.168.1.254", "+1 (988) 555-2485", "123-45-6789", "ann.lee+x@mail.example.com"]
    out = run(spark, [f"see {x}, end" for x in cards + others])
    values = [t[4:-5] for t in out]
    assert all(t.startswith("see ") and t.endswith(", end") for t in out)
    for old, new in zip(cards, values):
        assert new != old and len(new) == len(old) and new[0] == old[0] and luhn(re.sub(r"\D", "", new))
    date, usdate, ip, phone, ssn, mail = values[3:]
    assert datetime.date.fromisoformat(date) == datetime.datetime.strptime(usdate, "%m/%d/%Y").date() != datetime.date(2024, 2, 29)
    assert all(0 <= int(p) < 256 for p in ip.split(".")) and ip != others[2]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != others[3]
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn != others[4]
    assert re.fullmatch(r"[a-z0-9]{3}\.[a-z0-9]{3}\+[a-z0-9]@mail\.example\.com", mail) and mail != others[5]


def test_invalid_values_stay(spark):
    texts = ["4111 1111 1111 1112", "2023-02-29", "1850-01-01", "300.1.1.1", "000-12-3456", "room 12", "a@b", "", None, "v1.2.3.4.5.6.7"]
    assert run(spark, texts) == texts


def test_equal_values_are_linked_and_keys_differ(spark):
    a, b = run(spark, ["x 4041894974608795 y", "z\n4041894974608795"])
    assert a.split()[1] == b.split()[1] != "4041894974608795"
    assert run(spark, ["x 4041894974608795 y"], key="other")[0] != a
    two = run(spark, ["a@x.org b@x.org", "988-555-2485 +1 (988) 555-2485"])
    assert len(set(two[0].split())) == 2
    assert re.sub(r"\D", "", two[1].split()[0]) == re.sub(r"\D", "", " ".join(two[1].split()[2:]) )[-10:] or re.sub(r"\D", "", two[1])[:10] == re.sub(r"\D", "", two[1])[-10:]


def test_dates_are_permuted_one_to_one(spark):
    assert DATE_LEFT * DATE_RIGHT == (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
    df = spark.range(3000).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = [r.text for r in pseudonymize(df, "k").collect()]
    assert len(set(out)) == 3000 and all(1900 <= datetime.date.fromisoformat(x).year < 2100 for x in out)


def test_table(spark):
    df = frame(spark)
    out = pseudonymize(df, "k", count_col="n_words")
    assert out.columns.sort() == df.columns.sort() and out.count() == df.count()
    before, after = ({(r.doc_id, r.text) for r in x.collect()} for x in (df, out))
    assert before == after  # no personal data in it
    assert pseudonymize(frame(spark, []), "k").count() == 0


@pytest.mark.parametrize("n", [100, 5000])
def test_many_values_in_one_text(spark, n):
    text = " ".join(f"u{i}@x.org" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pseudonymize(df, "k", count_col="n").first()
    assert len(set(row.text.split())) == n and row.n >= n - n // 20


def test_phones_are_linked_however_they_are_written(spark):
    out = run(spark, ["+441234567890", "+44 1234567890", "+44 1234 567890", "+15559882485", "+1 (555) 988-2485", "555-988-2485"])
    digits = [re.sub(r"\D", "", x) for x in out]
    assert digits[0] == digits[1] == digits[2] and digits[0].startswith("44") and digits[0] != "441234567890"
    assert digits[3] == digits[4] == "1" + digits[5] != "15559882485"


def test_security_numbers_stay_valid_and_apart(spark):
    valid = spark.range(4000).select(F.format_string("%03d-%02d-%04d", F.expr("1 + id % 665"), F.expr("1 + id % 99"), F.expr("1 + id * 2 % 9999")).alias("text"))
    out = [r.text for r in pseudonymize(valid, "k").collect()]
    assert len(set(out)) == 4000 and not any(re.match(r"000|666|9|\d{3}-00|.*-0000", x) for x in out)


def test_mailboxes_of_any_length_are_permuted(spark):
    one = run(spark, [f"{c}@x.org" for c in "0123456789abcdefghijklmnopqrstuvwxyz"])
    assert len(set(one)) == 36 and all(re.fullmatch(r"[0-9a-z]@x\.org", x) for x in one)
    alphabet = "0123456789abcdefghijklmnopqrstuvwxyz"
    assert len({(alphabet.index(x[0]) - i) % 36 for i, x in enumerate(one)}) > 5  # no constant shift
    long = [f"{'a' * 25}{i:03d}@x.org" for i in range(300)] + [f"{i:03d}{'a' * 25}@x.org" for i in range(1, 300)]
    out = run(spark, long)
    assert len(set(out)) == len(set(long)) and all(re.fullmatch(r"[0-9a-z]{28}@x\.org", x) for x in out)
    assert run(spark, ["x" * 5000 + "@x.org"])[0].endswith("@x.org")


def test_dates_in_three_notations(spark):
    iso, us, dot, ip = run(spark, ["1990-05-12", "05/12/1990", "12.05.1990", "12.05.19.90"])
    day = datetime.date.fromisoformat(iso)
    assert day != datetime.date(1990, 5, 12) and us == day.strftime("%m/%d/%Y") and dot == day.strftime("%d.%m.%Y") and re.fullmatch(r"\d+(\.\d+){3}", ip)


def digits_by_hand(key, kind, text, base=10):
    """permute() in Python."""
    alphabet = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    value = lambda t: int(t or "0", base)

    def written(x, k):
        out = ""
        for _ in range(k):
            x, d = divmod(x, base)
            out = alphabet[d] + out
        return out

    n, one = len(text), 2 if base == 10 else 6
    if n == 1:
        left, right = feistel_by_hand(key, f"{kind}{n}", *divmod(value(text), base // one), one, base // one)
        return written(left * (base // one) + right, 1)
    a = n // 2
    left, right = feistel_by_hand(key, f"{kind}{n}", value(text[:a]), value(text[a:]), base**a, base ** (n - a))
    return written(left, a) + written(right, n - a)


def long_by_hand(key, text):
    alphabet = "0123456789abcdefghijklmnopqrstuvwxyz"
    sides, n = [text[: len(text) // 2], text[len(text) // 2 :]], len(text)
    for i in range(ROUNDS):
        seed = hashlib.sha256("|".join([key, "email", str(n), str(i), sides[1 - i % 2]]).encode()).hexdigest()
        sides[i % 2] = "".join(alphabet[(alphabet.index(c) + int(hashlib.sha256(f"{seed}|{j}".encode()).hexdigest()[:8], 16)) % 36] for j, c in enumerate(sides[i % 2]))
    return "".join(sides)


def filled(shape, new, kind):
    it = iter(new)
    return re.sub(f"[{kind}]", lambda _: next(it), shape)


def by_hand(key, m):
    day0, d = datetime.date(1900, 1, 1), re.sub(r"\D", "", m)
    whole = lambda p: re.fullmatch(p, m, re.ASCII)
    if "@" in m:
        local, domain = m.split("@")
        z = re.sub("[^a-z0-9]", "", local.lower())
        return filled(local.lower(), digits_by_hand(key, "email", z, 36) if len(z) <= 20 else long_by_hand(key, z), "a-z0-9") + "@" + domain
    if whole(DATE):
        form = "%Y-%m-%d" if "-" in m else "%m/%d/%Y" if "/" in m else "%d.%m.%Y"
        try:
            n = (datetime.datetime.strptime(m, form).date() - day0).days
        except ValueError:
            return m
        if not 0 <= n < DATE_LEFT * DATE_RIGHT:
            return m
        a, b = feistel_by_hand(key, "date", *divmod(n, DATE_RIGHT), DATE_LEFT, DATE_RIGHT)
        return (day0 + datetime.timedelta(a * DATE_RIGHT + b)).strftime(form)
    if whole(SSN):
        a, g, s = map(int, m.split("-"))
        if a in (0, 666) or a >= 900 or not g or not s:
            return m
        a, r = feistel_by_hand(key, "ssn", a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999)
        return f"{a + 1 + (a >= 665):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
    if whole(IPV4):
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        a, b = feistel_by_hand(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if whole(PHONE):
        if not 7 <= len(d) <= 15:
            return m
        c = len(re.match(CALLING, d).group()) if m[0] == "+" else 0
        return filled(m, d[:c] + digits_by_hand(key, "phone", d[c:]), "0-9")
    if not luhn(d) or not int(d):
        return m
    body = d[0] + digits_by_hand(key, f"card{d[0]}", d[1:-1])
    return filled(m, body + next(c for c in "0123456789" if luhn(body + c)), "0-9")


def test_whole_texts_by_hand(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda n: "".join(rng.choice("abcXYZ019._+-") for _ in range(n))
    makers = [
        lambda: f"{name(rng.randint(1, 90))}@{rng.choice(['mail', 'a-b', 'x1'])}.{rng.choice(['org', 'co.uk', 'c', 'de1', 'com.'])}",
        lambda: f"{rng.randint(1880, 2110)}-{rng.randint(1, 13):02d}-{rng.randint(1, 31):02d}",
        lambda: f"{rng.randint(1, 13):02d}/{rng.randint(1, 31):02d}/{rng.randint(1890, 2110)}",
        lambda: f"{rng.randint(1, 31):02d}.{rng.randint(1, 13):02d}.{rng.randint(1890, 2110)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: ".".join(str(rng.randint(0, 270)) for _ in range(4)),
        lambda: f"+{rng.randint(1, 999)} {digits(3)} {digits(rng.randint(2, 4))}-{digits(4)}",
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: next(c for c in iter(lambda: digits(rng.randint(13, 19)), "") if luhn(c)),
        lambda: " ".join(digits(4) for _ in range(4)),
        lambda: name(rng.randint(1, 12)), lambda: "word", lambda: "\n",
    ]
    texts = [" ".join(rng.choice(makers)() for _ in range(rng.randint(0, 30))) for _ in range(300)]
    want = [re.sub(ANY, lambda m: by_hand("k", m.group()), t, flags=re.ASCII) for t in texts]
    assert run(spark, texts) == want and sum(a != b for a, b in zip(texts, want)) > 200


@pytest.mark.parametrize("text", ["a@" + "a." * 500_000 + "1", "a@" + "1." * 500_000, "a" * 1_000_000, "a." * 500_000, "._%+-" * 200_000, "a@" * 500_000, "1-" * 500_000, "+1 " * 333_000, "1.1.1." * 170_000, "a@" + "a" * 1_000_000 + ".com", "(1" * 500_000])
def test_near_misses_of_any_length(spark, text):
    assert run(spark, [text]) == [text]


def test_mailboxes_of_a_million_characters(spark):
    whole = run(spark, ["say " + "ab.c" * 250_000 + "@mail.example.org, " + "-" * 1000 + "b" * 70 + "@x.org"])[0]
    first, second = whole.split()[1:]
    assert len(first) == 1_000_000 + len("@mail.example.org,") and first.endswith("@mail.example.org,")
    assert second.startswith("-" * 1000) and second.endswith("@x.org") and "bbb" not in second and "abc" not in first[:200]
