"""Format-preserving pseudonyms by keyed Feistel networks. DataFrame functions only.

A validated value is permuted within its own format: a card number becomes
another number of the same length, brand digit and valid check digit, a date
another date of 1900-2099, a social security number another valid one. The
permutation depends on the key and the kind of value, so equal values get equal
pseudonyms in all documents, however they are spaced, and different values of
one kind never meet. A permutation may map one value in its whole domain to
itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What each kind looks like.
# A mailbox starts where its run of characters does, so a run is read once, however long; a domain has at most
# 126 labels of at most 63 characters, as names have, which bounds the depth of the matcher.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}\b(?!\.\d)"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}\b|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
DATE = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b|(?<![\d.])\d{2}\.\d{2}\.\d{4}\b(?!\.\d)"
CARD = r"\b\d(?:[ -]?\d){11,17}[ -]?\d\b"
ANY = "|".join([EMAIL, DATE, SSN, IPV4, PHONE, CARD])

# Country calling codes of one and two digits; all others have three.
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

# Social security numbers have areas 1-665 and 667-899, groups 1-99 and serial numbers 1-9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"

# Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
DATE_LEFT, DATE_RIGHT = 17, 4297


def number_of(key: str, *parts: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Permutes (left, right) in Z_left_size x Z_right_size: struct l, r."""

    def step(s: Column, i: Column) -> Column:
        on_left = F.struct(((s.l + F.pmod(number_of(key, kind, i, s.r), left_size)) % left_size).alias("l"), s.r.alias("r"))
        on_right = F.struct(s.l.alias("l"), ((s.r + F.pmod(number_of(key, kind, i, s.l), right_size)) % right_size).alias("r"))
        return F.when(i % 2 == 0, on_left).otherwise(on_right)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def then(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def permute(key: str, kind: Column, text: Column, base: int) -> Column:
    """A string of digits of ``base`` (10 or 36), at most 20 of them, permuted within its length."""

    def halves(n: Column) -> Column:
        # one digit is split into two smaller ones
        one = 2 if base == 10 else 6
        a = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(float(base)), k).cast("long")
        value = lambda s: F.conv(F.concat(F.lit("0"), s), base, 10).cast("long")
        digits = lambda x, k: F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), k, F.lit("0"))
        single, whole = n == 1, value(text)
        left = F.when(single, F.floor(whole / (base // one))).otherwise(value(F.substring(text, F.lit(1), a)))
        right = F.when(single, whole % (base // one)).otherwise(value(F.substring(text, a + 1, n - a)))
        done = feistel(key, F.concat(kind, n.cast("string")), left, right, F.when(single, one).otherwise(size(a)), F.when(single, base // one).otherwise(size(n - a)))
        return then(done, lambda s: F.when(single, digits(s.l * (base // one) + s.r, F.lit(1))).otherwise(F.concat(digits(s.l, a), digits(s.r, n - a))))

    return then(F.length(text), halves)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def permute_long(key: str, kind: Column, text: Column) -> Column:
    """A string of any length over ALPHABET, permuted within its length: each half in turn is shifted, character by character, by numbers keyed by the other."""

    def shifted(s: Column, i: Column, other: Column, n: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), kind, n.cast("string"), i.cast("string"), F.array_join(other, "")), 256)

        def one(h: Column, c: Column, j: Column) -> Column:
            number = F.conv(F.substring(F.sha2(F.concat_ws("|", h, j.cast("string")), 256), 1, 8), 16, 10).cast("long")
            at = (F.instr(F.lit(ALPHABET), c) - 1 + number) % 36
            return F.substring(F.lit(ALPHABET), (at + 1).cast("int"), F.lit(1))

        return then(seed, lambda h: F.transform(s, lambda c, j: one(h, c, j)))

    def step(s: Column, i: Column) -> Column:
        n = F.size(s.l) + F.size(s.r)
        return F.when(i % 2 == 0, F.struct(shifted(s.l, i, s.r, n).alias("l"), s.r.alias("r"))).otherwise(F.struct(s.l.alias("l"), shifted(s.r, i, s.l, n).alias("r")))

    def halves(c: Column) -> Column:
        a = F.floor(F.size(c) / 2).cast("int")
        start = F.struct(F.slice(c, F.lit(1), a).alias("l"), F.slice(c, a + 1, F.size(c)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.array_join(F.concat(s.l, s.r), ""))

    return then(characters(text), halves)


def refill(shape: Column, digits: Column, kind: str) -> Column:
    """``shape`` with its characters of class ``kind`` replaced by those of ``digits`` in turn; linear in its length but for one sort."""
    placed = F.transform(characters(shape), lambda c, i: F.struct(i.alias("i"), c.alias("c")))

    def merged(all_: Column) -> Column:
        hits = F.filter(all_, lambda x: x.c.rlike(f"[{kind}]"))
        new = F.zip_with(hits, characters(digits), lambda h, d: F.struct(h.i.alias("i"), F.coalesce(d, F.lit("")).alias("c")))
        rest = F.filter(all_, lambda x: ~x.c.rlike(f"[{kind}]"))
        return F.array_join(F.transform(F.array_sort(F.concat(rest, new)), lambda x: x.c), "")

    return then(placed, merged)


def luhn(digits: Column) -> Column:
    """Sum of the check-digit rule, modulo 10."""
    weigh = lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + x) % 10


def card(key: str, m: Column) -> Column:
    def known(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), permute(key, F.concat(F.lit("card"), F.substring(d, 1, 1)), F.substring(d, F.lit(2), n - 2), 10))
        whole = then(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
        return F.when((luhn(d) == 0) & (d.cast("decimal(20,0)") > 0), then(whole, lambda w: refill(m, w, "0-9"))).otherwise(m)

    return then(F.regexp_replace(m, "[^0-9]", ""), known)


def phone(key: str, m: Column) -> Column:
    """The country code stays; the national number is permuted, with or without it, whatever the separators."""

    def known(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.length(F.regexp_extract(d, CALLING, 0))).otherwise(F.lit(0))
        whole = then(code, lambda c: F.concat(F.substring(d, F.lit(1), c), permute(key, F.lit("phone"), F.substring(d, c + 1, F.length(d) - c), 10)))
        return F.when(F.length(d).between(7, 15), then(whole, lambda w: refill(m, w, "0-9"))).otherwise(m)

    return then(F.regexp_replace(m, "[^0-9]", ""), known)


def ssn(key: str, m: Column) -> Column:
    """Valid numbers are numbered by area, and by group and serial number, and permuted among themselves."""
    valid = ~m.rlike(r"^(000|666|9)|-00-|-0000$")
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    done = feistel(key, F.lit("ssn"), area - 1 - (area > 666).cast("int"), (group - 1) * SERIALS + serial - 1, F.lit(AREAS), F.lit(GROUPS * SERIALS))
    text = lambda s: F.format_string("%03d-%02d-%04d", s.l + 1 + (s.l >= 665).cast("int"), F.floor(s.r / SERIALS) + 1, s.r % SERIALS + 1)
    return F.when(valid, then(done, text)).otherwise(m)


def ipv4(key: str, m: Column) -> Column:
    def known(o: Column) -> Column:
        done = feistel(key, F.lit("ipv4"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        dotted = lambda s: F.concat_ws(".", F.floor(s.l / 256).cast("string"), (s.l % 256).cast("string"), F.floor(s.r / 256).cast("string"), (s.r % 256).cast("string"))
        return F.when(F.array_max(o) < 256, then(done, dotted)).otherwise(m)

    return then(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), known)


def date(key: str, m: Column) -> Column:
    """Dates of one day have one pseudonym in all three notations."""
    by = lambda iso, slash, dot: F.when(m.contains("-"), iso).when(m.contains("/"), slash).otherwise(dot)
    day = by(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "MM/dd/yyyy"), F.try_to_date(m, "dd.MM.yyyy"))

    def known(n: Column) -> Column:
        done = feistel(key, F.lit("date"), F.floor(n / DATE_RIGHT), n % DATE_RIGHT, F.lit(DATE_LEFT), F.lit(DATE_RIGHT))
        to = lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s.l * DATE_RIGHT + s.r).cast("int"))
        text = then(then(done, to), lambda d: by(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "dd.MM.yyyy")))
        return F.when(n.between(0, DATE_LEFT * DATE_RIGHT - 1), text).otherwise(m)

    return then(F.datediff(day, F.lit("1900-01-01").cast("date")), known)


def email(key: str, m: Column) -> Column:
    """Letters and digits of the local part are permuted as one string; the domain stays."""
    local = F.lower(F.substring_index(m, "@", 1))

    def known(z: Column) -> Column:
        whole = F.when(F.length(z) <= 20, permute(key, F.lit("email"), z, 36)).otherwise(permute_long(key, F.lit("email"), z))
        return then(whole, lambda w: F.concat(refill(local, w, "a-z0-9"), F.lit("@"), F.substring_index(m, "@", -1)))

    return then(F.regexp_replace(local, "[^a-z0-9]", ""), known)


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of one match, or the match itself where it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), email(key, m)).when(whole(DATE), date(key, m)).when(whole(SSN), ssn(key, m)).when(whole(IPV4), ipv4(key, m)).when(whole(PHONE), phone(key, m)).otherwise(card(key, m))
    )


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``df`` with personal values in ``text_col`` replaced, and how many were in ``count_col``.

    Kinds: e-mail, card numbers with a valid check digit, phone numbers of 7 to
    15 digits, social security numbers, IPv4 addresses, and dates of 1900-2099
    as yyyy-MM-dd, MM/dd/yyyy or dd.MM.yyyy. A candidate that isn't valid stays
    as it is. A mailbox may have any length; runs of characters that come close
    to a value, of any length, are read once. Columns named __found or __new are replaced and don't stay.
    Null stays null (count 0) and an empty text empty; other columns and
    repeated rows are untouched. A column named ``count_col`` is replaced.
    """
    t = F.col(text_col)
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    told = df.withColumn("__found", found)
    told = told.withColumn("__new", F.when(F.size("__found") > 0, F.transform("__found", lambda m: pseudonym(key, m))))
    joined = F.array_join(F.zip_with(F.split(t, ANY, -1), F.col("__new"), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    out = told.withColumn(text_col, F.when(F.col("__new").isNotNull(), joined).otherwise(t))
    if count_col:
        changed = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x))
        out = out.withColumn(count_col, F.when(F.col("__new").isNotNull(), changed).otherwise(0).cast("long"))
    return out.drop("__found", "__new")
