"""Format-preserving pseudonyms for personal numbers, dates and addresses, by Feistel permutations in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import distinct_name

ROUNDS = 8
#: Alphabets, each permuted within itself; other characters stay.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0xDF, 0x100))), "".join(map(chr, range(0xC0, 0xDF)))]
_LOCAL = r"\s@,;:<>()\[\]\"'|=/!?&*#$%"
EMAIL = rf"(?<![^{_LOCAL}])[^{_LOCAL}]{{1,64}}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/]|[.-]\d)"
PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}|(?<![\d.+-])\d{3}-\d{3}-\d{4})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
PATTERN = f"{EMAIL}|(?=[0-9+(])(?:{'|'.join((IPV4, DATE, PHONE, SSN, CARD))})"
#: Days that dates are permuted in: 1900-01-01 and the 72,999 after it (250 * 292).
FIRST_DAY, DAYS = "1900-01-01", (250, 292)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often a lambda inside reads it."""
    return F.transform(F.array(value), use)[0]


def _mod_hash(key: str, tweak: str, r: Column, other: Column, radix: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), r.cast("string"), F.lit("|"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % radix


def _shift_half(half: Column, other: Column, r: Column, key: str, tweak: str) -> Column:
    """Each character moved on in its alphabet by a byte of the round's digest of the other half (32 characters a digest)."""
    every, starts = "".join(ALPHABETS), [sum(map(len, ALPHABETS[:k])) for k in range(len(ALPHABETS) + 1)]

    def one(i: Column) -> Column:
        c = half.substr(i, F.lit(1))
        at = F.call_function("instr", F.lit(every), c) - 1
        digest = F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), r.cast("string"), F.lit("|"), ((i - 1) / 32).cast("int").cast("string"), F.lit("|"), other), 256)
        step = F.conv(digest.substr(((i - 1) % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for k, a in enumerate(ALPHABETS):
            moved = F.lit(a).substr((at - starts[k] + step) % len(a) + 1, F.lit(1))
            out = F.when((at >= starts[k]) & (at < starts[k + 1]), moved).otherwise(out)
        return out

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), "")


def permute_string(s: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings of one shape: a character stays in its alphabet, other characters stay as they are.

    Alternating halves; each half's characters move by the digest of the other half. One character alone moves by the digest of nothing.
    """
    cut = (F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), cut).alias("a"), F.substr(s, cut + 1).alias("b"))

    def step(acc: Column, r: Column) -> Column:
        a = F.when((r % 2 == 0) & (F.length(acc["a"]) > 0), _shift_half(acc["a"], acc["b"], r, key, tweak)).otherwise(acc["a"])
        b = F.when((r % 2 == 1) & (F.length(acc["b"]) > 0), _shift_half(acc["b"], acc["a"], r, key, tweak)).otherwise(acc["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_pair(a: Column, b: Column, na: int, nb: int, key: str, tweak: str) -> Column:
    """A keyed permutation of [0, na) x [0, nb) as struct(a, b)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(acc: Column, r: Column) -> Column:
        x = F.when(r % 2 == 0, (acc["a"] + _mod_hash(key, tweak, r, acc["b"], na)) % na).otherwise(acc["a"])
        y = F.when(r % 2 == 1, (acc["b"] + _mod_hash(key, tweak, r, acc["a"], nb)) % nb).otherwise(acc["b"])
        return F.struct(x.alias("a"), y.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string, its last digit being the check digit."""
    at = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: d.substr(i, F.lit(1)).cast("int") * (1 + (F.length(d) - i) % 2))
    return F.aggregate(at, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))


def _refill(t: Column, d: Column, skip: Column) -> Column:
    """t with its digits after the first `skip` ones replaced by those of d, in order."""

    def one(i: Column) -> Column:
        c = t.substr(i, F.lit(1))
        nth = F.length(_digits(t.substr(F.lit(1), i))) - skip
        return F.when(c.rlike("[0-9]") & (nth > 0), d.substr(nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(t)), one), "")


def _card(t: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        body = permute_string(d.substr(F.lit(1), F.length(d) - 1), key, "card")
        return _let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    return _let(_digits(t), lambda d: F.when(luhn_sum(d) % 10 == 0, _let(valid(d), lambda x: _refill(t, x, F.lit(0)))).otherwise(t))


def _phone(t: Column, key: str) -> Column:
    """The country code stays; numbers of 8 to 15 digits count as valid."""
    d = _digits(t)
    code = F.when(t.startswith("+"), F.length(F.regexp_extract(t, r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})", 1))).otherwise(F.lit(0))
    rest = d.substr(code + 1, F.length(d))
    return F.when((F.length(d) >= 8) & (F.length(d) <= 15), _let(permute_string(rest, key, "phone"), lambda x: _let(code, lambda k: _refill(t, x, k)))).otherwise(t)


def _ipv4(t: Column, key: str) -> Column:
    o = F.transform(F.split(t, r"\."), lambda x: x.cast("int"))
    p = _let(permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4"), lambda z: F.concat_ws(".", (z["a"] / 256).cast("int"), z["a"] % 256, (z["b"] / 256).cast("int"), z["b"] % 256))
    return F.when(F.forall(o, lambda x: x <= 255), p).otherwise(t)


def _day(y: Column, m: Column, d: Column) -> Column:
    """Days since FIRST_DAY of a valid date in range, else null."""
    most = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).otherwise(31)
    day = F.datediff(F.make_date(y, m, d), F.lit(FIRST_DAY).cast("date"))
    return F.when((y >= 1900) & (y <= 2100) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= most), F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), day))


def _date(t: Column, key: str) -> Column:
    n = F.transform(F.split(t, "[-/.]"), lambda x: x.cast("int"))
    iso, slash = t.substr(F.lit(5), F.lit(1)) == "-", F.contains(t, F.lit("/"))
    us = slash & (n[1] > 12)
    day = F.when(iso, _day(n[0], n[1], n[2])).when(us, _day(n[2], n[0], n[1])).otherwise(_day(n[2], n[1], n[0]))
    shape = F.when(iso, F.lit("yyyy-MM-dd")).when(us, F.lit("MM/dd/yyyy")).when(slash, F.lit("dd/MM/yyyy")).otherwise(F.lit("dd.MM.yyyy"))

    def written(z: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (z["a"] * DAYS[1] + z["b"]).cast("int"))
        return F.when(shape == "yyyy-MM-dd", F.date_format(new, "yyyy-MM-dd")).when(shape == "MM/dd/yyyy", F.date_format(new, "MM/dd/yyyy")).when(shape == "dd/MM/yyyy", F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))

    moved = _let(permute_pair((day / DAYS[1]).cast("int"), day % DAYS[1], *DAYS, key, "date"), written)
    return F.when(day.isNull(), t).otherwise(moved)


def _ssn(t: Column, key: str) -> Column:
    ok = ~t.rlike("^(000|666|9)|-00-|-0000$")
    return F.when(ok, _let(permute_string(_digits(t), key, "ssn"), lambda x: _refill(t, x, F.lit(0)))).otherwise(t)


def _email(t: Column, key: str) -> Column:
    return F.concat(permute_string(F.substring_index(t, "@", 1), key, "email"), F.lit("@"), F.substring_index(t, "@", -1))


def pseudonym(t: Column, key: str) -> Column:
    """The pseudonym of one matched value; what fails its kind's validation stays."""
    whole = lambda p: t.rlike(f"^(?:{p})$")
    return F.when(F.contains(t, F.lit("@")), _email(t, key)).when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), _ipv4(t, key)).when(whole(r"\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4}"), _date(t, key)).when(whole(r"\d{3}-\d{2}-\d{4}"), _ssn(t, key)).when(whole(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}"), _card(t, key)).otherwise(_phone(t, key))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", n_name: str = "n_values") -> DataFrame:
    """docs with personal values in text_col replaced and n_name (long): how many values were.

    Kinds: e-mail local parts (the domain stays), IPv4 addresses (octets up to 255), dates (yyyy-mm-dd, d/m/yyyy, m/d/yyyy where only that is
    valid, d.m.yyyy; from 1900-01-01 on, existing days), phone numbers (the country code stays), US social security numbers, and numbers of 13 to
    19 digits with a valid Luhn check digit, which stays valid. What fails validation stays. Values are normalised to their digits, so separators don't matter, and permuted under the key:
    equal values get equal pseudonyms in every document, and different ones of one kind and length different ones. The result has the format of the
    value. A null text stays null (0); texts without digits or @ aren't searched; rows and other columns stay. No shuffle, one pass.
    """
    n_name = distinct_name(docs, n_name)
    body, found, new = F.col(f"`{text_col}`"), distinct_name(docs, "_found"), distinct_name(docs, "_new")
    some = docs.withColumn(found, F.when(body.rlike("[0-9@]"), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = some.withColumn(new, F.transform(F.col(found), lambda t: pseudonym(t, key)))
    parts = F.split(body, PATTERN, -1)
    text = F.when(F.size(found) > 0, F.array_join(F.zip_with(parts, F.array_append(F.col(new), F.lit("")), lambda p, t: F.concat(p, t)), "")).otherwise(body)
    n = F.coalesce(F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)), F.lit(0))
    n = F.when(body.isNull(), 0).otherwise(n).cast("long")
    return some.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], n.alias(n_name))
