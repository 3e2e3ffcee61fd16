"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Payment cards (13 to 19 digits, Luhn), telephone numbers of the North American plan (written ``+1 (ddd)``, with area
codes from 000 to 199 too, which the plan doesn't have), social security numbers, IPv4 addresses and ISO dates are recognised by their form and validated; the local parts of e-mail addresses are
treated alike. A value's variable part becomes a number below N, where N is how many valid values the format has.
A Feistel network over a x b >= N, keyed by SHA-256 and walked on while it leaves the range, permutes the numbers
below N, and the result is written back in the same format: same separators, valid check digit, a date that
exists. Equal values become equal pseudonyms in all documents, different values different ones of the same format.

Digits next to a card (an expiry date, a CVV, a row's number) are told from it by trying every span of whole groups
that has a card's shape. A card is permuted on while its new digits would be read as other spans; only there, where
another group of four digits or more stands before a spaced card, or where a spaced card of 19 digits starts like one
of 16, can its pseudonym depend on how it stands.

The key is a parameter; who has it can undo the permutation (``reverse=True``).

Defined results: null texts stay null and count no values; empty texts stay empty; what looks like a value but
isn't valid stays as it is; very long texts are read whole; repeated rows each get a row; an empty table gives no rows;
other columns are kept by ``pseudonymise`` apart from those named like its results, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table, unused

#: Rounds of the network; walks are so many at most, and leave the range with a chance of under 1e-30 then.
ROUNDS, WALKS = 8, 48
#: Where the query takes its key from, and the key of examples and tests, which hides nothing.
KEY, DEFAULT_KEY = "spark.sparkloom.pii.key", "sparkloom example key"

#: The forms that are looked for, in this order.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
DATE = r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+(])(?:(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])|\+1[ .-]?\([01][0-9]{2}\) ?)[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9-])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"
#: Groups of digits, at least 13 in all, up to where a value of another kind begins: cards and what stands next to them.
_GROUP = r"[0-9]++(?!-(?![0-9]))"
RUN = rf"(?<![0-9-])(?=[0-9](?:[ -]?[0-9]){{12}}){_GROUP}(?:(?:-| (?!{'|'.join([EMAIL, DATE, SSN, PHONE, IPV4])})){_GROUP})*+"
#: Groups as they are printed on cards: one, or several of four digits or more, of which the last may be shorter.
SHAPE, GROUPS = r"^(?:[0-9]{13,19}|[0-9]{4,12}(?:[ -][0-9]{4,12})*[ -][0-9]{1,12})$", 5
ANY = "|".join([EMAIL, DATE, SSN, PHONE, IPV4, RUN])
#: First day that a date may be, and how many days there are up to the end of 2099.
FIRST_DAY, DAYS = "1900-01-01", 73049
#: Characters of an e-mail's name that are permuted together.
CHUNK = 8


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permute(x: Column, n: Column, key: str, tweak: Column, reverse: bool = False) -> Column:
    """The keyed permutation of the numbers below ``n`` (a long) at ``x``; ``tweak`` selects one of many."""

    def once(z: Column, n: Column, a: Column, b: Column) -> Column:
        # One lambda for all rounds, so that the expression's size doesn't double from round to round.
        order = range(ROUNDS - 1, -1, -1) if reverse else range(ROUNDS)
        start = F.struct(F.floor(z / b).cast("long").alias("u"), F.pmod(z, b).alias("v"))

        def turn(pair: Column, i: Column) -> Column:
            even = (i % 2) == 0
            other, m = F.when(even, pair["v"]).otherwise(pair["u"]), F.when(even, a).otherwise(b)
            said = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), n.cast("string"), other.cast("string"))
            f = F.pmod(F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long"), m)
            now = F.pmod(F.when(even, pair["u"]).otherwise(pair["v"]) + (-f if reverse else f), m)
            return let(now, lambda y: F.struct(F.when(even, y).otherwise(pair["u"]).alias("u"), F.when(even, pair["v"]).otherwise(y).alias("v")))

        return F.aggregate(F.array(*[F.lit(i) for i in order]), start, turn, lambda p: p["u"] * b + p["v"])

    def walk(x: Column, n: Column, a: Column, b: Column) -> Column:
        step = lambda z, i: F.when((z >= 0) & (z < n), z).otherwise(once(F.when(i == 1, x).otherwise(z), n, a, b))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.lit(-1).cast("long"), step)

    with_b = lambda n, a: let(F.floor((n - 1) / a) + 2, lambda b: walk(x, n, a, b))
    return let(n, lambda n: let(F.ceil(F.sqrt(n.cast("double"))).cast("long") + 1, lambda a: with_b(n, a)))


def fill(form: Column, what: str, chars: Column) -> Column:
    """``form`` with its characters of class ``what`` replaced by those of ``chars``, in order."""

    def filled(form: Column, chars: Column) -> Column:
        seen = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i), f"[^{what}]", ""))
        one = lambda i: F.substring(form, i, F.lit(1))
        put = lambda i: F.when(one(i).rlike(f"[{what}]"), F.substring(chars, seen(i), F.lit(1))).otherwise(one(i))
        return F.when(F.length(form) == 0, form).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), put), ""))

    return let(form, lambda f: let(chars, lambda c: filled(f, c)))


def pad(x: Column, width: Column) -> Column:
    """``x`` with zeros before it, up to a width that it doesn't exceed."""
    return let(x.cast("string"), lambda text: F.concat(F.repeat(F.lit("0"), width - F.length(text)), text))


def power(base: int, exponent: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(exponent, F.lit(1))), F.expr("1L"), lambda p, i: F.when(i <= exponent, p * base).otherwise(p))


def luhn_sum(number: Column) -> Column:
    """Luhn's sum of a string of digits, whose last digit counts once."""

    def total(number: Column, n: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            twice = lambda d: F.when(i % 2 != 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
            return total + let(F.substring(number, n - i + 1, F.lit(1)).cast("int"), twice)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)

    return let(number, lambda x: let(F.length(x), lambda n: total(x, n)))


def _card(m: Column, key: str, reverse: bool) -> Column:
    """All digits but the first, which tells the network, and the last, which is the check digit."""

    def new(d: Column, inner: Column) -> Column:
        x = F.substring(d, F.lit(2), inner).cast("long")
        y = permute(x, power(10, inner), key, F.concat(F.lit("card"), F.substring(d, 1, 1)), reverse)
        check = lambda body: F.pmod(F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
        return let(F.concat(F.substring(d, 1, 1), pad(y, inner)), lambda body: F.concat(body, check(body).cast("string")))

    return fill(m, "0-9", let(digits(m), lambda d: let(F.length(d) - 2, lambda inner: new(d, inner))))


def _phone(m: Column, key: str, reverse: bool) -> Column:
    """Area and exchange from 200 to 999, and four digits; areas from 000 to 199 are permuted among themselves."""

    def new(d: Column) -> Column:
        d10 = F.substring(d, F.length(d) - 9, F.lit(10))
        part = lambda at, n: F.substring(d10, at, n).cast("long")
        low = part(1, 3) < 200
        base = F.when(low, 0).otherwise(200)
        x = ((part(1, 3) - base) * 800 + (part(4, 3) - 200)) * 10000 + part(7, 4)
        n = F.when(low, F.expr("1600000000L")).otherwise(F.expr("6400000000L"))
        y = permute(x, n, key, F.lit("phone"), reverse)
        said = lambda y: F.concat(
            F.substring(d, F.lit(1), F.length(d) - 10),
            pad(F.floor(y / 8000000) + base, F.lit(3)),
            (F.floor(F.pmod(y, F.expr("8000000L")) / 10000) + 200).cast("string"),
            pad(F.pmod(y, F.expr("10000L")), F.lit(4)),
        )
        return let(y, said)

    return fill(m, "0-9", let(digits(m), new))


def _ssn(m: Column, key: str, reverse: bool) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    x = ((F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1) * 9999 + serial - 1
    rest = lambda y: F.pmod(y, F.expr("989901L"))
    first = lambda y: let(F.floor(y / 989901) + 1, lambda a: pad(F.when(a >= 666, a + 1).otherwise(a), F.lit(3)))
    said = lambda y: F.concat_ws("-", first(y), pad(F.floor(rest(y) / 9999) + 1, F.lit(2)), pad(F.pmod(rest(y), F.expr("9999L")) + 1, F.lit(4)))
    return let(permute(x, F.expr("898L * 99L * 9999L"), key, F.lit("ssn"), reverse), said)


def _ipv4(m: Column, key: str, reverse: bool) -> Column:
    part = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    x = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    y = permute(x, F.expr("4294967296L"), key, F.lit("ipv4"), reverse)
    return let(y, lambda y: F.concat_ws(".", *[F.shiftright(y, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))


def _date(m: Column, key: str, reverse: bool) -> Column:
    x = F.datediff(F.to_date(m), F.lit(FIRST_DAY).cast("date")).cast("long")
    y = permute(x, F.lit(DAYS).cast("long"), key, F.lit("date"), reverse)
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), y.cast("int")), "yyyy-MM-dd")


def _name(name: Column, key: str, reverse: bool) -> Column:
    """A name's letters (lower-cased) and digits, permuted among themselves in chunks that their place tells apart."""

    def part(what: str, base: int) -> Column:
        plain = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop") if base == 26 else c
        shown = lambda c: F.translate(c, "0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz") if base == 26 else c

        def chunk(c: Column, i: Column, own: Column) -> Column:
            tweak = F.concat_ws(",", F.lit(f"name{base}"), F.length(own).cast("string"), i.cast("string"))
            y = permute(F.conv(plain(c), base, 10).cast("long"), power(base, F.length(c)), key, tweak, reverse)
            return let(F.lower(F.conv(y.cast("string"), 10, base)), lambda new: shown(F.concat(F.repeat(F.lit("0"), F.length(c) - F.length(new)), new)))

        chunks = lambda own: F.regexp_extract_all(own, F.lit(f".{{1,{CHUNK}}}"), F.lit(0))
        return let(F.regexp_replace(F.lower(name), f"[^{what}]", ""), lambda own: F.array_join(F.transform(chunks(own), lambda c, i: chunk(c, i, own)), ""))

    return fill(fill(F.lower(name), "0-9", part("0-9", 10)), "a-z", part("a-z", 26))


def _email(m: Column, key: str, reverse: bool) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(_name(name, key, reverse), F.substring(m, F.length(name) + 1, F.length(m)))


def kind(m: Column) -> Column:
    """The kind of a found string other than a run of digits, or null if it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    valid_ssn = ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(whole(DATE), F.when(F.try_to_date(m, "yyyy-MM-dd").isNotNull(), F.lit("date")))
        .when(whole(SSN), F.when(valid_ssn, F.lit("ssn")))
        .when(whole(PHONE), F.lit("phone"))
        .when(whole(IPV4), F.lit("ipv4"))
    )


def _piece(text: Column, kind: Column) -> Column:
    return F.struct(text.alias("text"), kind.cast("string").alias("kind"))


def _valid_card(m: Column) -> Column:
    return let(digits(m), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0))


def _cards(run: Column) -> Column:
    """The pieces of a run of digits: its cards, and what is between them.

    Every span of whole groups that has a card's shape is tried, from left to right and the shortest first. Where
    none is a card, groupings that cards don't have are tried as long as they go.
    """
    said = lambda groups, at, n: F.array_join(F.slice(groups, at, n), "")
    bare = lambda x: F.regexp_replace(x, "^[ -]", "")

    def shaped(groups: Column) -> Column:
        n = F.size(groups)
        card = lambda i, k: let(bare(said(groups, i, k)), lambda x: x.rlike(SHAPE) & _valid_card(x))
        longest = lambda i: F.least(F.lit(GROUPS), n - i + 1)
        first = lambda i: F.coalesce(F.get(F.filter(F.sequence(F.lit(1), longest(i)), lambda k: card(i, k)), F.lit(0)), F.lit(0))
        state = lambda free, spans: F.struct(free.alias("free"), spans.alias("spans"))

        def step(z: Column, i: Column) -> Column:
            more = lambda k: F.when(k > 0, state(i + k, F.concat(z["spans"], F.array(F.struct(z["free"].alias("gap"), i.alias("at"), k.alias("n")))))).otherwise(z)
            return F.when(i < z["free"], z).otherwise(let(first(i), more))

        start = state(F.lit(1), F.array().cast("array<struct<gap:int,at:int,n:int>>"))
        ended = F.aggregate(F.sequence(F.lit(1), n), start, step)

        def cut(z: Column) -> Column:
            gap = lambda x: F.concat(said(groups, x["gap"], x["at"] - x["gap"]), F.regexp_extract(F.get(groups, x["at"] - 1), "^[ -]?", 0))
            pieces = F.transform(z["spans"], lambda x: F.array(_piece(gap(x), F.lit(None)), _piece(bare(said(groups, x["at"], x["n"])), F.lit("card"))))
            rest = F.when(z["free"] <= n, said(groups, z["free"], n - z["free"] + 1)).otherwise("")
            return F.when(F.size(z["spans"]) > 0, F.concat(F.flatten(pieces), F.array(_piece(rest, F.lit(None)))))

        return let(ended, cut)

    def others(run: Column) -> Column:
        found = F.concat(F.regexp_extract_all(run, F.lit(CARD), F.lit(0)), F.array(F.lit("")))
        valid = lambda x: F.when(~x.rlike("[0-9]{13}") & _valid_card(x), F.lit("card"))
        return F.flatten(F.zip_with(F.split(run, CARD, -1), found, lambda g, x: F.array(_piece(g, F.lit(None)), _piece(x, valid(x)))))

    return F.coalesce(let(F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0)), shaped), others(run))


def parts(m: Column) -> Column:
    """The pieces (text, kind) of a found string; kind is null for what isn't a valid value and stays."""
    run = m.rlike("^[0-9 -]+$") & ~m.rlike(f"^(?:{DATE}|{SSN}|{PHONE})$")
    return F.when(run, _cards(m)).otherwise(F.array(_piece(m, kind(m))))


def pseudonym(m: Column, key: str = DEFAULT_KEY, reverse: bool = False) -> Column:
    """The pseudonym of a found string; what isn't valid in it stays."""
    joined = lambda p: F.array_join(F.transform(p, lambda x: x["text"]), "")

    def cards(pieces: Column) -> Column:
        # Walked on until the new digits are read as the same pieces, so that they can be reversed.
        new = lambda p: F.transform(p, lambda x: F.when(x["kind"] == "card", _piece(_card(x["text"], key, reverse), x["kind"])).otherwise(x))
        state = lambda p, done: F.struct(p.alias("p"), done.alias("done"))
        step = lambda z, i: F.when(z["done"], z).otherwise(let(new(z["p"]), lambda p: state(p, parts(joined(p)) == p)))
        return joined(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), state(pieces, F.lit(False)), step)["p"])

    def made(pieces: Column) -> Column:
        k = F.get(pieces, F.lit(0))["kind"]
        out = F.when(F.exists(pieces, lambda x: F.coalesce(x["kind"] == "card", F.lit(False))), cards(pieces)).when(k.isNull(), m)
        for name, make in (("email", _email), ("date", _date), ("ssn", _ssn), ("phone", _phone), ("ipv4", _ipv4)):
            out = out.when(k == name, make(m, key, reverse))
        return out

    return let(parts(m), made)


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, reverse: bool = False) -> DataFrame:
    """``docs`` with the values of ``text`` replaced, and how many there were in all and of each kind."""
    kept, here, kinds = [c for c in docs.columns if c not in ("n_values", "kinds")], unused(docs, "found"), unused(docs, "valid")
    rows = docs.select(kept).withColumn(here, F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    valid = F.filter(F.flatten(F.transform(here, lambda m: F.transform(parts(m), lambda x: x["kind"]))), lambda k: k.isNotNull())
    gaps = F.split(F.col("text"), ANY, -1)
    new = F.concat(F.transform(here, lambda m: pseudonym(m, key, reverse)), F.array(F.lit("")))
    text = F.when(F.size(here) > 0, F.array_join(F.zip_with(gaps, new, lambda g, x: F.concat(g, x)), "")).otherwise(F.col("text"))
    rows = rows.withColumn(kinds, F.coalesce(valid, F.array().cast("array<string>"))).withColumn("text", text)
    return rows.select(*kept, F.size(kinds).cast("long").alias("n_values"), F.array_join(F.array_sort(kinds), ",").alias("kinds"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY, DEFAULT_KEY)
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
