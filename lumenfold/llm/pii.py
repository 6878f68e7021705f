"""PII: format-preserving Feistel pseudonyms, as native Spark expressions.

Found values are validated (Luhn for card numbers, octet ranges for addresses, the calendar for
dates, number-plan ranges for phones and social security numbers) and permuted within their own
format by a keyed Feistel network on mixed-radix halves, with HMAC-like SHA-256 rounds. Equal
values get equal pseudonyms in every document and no two values of a format get the same one, so
links survive and the key's owner can invert them. The name of a mail address is permuted among the
names of its shape (letters stay letters, digits digits, marks in place; case is kept but doesn't
count) by a Feistel network on its characters, per domain; the domain stays in clear.

A date keeps its notation. Of dates between slashes, those with a month in front and those that
only read as day and month are permuted among themselves, so that neither yields the other's text.
Addresses of equal octets are one value, however many zeros they are written with.

One regular expression finds every kind; a text is split at its matches and joined again around
their pseudonyms, in its own row: no shuffle, no Python.

Cases. A null text stays null and an empty one empty. Numbers that fail validation stay as they
are. Ties and repeated rows are rewritten equally; an empty table gives an empty result. Names of
any length are rewritten whole. Every other column passes through; ``n_pseudonyms`` is added (and
replaces one of that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fresh, let

#: For demonstrations and tests; production passes a secret of its own.
DEMO_KEY = "lumenfold demonstration key"
ROUNDS, NAME_ROUNDS = 10, 6

#: A name starts where a run of its characters does, or where the last value ended, so no run is read twice;
#: marks before it are no part of the value.
MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){1,16}"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"
ANY = "|".join((MAIL, ADDRESS, DATE, SOCIAL, PHONE, CARD))
#: A cheap necessary condition of ANY: an address is four numbers between dots, every other kind has an @ or
#: seven digits close together.
HINT = r"@|[0-9](?:[ ./()-]{0,2}[0-9]){6}|[0-9](?:\.[0-9]{1,3}){3}"

#: The Gregorian cycle of 400 years from 1800-01-01, 146,097 days = 189 x 773.
CYCLE_START, CYCLE = "1800-01-01", (189, 773)
#: Its days after the twelfth of their month: 88,497 = 9 x 9,833.
LATE = (9, 9833)


def _keyed(key: str, tag: str, value: Column) -> Column:
    """A keyed 60-bit number: nested SHA-256, like HMAC."""
    inner = F.sha2(F.concat(F.lit(f"{key}\x00inner\x00{tag}\x00"), value), 256)
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}\x00outer\x00"), inner), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tag: Column | str, left: Column, right: Column, left_size: Column | int, right_size: Column | int, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """Struct (l, r): a keyed permutation of [0, left_size) x [0, right_size).

    Rounds alternate: l += F(r) mod left_size, r += F(l) mod right_size; ``inverse`` undoes them.
    """
    sizes = [left_size if isinstance(left_size, Column) else F.lit(left_size), right_size if isinstance(right_size, Column) else F.lit(right_size)]
    named = tag if isinstance(tag, Column) else F.lit(tag)

    def step(k: int):
        def apply(x: Column) -> Column:
            a, b = (x["l"], x["r"]) if k % 2 == 0 else (x["r"], x["l"])
            f = _keyed(key, str(k), F.concat_ws("\x00", named, b.cast("string")))
            new = F.pmod(a - F.pmod(f, sizes[k % 2]) if inverse else a + F.pmod(f, sizes[k % 2]), sizes[k % 2])
            return F.struct((new if k % 2 == 0 else b).alias("l"), (b if k % 2 == 0 else new).alias("r"))

        return apply

    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    for k in reversed(range(rounds)) if inverse else range(rounds):
        state = let(state, step(k))
    return state


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _pour(digits: Column, shape: Column) -> Column:
    """The digits in the places of ``shape``'s digits; everything else stays."""
    pieces = F.split(shape, "[0-9]", -1)
    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.char_length(digits)), lambda p, i: F.concat(F.substring(digits, i + 1, F.lit(1)), p)), ""))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum with every second digit doubled, counted from the right; ``doubled`` is 1 when the check digit is there."""
    at = F.sequence(F.lit(0), F.char_length(digits) - 1)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(at, F.lit(0), add)


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width if isinstance(width, int) else width, "0")


def card_pseudonym(key: str, value: Column) -> Column:
    """Luhn numbers of 13 to 19 digits: all digits but the last are permuted, the last is recomputed."""

    def of(d: Column) -> Column:
        n = F.char_length(d) - 1
        half = F.floor(n / 2).cast("int")
        ten = lambda k: F.pow(F.lit(10), k).cast("long")
        mixed = feistel(key, F.concat(F.lit("card"), n.cast("string")), F.substring(d, F.lit(1), half).cast("long"), F.substring(d, half + 1, n - half).cast("long"), ten(half), ten(n - half))
        payload = let(mixed, lambda m: F.concat(F.lpad(m["l"].cast("string"), half, "0"), F.lpad(m["r"].cast("string"), n - half, "0")))
        return let(payload, lambda p: _pour(F.concat(p, F.pmod(10 - luhn_sum(p, 0), F.lit(10)).cast("string")), value))

    valid = lambda d: (F.char_length(d) >= 13) & (F.char_length(d) <= 19) & (luhn_sum(d, 1) % 10 == 0)
    return let(_digits(value), lambda d: F.when(valid(d), of(d)))


def address_pseudonym(key: str, value: Column) -> Column:
    def of(o: Column) -> Column:
        n = lambda k: F.element_at(o, k).cast("long")
        mixed = feistel(key, "address", n(1) * 256 + n(2), n(3) * 256 + n(4), 65536, 65536)
        octet = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return F.when(F.forall(o, lambda x: x.cast("int") < 256), let(mixed, lambda m: F.concat_ws(".", *octet(m["l"]), *octet(m["r"]))))

    return let(F.split(value, r"\."), of)


def _first_of_month(month: Column) -> Column:
    """Days from CYCLE_START to the first of a month, months counted from there."""
    return F.datediff(F.make_date(1800 + F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1)), F.lit(CYCLE_START).cast("date"))


def _late_day(d: Column) -> Column:
    """The place of a day after the twelfth among all such days of the cycle."""
    months = (F.year(d) - 1800) * 12 + F.month(d)
    return F.datediff(d, F.lit(CYCLE_START).cast("date")) - 12 * months


def _of_late_day(place: Column) -> Column:
    """Days from CYCLE_START to the late day of a place: its month is within one of the average's guess."""
    before = lambda m: _first_of_month(m) - 12 * m
    last = F.lit(4799)
    guess = F.floor(place * 4800 / (LATE[0] * LATE[1])).cast("int")
    month = F.when((guess < last) & (before(F.least(guess + 1, last)) <= place), guess + 1).when(before(guess) <= place, guess).otherwise(guess - 1)
    return let(month, lambda m: place + 12 * m + 12)


def date_pseudonym(key: str, value: Column) -> Column:
    """Real days from 1800 to 2199, in the notation they came in."""

    def written(pattern: str) -> Column:
        return F.when(value.rlike(pattern), F.lit(True))

    def on(days: Column, fmt: str) -> Column:
        return F.date_format(F.date_add(F.lit(CYCLE_START).cast("date"), days.cast("int")), fmt)

    def moved(fmt: str, late: bool = False) -> Column:
        sizes = LATE if late else CYCLE

        def of(d: Column) -> Column:
            n = F.datediff(d, F.lit(CYCLE_START).cast("date"))
            place = _late_day(d) if late else n
            mixed = feistel(key, "late date" if late else "date", F.floor(place / sizes[1]), place % sizes[1], *sizes)
            back = let(mixed, lambda m: let(m["l"] * sizes[1] + m["r"], lambda x: on(_of_late_day(x) if late else x, fmt)))
            return F.when((n >= 0) & (n < CYCLE[0] * CYCLE[1]), back)

        return let(F.try_to_date(value, fmt), of)

    return F.coalesce(
        F.when(written(r"^\d{4}-"), moved("yyyy-MM-dd")),
        F.when(written(r"^\d{4}/"), moved("yyyy/MM/dd")),
        F.when(written(r"^\d{2}/"), F.coalesce(moved("MM/dd/yyyy"), F.when(F.substring(value, 1, 2) > "12", moved("dd/MM/yyyy", late=True)))),
        F.when(written(r"^\d{2}\."), moved("dd.MM.yyyy")),
    )


def phone_pseudonym(key: str, value: Column) -> Column:
    """Ten national digits: area and exchange codes stay in their ranges (200 to 999)."""

    def of(d: Column) -> Column:
        area, exchange, line = (F.substring(d, F.char_length(d) - a, F.lit(n)).cast("long") for a, n in ((9, 3), (6, 3), (3, 4)))
        mixed = feistel(key, "phone", area - 200, (exchange - 200) * 10000 + line, 800, 8_000_000)
        number = let(mixed, lambda m: F.concat((m["l"] + 200).cast("string"), (F.floor(m["r"] / 10000) + 200).cast("string"), F.lpad((m["r"] % 10000).cast("string"), 4, "0")))
        return F.when((area >= 200) & (exchange >= 200), let(number, lambda n: _pour(F.concat(F.substring(d, F.lit(1), F.char_length(d) - 10), n), value)))

    return let(_digits(value), of)


def social_pseudonym(key: str, value: Column) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""

    def of(d: Column) -> Column:
        area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
        ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        mixed = feistel(key, "social", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        back = lambda m: F.concat(F.lpad((m["l"] + F.when(m["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(m["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((m["r"] % 9999 + 1).cast("string"), 4, "0"))
        return F.when(ok, let(let(mixed, back), lambda n: _pour(n, value)))

    return let(_digits(value), of)


def mail_pseudonym(key: str, value: Column) -> Column:
    """The name is permuted within its shape, the domain stays.

    A name is two halves of places in their alphabets. In each round the places of one half move by
    keyed amounts that depend on the other half, modulo their alphabets' sizes, which can be undone.
    """

    place = lambda c: F.when(c.rlike("[a-z]"), F.ascii(c) - ord("a")).when(c.rlike("[0-9]"), F.ascii(c) - ord("0")).otherwise(F.lit(0))
    size = lambda c: F.when(c.rlike("[a-z]"), F.lit(26)).when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(1))
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")

    def mixed(cs: Column, tag: Column) -> Column:
        cut = F.floor(F.size(cs) / 2).cast("int")
        left, right = (lambda f: F.transform(F.slice(cs, F.lit(1), cut), f)), (lambda f: F.transform(F.slice(cs, cut + 1, F.size(cs) - cut), f))
        zero = F.struct(left(place).alias("a"), right(place).alias("b"), left(size).alias("of_a"), right(size).alias("of_b"))

        def step(x: Column, k: Column) -> Column:
            seed = F.sha2(F.concat(F.lit(f"{key}\x00inner\x00name"), k.cast("string"), F.lit("\x00"), tag, F.lit("\x00"), F.array_join(x["b"].cast("array<string>"), ",")), 256)
            by = lambda s, i: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}\x00outer\x00"), s, F.lit("\x00"), i.cast("string")), 256), 1, 6), 16, 10).cast("int")
            moved = let(seed, lambda s: F.transform(x["a"], lambda p, i: F.pmod(p + by(s, i), F.get(x["of_a"], i))))
            return F.struct(x["b"].alias("a"), moved.alias("b"), x["of_b"].alias("of_a"), x["of_a"].alias("of_b"))

        # an even number of rounds brings both halves back to their sides
        rounds = F.aggregate(F.sequence(F.lit(1), F.lit(NAME_ROUNDS)), zero.cast("struct<a:array<int>,b:array<int>,of_a:array<int>,of_b:array<int>>"), step, lambda x: F.concat(x["a"], x["b"]))
        return F.when(F.size(cs) > 0, rounds)

    def char(was: Column, at: Column) -> Column:
        letter = lambda first: F.char(at + ord(first))
        return F.when(was.rlike("[a-z]"), letter("a")).when(was.rlike("[A-Z]"), letter("A")).when(was.rlike("[0-9]"), letter("0")).otherwise(was)

    def of(v: Column) -> Column:
        whole, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
        marks = F.regexp_extract(whole, "^[._%+-]+", 0)
        name = F.regexp_replace(whole, "^[._%+-]+", "")
        shape = F.regexp_replace(F.regexp_replace(F.lower(name), "[a-z]", "a"), "[0-9]", "0")
        places = let(letters(F.lower(name)), lambda cs: mixed(cs, F.concat(F.lower(domain), F.lit("\x00"), shape)))
        return F.concat(marks, F.array_join(F.zip_with(letters(name), places, char), ""), F.lit("@"), domain)

    return let(value, of)


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of one match, or null if it isn't a valid value of its kind."""
    whole = lambda p: value.rlike(rf"^(?:{p})\z")
    return (
        F.when(F.contains(value, F.lit("@")), mail_pseudonym(key, value))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), address_pseudonym(key, value))
        .when(whole(r"[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\2[0-9]{4}"), date_pseudonym(key, value))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), social_pseudonym(key, value))
        .when(F.char_length(_digits(value)) <= 11, phone_pseudonym(key, value))
        .otherwise(card_pseudonym(key, value))
    )


def pseudonymise(docs: DataFrame, *, key: str = DEMO_KEY, text: str = "text") -> DataFrame:
    """``docs`` with every valid value in ``text`` replaced, and ``n_pseudonyms``."""
    body = F.col(text)
    found = F.transform(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("was"), pseudonym(key, m).alias("now")))

    def rebuilt(matches: Column) -> Column:
        rest = F.split(body, ANY, -1)
        joined = let(rest, lambda r: F.concat(F.element_at(r, 1), F.array_join(F.transform(matches, lambda m, i: F.concat(F.coalesce(m["now"], m["was"]), F.get(r, i + 1))), "")))
        return F.struct(joined.alias("text"), F.size(F.filter(matches, lambda m: m["now"].isNotNull())).cast("long").alias("n"))

    plain = F.struct(body.alias("text"), F.lit(0).cast("long").alias("n"))
    done = F.when(body.rlike(HINT), let(found, rebuilt)).otherwise(plain)
    others = [c for c in docs.columns if c != "n_pseudonyms"]
    made = fresh(docs, "done")
    return docs.withColumn(made, done).select(*(F.col(f"{made}.text").alias(c) if c == text else F.col(f"`{c}`") for c in others), F.col(f"{made}.n").alias("n_pseudonyms"))
