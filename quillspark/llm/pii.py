"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

A value is found by pattern, validated, read as an array of small integers with a radix each, and
permuted by a keyed Feistel network over that mixed-radix domain: in each round one half is moved,
radix by radix, by digits of SHA-512 of key, kind, round and the other half (of these and a number for each 24 values
beyond the first 24). Whatever the radices, that is
a permutation of the kind's valid values, so equal values get equal pseudonyms in all documents
and different values different ones, and a pseudonym passes the same validation:

card    13-19 digits that start with 2-6 and pass Luhn's check; the check digit is computed anew
phone   North American numbers after +1, with the area in brackets, or with an area and
        an exchange from 200 on; the two keep starting with 2-9 or with 0-1
ssn     social security numbers: area 001-899 but 666, group 01-99, serial 0001-9999
ip      IPv4 addresses, four octets
date    yyyy-MM-dd, yyyy/MM/dd, dd.MM.yyyy and dd/MM/yyyy from 1800 to 2199: 146097 = 189 * 773 days
email   letters and digits of the local part and the first domain label, each within its class
secret  quoted values of token, secret, password or key: hexadecimal ones stay so

Separators stay where they are, and the value is the digits alone. What looks like one of these but
is not valid stays as it is.

One narrow pass: a text without a digit or an at sign is not touched; others are cut at all matches
of one pattern, and only the cuts' values are computed. A null text stays null; an empty one stays
empty; texts and values of any length are rewritten whole. Where patterns overlap, the match that begins first wins, of
those that begin together the first kind in the order above. Extra columns pass through, but for one named `found`,
which is replaced; rows that repeat get the same pseudonyms. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

ROUNDS = 8
#: Values that one digest moves, by five of its digits each.
STEPS = 24
#: Patterns of what may be a value, by kind; first match wins.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api_?key|key)\s*[=:]\s*\"[A-Za-z0-9+/_-]{8,}+\")",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w/.-])(?:[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4})(?![\w/-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?|\([0-9]{3}\) ?[0-9]{3}[ .-]|(?<![\w.-])[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-])[0-9]{4}(?!\w)",
    "card": r"(?<![\w.-])[2-6](?:[ -]?[0-9]){12,18}(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Marks a cut; a text's own mark is doubled by another sign meanwhile.
CUT, OWN = "\u0001\u0003", "\u0001\u0002"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, radices: Column, kind: str, key: str) -> Column:
    """The permuted values; both arrays of long, of one length."""

    def whole(pair: Column) -> Column:
        radix = pair["radices"]
        half = (F.size(radix) / 2).cast("int")

        def one_round(acc: Column, k: Column) -> Column:
            first = k % 2 == 0
            other = F.when(first, F.slice(acc, half + 1, F.size(acc) - half)).otherwise(F.slice(acc, F.lit(1), half))
            blocks = F.sequence(F.lit(0), F.greatest(((F.size(acc) - 1) / STEPS).cast("int"), F.lit(0)))
            digest = F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"), other.cast("string"), F.when(b > 0, b.cast("string"))), 512))

            def moved(h: Column) -> Column:
                step = lambda i: F.conv(F.substr(F.get(h, (i / STEPS).cast("int")), (i % STEPS) * 5 + 1, F.lit(5)), 16, 10).cast("long")
                return F.transform(acc, lambda v, i: F.when(first == (i < half), F.pmod(v + step(i), F.get(radix, i))).otherwise(v))

            return let(digest, moved)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair["values"], one_round)

    return let(F.struct(values.alias("values"), radices.alias("radices")), whole)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def numbers(digits: Column) -> Column:
    return F.transform(F.split(digits, ""), lambda c: c.cast("long"))


def into_format(x: Column, digits: Column) -> Column:
    """x with its digits replaced in order by those of `digits`."""
    return let(digits, lambda d: F.array_join(F.transform(F.split(x, ""), lambda c, i: F.when(c.between("0", "9"), F.substr(d, F.length(digits_of(F.substr(x, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""))


def luhn_sum(digits: Column, odd: int) -> Column:
    """Sum with every second digit doubled, from the right; odd: 1 if the last one is not doubled."""
    return F.aggregate(F.transform(F.reverse(numbers(digits)), lambda d, i: F.when(i % 2 == odd, d * 2 - F.when(d > 4, F.lit(9)).otherwise(0)).otherwise(d)), F.lit(0).cast("long"), lambda acc, d: acc + d)


def _card(x: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        low = F.transform(numbers(body), lambda v, i: F.when(i == 0, F.lit(2)).otherwise(0).cast("long"))
        radices = F.transform(low, lambda v: F.when(v == 2, F.lit(5)).otherwise(10).cast("long"))
        new = F.array_join(F.zip_with(feistel(F.zip_with(numbers(body), low, lambda a, b: a - b), radices, "card", key), low, lambda a, b: a + b), "")
        full = let(new, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, 1) % 10 == 0, into_format(x, full))

    return let(digits_of(x), made)


def _phone(x: Column, key: str) -> Column:
    national = F.substr(digits_of(x), F.length(digits_of(x)) - 9, F.lit(10))
    low = F.transform(numbers(national), lambda v, i: F.when(i.isin(0, 3) & (v >= 2), F.lit(2)).otherwise(0).cast("long"))
    radices = F.transform(numbers(national), lambda v, i: F.when(~i.isin(0, 3), F.lit(10)).when(v >= 2, F.lit(8)).otherwise(2).cast("long"))
    new = F.array_join(F.zip_with(feistel(F.zip_with(numbers(national), low, lambda a, b: a - b), radices, "phone", key), low, lambda a, b: a + b), "")
    lead = F.substr(digits_of(x), F.lit(1), F.length(digits_of(x)) - 10)
    return into_format(x, F.concat(lead, new))


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substr(x, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    new = feistel(values, F.array(*[F.lit(r).cast("long") for r in (898, 99, 9999)]), "ssn", key)
    text = let(new, lambda v: F.concat_ws("-", F.lpad((F.get(v, F.lit(0)) + F.when(F.get(v, F.lit(0)) >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.get(v, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(v, F.lit(2)) + 1).cast("string"), 4, "0")))
    return F.when(valid, text)


def _ip(x: Column, key: str) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    new = feistel(octets, F.array(*[F.lit(256).cast("long")] * 4), "ip", key)
    return F.when(F.forall(octets, lambda o: o < 256), F.array_join(new, "."))


def _date(x: Column, key: str) -> Column:
    iso = F.substr(x, F.lit(5), F.lit(1)).isin("-", "/")
    sign = F.when(iso, F.substr(x, F.lit(5), F.lit(1))).otherwise(F.substr(x, F.lit(3), F.lit(1)))
    plain = F.when(iso, F.translate(x, "/", "-")).otherwise(F.concat_ws("-", F.substr(x, F.lit(7), F.lit(4)), F.substr(x, F.lit(4), F.lit(2)), F.substr(x, F.lit(1), F.lit(2))))
    first = F.to_date(F.lit("1800-01-01"))

    def made(day: Column) -> Column:
        n = F.datediff(day, first).cast("long")
        new = feistel(F.array(F.floor(n / 773), n % 773), F.array(F.lit(189).cast("long"), F.lit(773).cast("long")), "date", key)
        at = let(new, lambda v: F.date_add(first, (F.get(v, F.lit(0)) * 773 + F.get(v, F.lit(1))).cast("int")))
        text = let(at, lambda d: F.when(iso, F.concat_ws("-", F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd"))).otherwise(F.concat_ws("-", F.date_format(d, "dd"), F.date_format(d, "MM"), F.date_format(d, "yyyy"))))
        return F.when(n.between(0, 146096), F.replace(text, F.lit("-"), sign))

    return let(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")).cast("date"), made)


def _classed(x: Column, kind: str, key: str) -> Column:
    """Letters and digits moved within their class, all other signs kept."""
    code = lambda c: F.ascii(c).cast("long")
    low = lambda c: F.when(c.between("0", "9"), F.lit(48)).when(c.between("a", "z"), F.lit(97)).when(c.between("A", "Z"), F.lit(65)).otherwise(code(c)).cast("long")
    radix = lambda c: F.when(c.between("0", "9"), F.lit(10)).when(c.between("a", "z") | c.between("A", "Z"), F.lit(26)).otherwise(F.lit(1)).cast("long")
    chars = F.split(x, "")
    new = feistel(F.transform(chars, lambda c: code(c) - low(c)), F.transform(chars, radix), kind, key)
    return F.array_join(F.zip_with(new, chars, lambda v, c: F.char(v + low(c))), "")


def _email(x: Column, key: str) -> Column:
    """The first domain label goes along, so that a short local part has company."""
    head = F.regexp_extract(x, r"^([^@]+@[^.]+)", 1)
    return F.concat(_classed(head, "email", key), F.substr(x, F.length(head) + 1, F.length(x)))


def _secret(x: Column, key: str) -> Column:
    value = F.regexp_extract(x, "\"([^\"]+)\"$", 1)
    hexed = F.transform(F.split(value, ""), lambda c: F.conv(c, 16, 10).cast("long"))
    as_hex = F.lower(F.array_join(F.transform(feistel(hexed, F.transform(hexed, lambda v: F.lit(16).cast("long")), "secret", key), lambda v: F.hex(v)), ""))
    new = F.when(value.rlike("^[0-9a-f]+$"), as_hex).otherwise(_classed(value, "secret", key))
    return F.concat(F.substr(x, F.lit(1), F.length(x) - F.length(value) - 1), new, F.lit('"'))


MADE = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(x: Column, key: str) -> Column:
    """(kind, text) for a value, null if it is not valid."""
    out = F.lit(None).cast("struct<kind:string,text:string>")
    case = None
    for kind, pattern in PATTERNS.items():
        is_kind = x.rlike(f"^(?:{pattern})$")
        new = F.struct(F.lit(kind).alias("kind"), MADE[kind](x, key).alias("text"))
        case = F.when(is_kind, new) if case is None else case.when(is_kind, new)
    found = case.otherwise(out)
    return let(found, lambda f: F.when(f["text"].isNotNull(), f))


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with `text` rewritten and `found`, an array of (kind, text) of the pseudonyms in order."""
    body = F.col(text)
    marked = F.regexp_replace(F.replace(body, F.lit("\u0001"), F.lit(OWN)), f"({ANY})", f"{CUT}$1{CUT}")
    cuts = F.when(body.rlike("[0-9@\"]"), F.split(marked, CUT))
    at, new = free_name(docs, "_cuts"), free_name(docs, "_new")
    df = docs.withColumn(at, cuts)
    parts = F.transform(at, lambda x, i: F.when(i % 2 == 1, pseudonym(x, key)))
    df = df.withColumn(new, F.when(F.size(at) > 1, parts))
    joined = F.array_join(F.zip_with(at, new, lambda x, n: F.coalesce(n["text"], x)), "")
    df = df.withColumn(text, F.when(F.col(new).isNotNull(), F.replace(joined, F.lit(OWN), F.lit("\u0001"))).otherwise(body))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    return df.withColumn("found", F.coalesce(F.filter(new, lambda n: n.isNotNull()), none)).drop(at, new)


KEY = "an example key; pass your own"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    counts = [F.size(F.filter(F.transform("found", lambda f: f["kind"]), F.lit(kind).eqNullSafe)).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return done.select("doc_id", "text", F.transform("found", lambda f: f["text"]).alias("pseudonyms"), *counts)


QUERIES = {"op6_pseudonyms": op6_pseudonyms}
SQL: dict[str, str] = {}
