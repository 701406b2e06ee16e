"""Personal data: regular expressions propose, checksums confirm, context scores [native].

For each kind one pattern proposes leftmost non-overlapping spans. A validator
drops what cannot be that kind (Luhn for cards, mod-97 for account numbers, byte
range for addresses, digit count for phones). Words nearby raise or lower the
score of a span; kinds without a checksum of their own need a score of
``threshold`` to count.

The patterns are linear: quantifiers are possessive or fixed, and a look-behind
starts a candidate only where the run of its characters starts. Places are
running sums over the pieces of a text, so work grows with a text's length even
if it is all spans; very long texts are read whole.

Nulls: a null text is empty and has no spans. Ids are carried as they are,
repeated rows give repeated results, an empty table gives an empty one. Spans of
one kind never overlap, so there are no ties. Only the id and text columns are
read: further columns, whatever their names, change nothing and aren't returned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in the order of the report, and the added kinds.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Length of an account number (IBAN) by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: A value behind a word like token, in any case, or behind "Bearer"; a key's first line; a value with a provider's prefix; a signed web token.
SECRET = (
    r"(?i:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?[A-Za-z0-9_+/.-]{16,}+={0,2}"
    r"|(?i:bearer)\x20[A-Za-z0-9_+/.-]{16,}+={0,2}"
    r"|-----BEGIN\x20(?:[A-Z]++\x20){0,3}PRIVATE\x20KEY-----|(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
)
#: In lower case; a text without any of these has no secret.
SECRET_HINTS = ("token", "secret", "key", "passw", "pwd", "bearer", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyj")
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words that speak for a kind, or against any kind, within CONTEXT code points before a span.
CONTEXT = 40
#: Places that one step of a running sum covers.
BLOCK = 256
FOR = {
    "email": r"e-?mail|contact|write to|reach",
    "ip": r"(?:^|[^a-z0-9_])ip(?:$|[^a-z0-9_])|address|host|server|login",
    "card": r"card|visa|credit|payment|debit",
    "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "ssn": r"(?:^|[^a-z0-9_])ssn(?:$|[^a-z0-9_])|social security|taxpayer",
    "secret": r"token|secret|key|passw|bearer",
}
AGAINST = r"example|sample|dummy|order no|part no|serial"


def iban_pattern() -> str:
    """Account numbers of each country's own length, in groups of four with or without spaces."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTH.items():
        by_length.setdefault(n, []).append(country)
    kinds = []
    for n, countries in sorted(by_length.items()):
        fours, rest = divmod(n - 4, 4)
        tail = rf"(?:\x20?[A-Z0-9]{{{rest}}})" if rest else ""
        kinds.append(rf"(?:{'|'.join(countries)})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(kinds)})(?![A-Za-z0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["n"] % 2 == 1, 2).otherwise(1)
        return F.struct((acc["n"] + 1).alias("n"), (acc["s"] + F.when(d > 9, d - 9).otherwise(d)).alias("s"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, step, lambda a: a["s"] % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)


def _iban(m: Column) -> Column:
    return mod97(F.replace(m, F.lit(" "), F.lit("")))


def _secret(m: Column) -> Column:
    """A key's first line, or a value of letters and digits."""
    return m.startswith("-----") | m.rlike("[0-9][^=:]*$")


def _always(m: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: object
    hint: tuple[str, ...]  # a text without any of these, in any case, has no such span; none if empty
    base: float  # the score without context
    always: bool  # counts whatever the context
    own: str = ""  # the end of a match that is the span, if not all of it


KINDS = (
    Kind("email", EMAIL, _always, ("@",), 0.9, True),
    Kind("ip", IP, lambda m: m.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"), (".",), 0.6, True),
    Kind("card", CARD, _card, (), 0.9, True),
    Kind("phone", PHONE, lambda m: F.length(_digits(m)).between(8, 15), ("+",), 0.6, True),
    Kind("iban", iban_pattern(), _iban, (), 0.9, False),
    Kind("ssn", SSN, lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), ("-",), 0.3, False),
    Kind("secret", SECRET, _secret, SECRET_HINTS, 0.6, False, r"(?:[A-Za-z0-9_+/.-]{16,}={0,2}|-----BEGIN[A-Z\x20]+-----)$"),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running_starts(sizes: Column) -> Column:
    """The sum of all sizes before each one.

    Sums run in blocks of BLOCK, then over the blocks, so that no array is
    copied once an element: BLOCK / 2 copies an element instead of n / 2.
    """

    def grown(acc: Column, by: Column) -> Column:
        return F.struct((acc["at"] + by).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def begun(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda a, x: a + x)

    def in_blocks(blocks: Column) -> Column:
        before = F.aggregate(blocks, begun(F.lit(0)), lambda a, b: grown(a, total(b)), lambda a: a["out"])
        return let(before, lambda o: F.flatten(F.transform(blocks, lambda b, k: F.aggregate(b, begun(F.get(o, k)), grown, lambda a: a["out"]))))

    def cut(all_sizes: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(all_sizes) - 1) / BLOCK).cast("int"))
        return F.transform(places, lambda b: F.slice(all_sizes, b * BLOCK + 1, BLOCK))

    return let(sizes, lambda s: let(cut(s), in_blocks))


def find_spans(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, score>> of the confirmed spans, in code points.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the
    matches; summing both lengths gives each place in one pass. The context is
    taken from the pieces just before a match, never by counting from the text's
    start, so that work grows with the text and not with its spans as well.
    """
    span = "array<struct<start:int,end:int,score:double>>"
    none = F.array().cast(span)

    def length(p: Column) -> Column:
        return F.char_length(p["gap"]) + F.coalesce(F.char_length(p["hit"]), F.lit(0))

    def before(parts: Column, p: Column, i: Column) -> Column:
        """At most CONTEXT code points before the match; each earlier piece has one at least."""
        first = F.greatest(i - CONTEXT, F.lit(0))
        earlier = F.transform(F.slice(parts, first + 1, i - first), lambda q: F.concat(F.right(q["gap"], F.lit(CONTEXT)), q["hit"]))
        all_of_it = F.concat(F.array_join(earlier, ""), p["gap"])
        return F.lower(F.right(F.when(F.char_length(p["gap"]) >= CONTEXT, p["gap"]).otherwise(all_of_it), F.lit(CONTEXT)))

    def score(near: Column) -> Column:
        s = F.lit(kind.base) + F.when(near.rlike(FOR[kind.name]), 0.3).otherwise(0.0) - F.when(near.rlike(AGAINST), 0.3).otherwise(0.0)
        return F.round(F.least(s, F.lit(1.0)), 2)

    def placed(parts: Column) -> Column:
        starts = running_starts(F.transform(parts, length))
        tied = F.transform(F.arrays_zip(parts.alias("p"), starts.alias("at")), lambda x, i: F.struct(x["p"].alias("p"), x["at"].alias("at"), i.alias("i")))
        valid = F.filter(tied, lambda x: F.coalesce(x["p"]["hit"].isNotNull() & kind.valid(x["p"]["hit"]), F.lit(False)))

        def one(x: Column) -> Column:
            hit = x["p"]["hit"]
            end = x["at"] + length(x["p"])
            near = before(parts, x["p"], x["i"])
            start = x["at"] + F.char_length(x["p"]["gap"])
            if kind.own:  # what leads to it in the match is context
                size = F.char_length(F.regexp_extract(hit, kind.own, 0))
                start, near = end - size, F.right(F.concat(near, F.lower(F.left(hit, F.char_length(hit) - size))), F.lit(CONTEXT))
            return F.struct(start.alias("start"), end.alias("end"), score(near).alias("score"))

        return F.transform(valid, one).cast(span)

    def pieces(hits: Column) -> Column:
        return F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), hits.alias("hit"))

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda h: F.when(F.size(h) > 0, let(pieces(h), placed)).otherwise(none))
    if not kind.hint:
        return found
    any_of = lambda low: reduce(or_, [F.contains(low, F.lit(h)) for h in kind.hint])
    hinted = any_of(text) if len(kind.hint) == 1 else let(F.lower(text), any_of)
    return F.when(hinted, found).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, then for each kind ``<kind>``: array<struct<start, end, score>>)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = []
    for kind in KINDS:
        found = find_spans(text, kind)
        cols.append((found if kind.always else F.filter(found, lambda s: s["score"] >= threshold)).alias(f"_{kind.name}"))
    out = docs.select(F.col(id_col), *cols)
    return out.select(F.col(id_col), *[F.col(f"_{k.name}").alias(k.name) for k in KINDS])


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`find_pii`: counts, spans as kind:start:end, and the highest score of a span, 0 if there is none."""
    found = find_pii(docs)

    def listed(kinds: tuple[Kind, ...]) -> Column:
        return F.concat_ws(",", F.flatten(F.array(*[_named(k.name) for k in kinds])))

    base = KINDS[:4]
    counts = {k.name: F.size(k.name).cast("long") for k in KINDS}
    added = [counts[k.name].alias(f"n_{k.name}") for k in KINDS[4:]]
    top = F.greatest(*[F.array_max(F.transform(k.name, lambda s: s["score"])) for k in KINDS])
    every = sum(counts.values(), F.lit(0).cast("long")).alias("n_spans")
    return found.select("doc_id", *[counts[k.name].alias(f"n_{k.name}") for k in base], F.sha2(listed(base), 256).alias("base_sha256"), listed(KINDS).alias("spans"), *added, every, F.coalesce(top, F.lit(0.0)).alias("top_score"))
