"""Personal data, in DataFrame functions alone.

Regular expressions propose spans, checksums and other validators confirm them (Luhn for card numbers, mod-97
for bank accounts), and words nearby adjust a confirmed span's score: those up to `window` characters before it, a
match of the kind directly before it and what stands before that included, and half as many after it. Base kinds
(email, ip, card, phone) stay whatever their score; the further kinds (iban, ssn, secret, jwt, key) need a score of
at least `threshold`.

Everything happens within a row, without a shuffle. A text is split at a kind's matches; running sums of the
lengths of the pieces, by doubling strides, give the places of m matches in m log m steps. The expressions
below don't backtrack over long runs and don't recurse, so very long texts are safe: a match may start only
where no earlier one in the same run could, and repeats are possessive.

Places are code points, the end exclusive. Null text is empty. doc_id may be null; repeated rows give a row
each; further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import let

SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether digits pass: every other one from the right is doubled (5 to 9 become 1, 3, 5, 7, 9), and 10 divides the sum."""
    plain, n = F.reverse(x), F.length(x)
    doubled = F.translate(plain, "0123456789", "0246813579")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substr(plain, i, F.lit(1))).otherwise(F.substr(doubled, i, F.lit(1))).cast("int"))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def mod97(x: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, letters as 10 to 35, leave 1 when divided by 97."""
    moved = F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(moved)), F.lit(0),
        lambda a, i: let(F.ascii(F.substr(moved, i, F.lit(1))), lambda c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)),
    )
    return rest == 1


def _card(x: Column) -> Column:
    return let(_digits(x), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))


def _phone(x: Column) -> Column:
    return F.length(_digits(x)).between(9, 15)


def _ip(x: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return x.rlike(f"^{part}(?:\\.{part}){{3}}$")


def _iban(x: Column) -> Column:
    return let(F.replace(x, F.lit(" "), F.lit("")), lambda s: F.length(s).between(15, 34) & mod97(s))


def _ssn(x: Column) -> Column:
    return x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _secret(x: Column) -> Column:
    return x.rlike("[0-9]") & x.rlike("[A-Za-z]")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirm: Callable[[Column], Column] | None
    score: float
    context: str  # words that raise the score by `raised` if they stand just before or after
    raised: float
    base: bool


#: The base patterns match what the plain forms in their comments match, leftmost and without overlap.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", None, 0.9, "mail|contact|write|reach", 0.1, True),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", _ip, 0.6, "\\bip\\b|host|server|address|login", 0.3, True),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", "[0-9](?:[\\x20-]?[0-9])++", _card, 0.7, "card|visa|credit|debit|payment|pay", 0.3, True),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", _phone, 0.6, "phone|tel|call|mobile|fax|contact", 0.3, True),
    Kind("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\\x20[A-Z0-9]{4}){2,7}(?:\\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", _iban, 0.8, "iban|bank|account|konto|cuenta|compte", 0.2, False),
    Kind("ssn", "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _ssn, 0.3, "ssn|social|security", 0.5, False),
    Kind("secret", "(?<![A-Za-z0-9])[0-9A-Za-z_-]{24,}+(?![A-Za-z0-9])", _secret, 0.2, "token|secret|passw|api.?key|\\bkey\\b|bearer|credential", 0.6, False),
    Kind("jwt", "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", None, 0.8, "token|bearer|authori[sz]ation", 0.2, False),
    Kind("key", "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[^-]*+(?:-{1,2}[^-]++){0,8}+(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?", None, 0.9, "key", 0.1, False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _running(x: Column) -> Column:
    """Running sums of an array: each stride doubles the reach."""
    strides = F.when(F.size(x) > 1, F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(x).cast("double"))).cast("int") - 1), lambda r: F.pow(F.lit(2), r).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(strides, x, lambda a, stride: F.transform(a, lambda v, i: v + F.when(i >= stride, F.get(a, i - stride)).otherwise(F.lit(0).cast("long"))))


def find(text: Column, kind: Kind, threshold: float, window: int = 40) -> Column:
    """Confirmed spans of one kind, in order."""
    empty = F.array().cast(SPAN)

    def placed(hits: Column) -> Column:
        return let(F.split(text, kind.pattern, -1), lambda gaps: let(_running(F.transform(hits, lambda h, i: (F.char_length(F.get(gaps, i)) + F.char_length(h)).cast("long"))), lambda ends: scored(hits, gaps, ends)))

    def scored(hits: Column, gaps: Column, ends: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            earlier = F.concat(F.right(F.coalesce(F.get(gaps, i - 1), F.lit("")), F.lit(window)), F.coalesce(F.get(hits, i - 1), F.lit("")), F.right(F.get(gaps, i), F.lit(window)))
            near = F.lower(F.concat(F.when(i > 0, F.right(earlier, F.lit(window))).otherwise(F.right(F.get(gaps, i), F.lit(window))), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(window // 2))))
            score = F.lit(kind.score) + F.when(near.rlike(kind.context), kind.raised).otherwise(0.0)
            sure = kind.confirm(h) if kind.confirm else F.lit(True)
            return F.struct(F.lit(kind.name).alias("kind"), (F.get(ends, i) - F.char_length(h)).alias("start"), F.get(ends, i).alias("end"), F.when(sure, F.least(score, F.lit(1.0))).otherwise(-1.0).alias("score"))

        return F.filter(F.transform(hits, one), lambda s: s["score"] >= (0.0 if kind.base else threshold)).cast(SPAN)

    return let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, empty).otherwise(placed(hits)))


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and pii: spans (kind, start, end, score) of each document (doc_id, text), by kind as listed, then place."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.concat(*[find(text, kind, threshold) for kind in KINDS]).alias("pii"))


def digest(found: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("pii", lambda s: s["kind"])
    count = lambda k: (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
    more = [count(k.name) for k in KINDS if not k.base]
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), *more, F.size("pii").cast("long").alias("n_spans"))
