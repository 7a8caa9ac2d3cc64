"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from pyspark.sql import Column, DataFrame, functions as F

from hoplens.llm import spans
from hoplens.llm.common import whole_text

# Lengths of account numbers by country, those of the registry and, at the end, those in use without an entry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST AO CV GW MZ",
    26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
ACCOUNTS = "|".join(
    rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, countries in IBAN_LENGTHS.items()
)

# The shapes proposed. Repetitions that nothing follows are possessive, so that long runs need no deep
# stack; a look behind keeps long runs from being searched again from each of their characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{ACCOUNTS})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Score without context, and the words that raise it by BOOST.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|credit|visa|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security",
}
BOOST = 0.3
#: Kinds of which a match that isn't confirmed hides none that starts inside it.
INSIDE = ("iban",)
#: An added kind below this score is no span. The base kinds stay at any score.
LEAST_SCORE = 0.5
BASE = ("email", "ip", "card", "phone")

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(turned, place, F.lit(1)).cast("int")
        double = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces has the remainder 1 of ISO 7064."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, sign: Column) -> Column:
        return F.when(sign.rlike("[0-9]"), (rest * 10 + F.ascii(sign) - 48) % 97).otherwise((rest * 100 + F.ascii(sign) - 55) % 97)

    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), add) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    return F.lit(True)


def _need(kind: str, text: Column) -> Column:
    sign = {"email": "@", "phone": "+", "ssn": "-"}.get(kind)
    return text.contains(sign) if sign else text.rlike("[0-9]")


def _score(span: Column) -> Column:
    score = F.lit(0.0)
    for kind, words in WORDS.items():
        near = F.concat_ws(" ", span["before"], span["after"]).rlike(rf"(?i)(?<![a-z])(?:{words})")
        score = F.when(
            span["kind"] == kind, F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, BOOST).otherwise(0.0))
        ).otherwise(score)
    return score


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data of every row.

    Returns ``doc_id`` and ``found``, an array of ``start, end, kind, value, score, base`` by start and kind, one row per
    input row; other columns are not read. A null text counts as empty and has no spans; repeated rows are searched each.
    Kinds are searched apart, so spans of two kinds may overlap.
    """
    text = whole_text()
    every = [
        spans.find(text, pattern, kind, rank, lambda value, kind=kind: _confirmed(kind, value), _need(kind, text), kind in INSIDE)
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
    ]
    scored = F.transform(
        F.col("__spans"),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
            s["value"].alias("value"),
            _score(s).alias("score"),
            s["kind"].isin(*BASE).alias("base"),
        ),
    )
    return docs.select("doc_id", spans.in_order(*every).alias("__spans")).select(
        "doc_id", F.filter(scored, lambda s: s["base"] | (s["score"] >= LEAST_SCORE)).alias("found")
    )
