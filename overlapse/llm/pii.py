"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. The places of matches come from one pass: splitting at a pattern gives the
gaps between its leftmost non-overlapping matches, so a running sum of gap and match lengths gives each
start in code points. Look-behinds and possessive groups keep the patterns linear on long runs and off
the recursion of the regex engine; they match what the plain patterns match. An IBAN's pattern matches its
first four characters only, as a greedy run takes in capitals that follow: the end is the one the
country's length gives, for a code without a known length the longest that passes mod 97.

Spans: email, ip (parts to 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits); the method adds
iban (mod 97) and short_card (13 to 15 digits, Luhn), which count from a score of THRESHOLD on: a
checksum gives 0.6 (iban) or 0.4 (short_card), a fitting word in the CONTEXT characters before it 0.3.

Defined cases: null text counts as empty and has no spans; repeated rows get the same result each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapse.llm.common import named, private

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
KINDS = ("email", "ip", "card", "phone", "iban", "short_card")
BASE = KINDS[:4]
CONTEXT = 48
THRESHOLD = 0.5
#: Words that speak for a kind.
WORDS = {
    "email": r"mail|contact|kontakt|correo|courriel|write to",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|credit|karte|tarjeta|carte|payment",
    "phone": r"phone|tel|call|mobile|anruf|llam",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "short_card": r"card|amex|credit|karte|tarjeta|carte|payment",
}
SURE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.6, "short_card": 0.4}

#: Characters of an IBAN by country.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HN HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    def add(a: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + v - F.when(v > 9, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _mod97(m: Column) -> Column:
    d = F.regexp_replace(m, " ", "")
    d = F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))
    def add(r: Column, i: Column) -> Column:
        c = F.ascii(F.substring(d, i, F.lit(1)))
        return F.when(c < 65, r * 10 + c - 48).otherwise(r * 100 + c - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) == 1


def _ip(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))


def _iban(text: Column) -> Column:
    """The IBAN at the start of a text, with its spaces; NULL where there is none."""
    known = F.create_map(*[F.lit(x) for n, codes in IBAN_LENGTH.items() for c in codes.split() for x in (c, n)])
    length = F.try_element_at(known, F.substring(text, 1, 2))
    ends = F.when(length.isNotNull(), F.array(length)).otherwise(F.sequence(F.lit(34), F.lit(15), F.lit(-1)))
    cut = lambda n: F.regexp_substr(text, F.concat(F.lit(r"^(?:\x20?[A-Z0-9]){"), n.cast("string"), F.lit(r"}(?![A-Za-z0-9])")))
    return F.get(F.filter(F.transform(ends, cut), lambda m: F.when(m.isNotNull(), _mod97(m)).otherwise(F.lit(False))), 0)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _guarded(low: int, high: int, check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: F.when(_between(F.length(_digits(m)), low, high), check(m)).otherwise(F.lit(False))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": _ip,
    "card": _guarded(16, 19, _luhn),
    "phone": lambda m: _between(F.length(_digits(m)), 8, 15),
    "iban": lambda m: m.isNotNull(),
    "short_card": _guarded(13, 15, _luhn),
}
PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "short_card": CARD}
#: What a text must hold for a pattern to have any match; a cheap test before the costly one.
NEEDS = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"), "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), "short_card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
}


def _found(t: str, gaps: str, hits: str, kind: str) -> Column:
    """The confirmed spans of a kind, from the gaps and the matches of its pattern."""
    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["g"])
        after = start + F.length(x["m"])
        if kind != "iban":
            return F.struct(after.alias("at"), added(s["spans"], start, x["m"]).alias("spans"))
        # 34 characters with single spaces, and the one that follows; one inside another is not taken
        whole = F.when(start >= F.coalesce(F.try_element_at(s["spans"], F.lit(-1))["end"], F.lit(0)), _iban(F.substring(F.col(t), start + 1, F.lit(68))))
        return F.struct(after.alias("at"), F.get(F.transform(F.array(whole), lambda m: added(s["spans"], start, m)), 0).alias("spans"))
    def added(spans: Column, start: Column, m: Column) -> Column:
        end = start + F.length(m)
        before = F.lower(F.substring(F.col(t), F.greatest(F.lit(1), start + 1 - CONTEXT), F.least(F.lit(CONTEXT), start)))
        score = F.lit(SURE[kind]) + F.when(before.rlike(WORDS[kind]), 0.3).otherwise(0.0)
        ok = VALID[kind](m) & (F.lit(kind in BASE) | (score >= THRESHOLD))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.least(F.lit(1.0), score).alias("score"))
        return F.when(ok, F.concat(spans, F.array(span).cast(SPAN))).otherwise(spans)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(F.size(hits) > 0, F.aggregate(both, zero, step)["spans"]).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, text: str, spans: str) -> DataFrame:
    """docs with columns of these names, the text and all spans by kind as listed, then start."""
    d = docs.withColumn(text, F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    patterns = {p: next(k for k in KINDS if PATTERN[k] == p) for p in dict.fromkeys(PATTERN.values())}
    hits, gaps = ({k: f"{spans}_{x}_{k}" for k in patterns.values()} for x in ("hits", "gaps"))
    d = d.withColumns({hits[k]: F.when(NEEDS[k](F.col(text)), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for p, k in patterns.items()})
    d = d.withColumns({gaps[k]: F.when(F.size(hits[k]) > 0, F.split(text, p, -1)).otherwise(none) for p, k in patterns.items()})
    d = d.withColumn(spans, F.concat(*[_found(text, gaps[patterns[PATTERN[k]]], hits[patterns[PATTERN[k]]], k) for k in KINDS]))
    return d.drop(*hits.values(), *gaps.values())


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """The spans of every document row, with counts and a digest of the base kinds."""
    d = with_spans(docs.select("doc_id", "text"), "__t", "__spans")
    of = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("__spans", lambda s: s["kind"].isin(*BASE))
    scored = F.array_join(F.transform("__spans", lambda s: F.format_number(s["score"], 2)), ",")
    return d.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans"), scored.alias("scores"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    own = private(docs)
    text, spans, order, parts = own("text"), own("spans"), own("order"), own("parts")
    d = with_spans(docs, text, spans)
    piece = "array<struct<start:int,end:int,kind:string>>"
    # longer spans first at the same start
    d = d.withColumn(order, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))))
    def merge(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        end = -s["back"]
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["kind"].alias("kind"))).cast(piece))
        return F.when((F.size(a) > 0) & (s["start"] < F.try_element_at(a, F.lit(-1))["end"]), joined).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))).cast(piece)))
    d = d.withColumn(parts, F.when(F.size(order) > 0, F.aggregate(order, F.array().cast(piece), merge)))
    cut = lambda s, e: F.substring(F.col(text), s + 1, e - s)
    put = F.transform(parts, lambda s, i: F.concat(cut(F.when(i > 0, F.get(parts, i - 1)["end"]).otherwise(0), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    new = F.concat(F.array_join(put, ""), cut(F.element_at(parts, -1)["end"], F.length(text)))
    d = d.withColumn("text", F.when(F.col(parts).isNotNull(), new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(parts).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return d.select(*map(named, docs.columns))
