"""Personal data by rules: expressions propose spans, checksums confirm them, nearby words adjust a score.

All of it is column expressions. For each kind the whole text is cut at its matches (``split``), so the lengths of
what lies between them give the positions in code points. The proposing patterns are written with possessive
quantifiers and look-behinds; they match what the plain forms in KINDS match, without going back over long runs.

Base kinds (email, ip, card, phone) are kept whenever they are valid. The method's own kinds are kept if their score
reaches ``least``: iban (a mod-97 checksum confirms it) and national phone numbers and social security numbers,
which have no checksum and so need a word such as "phone" or "ssn" within 40 code points.

Defined results: a null or empty text has no spans; repeated rows are searched each by itself; an empty table
gives no rows; other columns are left alone, but one that is named like the output (``pii``) is replaced by it. Spans
that tie on their start are in the order of ALL_KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms that the base kinds have to match, leftmost and not overlapping within a kind (fixed values).
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters of an account number without blanks, by country (fixed values of the public registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS",
    23: "AE|GI|IL|IQ|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC",
}
#: The same languages for Java, each run of characters read once.
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b(?:" + "|".join(rf"(?:{countries})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items()) + r")(?![A-Z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: A text without this can't match.
NEEDS = {"email": "@", "phone": "+"}
BASE_KINDS = tuple(KINDS)
ALL_KINDS = tuple(FAST)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Score before context, and the words whose presence nearby raises it by 0.3.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local_phone": 0.4}
CONTEXT = {
    "email": "mail|contact|contacto|kontakt|courriel|correo",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|telephone|telefono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "local_phone": "phone|tel|call|mobile|fax|telefon|telephone|telefono",
}
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Folds gather so many values before they go to the list of lists, so that appending isn't quadratic in the matches of a text.
GATHER = 256
#: Redaction lets go of text behind it after so many characters.
BEHIND = 1 << 16


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """True if the string of digits passes: every second digit from the right is doubled, digits summed."""
    n = F.length(c)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + F.when((n - i) % 2 == 0, F.substring(c, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(c, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(c, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return total % 10 == 0


def mod97(c: Column) -> Column:
    """True if an account number in capitals without blanks passes: first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substring(c, 5, 1000), F.substring(c, 1, 4))
    step = lambda r, x: F.when(x.rlike("[0-9]"), (r * 10 + F.ascii(x) - 48) % 97).otherwise((r * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, x: F.when(x == "", r).otherwise(step(r, x))) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(14, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def gathered(tail: Column, full: Column, new: Column) -> tuple[Column, Column]:
    """The two lists of a fold with another value."""
    whole = F.size(tail) >= GATHER
    return F.when(whole, F.array(new)).otherwise(F.concat(tail, F.array(new))), F.when(whole, F.concat(full, F.array(tail))).otherwise(full)


def spans_of(kind: str, text: Column, window: int) -> Column:
    """Valid spans of one kind with their scores, by start."""
    found = F.regexp_extract_all(text, F.lit(FAST[kind]), F.lit(0))
    between = F.split(text, FAST[kind], -1)
    n = F.size(found)
    # Zipped rather than indexed: what a lambda refers to is worked out anew for each element.
    pairs = F.zip_with(found, F.slice(between, F.lit(1), n), lambda m, before: F.struct(m.alias("m"), before.alias("before")))
    gaps = F.zip_with(pairs, F.slice(between, F.lit(2), n), lambda p, after: F.struct(p["m"].alias("m"), p["before"].alias("before"), after.alias("after")))
    none = F.expr(f"cast(array() as {SPAN})")
    state = F.struct(F.lit(0).alias("at"), none.alias("tail"), F.expr(f"cast(array() as array<{SPAN}>)").alias("full"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        near = F.lower(F.concat_ws(" ", F.right(x["before"], F.lit(window)), F.left(x["after"], F.lit(window))))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})\b"), F.lit(0.3)).otherwise(F.lit(0.0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score")).cast(SPAN[len("array<") : -1])
        tail, full = gathered(s["tail"], s["full"], span)
        ok = valid(kind, x["m"])
        return F.struct(end.alias("at"), F.when(ok, tail).otherwise(s["tail"]).alias("tail"), F.when(ok, full).otherwise(s["full"]).alias("full"))

    walked = F.aggregate(gaps, state, step, lambda s: F.concat(F.flatten(s["full"]), s["tail"]))
    can = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(can, F.when(text.rlike(FAST[kind]), walked).otherwise(none)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = ALL_KINDS, least: float = 0.65, window: int = 40, out: str = "pii") -> DataFrame:
    """docs with a column ``out``: array of (kind, start, end, score), by start, then kind in the order of ALL_KINDS.

    Positions are code points, end exclusive. Of the method's own kinds, spans that score under ``least`` or that
    overlap a base span are dropped; base spans stay whatever they score.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = [k for k in kinds if k in BASE_KINDS]
    own = [k for k in kinds if k not in BASE_KINDS]
    order = F.map_from_arrays(F.array(*map(F.lit, ALL_KINDS)), F.array(*map(F.lit, range(len(ALL_KINDS)))))
    empty = F.expr(f"cast(array() as {SPAN})")
    named = {k: f"__pii_{k}" for k in kinds}
    df = docs.withColumns({named[k]: spans_of(k, body, window) for k in kinds})
    df = df.withColumn("__pii_base", F.concat(empty, *(F.col(named[k]) for k in base)))
    free = lambda s: (s["score"] >= least) & ~F.exists("__pii_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    both = F.concat("__pii_base", F.filter(F.concat(empty, *(F.col(named[k]) for k in own)), free))
    before = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(order[a["kind"]] - order[b["kind"]])
    return df.withColumn(out, F.array_sort(both, before)).drop("__pii_base", *named.values())


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def is_kind(kind: str):
    return lambda x: x == kind


def digest(found: DataFrame, spans: str = "pii") -> DataFrame:
    """doc_id, counts of the base kinds, the hash of the base spans, and all spans as text."""
    s = F.col(spans)
    base = F.filter(s, lambda x: x["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter(s["kind"], is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"))


def redact(found: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """found with each span of its text replaced by ``[KIND]``; where spans overlap, the earlier one stands for both."""
    strings = "array<string>"
    # base: the position at which rest begins; rest is cut behind now and then, so a place is never far into it.
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("base"), F.col(text).cast("string").alias("rest"),
        F.expr(f"cast(array() as {strings})").alias("tail"), F.expr(f"cast(array() as array<{strings}>)").alias("full"),
    )

    def step(s: Column, x: Column) -> Column:
        new = x["start"] >= s["at"]
        piece = F.concat(F.substring(s["rest"], s["at"] - s["base"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        tail, full = gathered(s["tail"], s["full"], piece)
        end = F.greatest(s["at"], x["end"])
        far = end - s["base"] > BEHIND
        return F.struct(
            end.alias("at"), F.when(far, end).otherwise(s["base"]).alias("base"),
            F.when(far, F.substring(s["rest"], end - s["base"] + 1, F.lit(2**31 - 1))).otherwise(s["rest"]).alias("rest"),
            F.when(new, tail).otherwise(s["tail"]).alias("tail"), F.when(new, full).otherwise(s["full"]).alias("full"),
        )

    last = lambda s: F.substring(s["rest"], s["at"] - s["base"] + 1, F.lit(2**31 - 1))
    whole = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(F.flatten(s["full"]), ""), F.array_join(s["tail"], ""), last(s)))
    return found.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text)))
