"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Everything is a column expression over one row; there is no shuffle and no Python.  Positions come from the lengths of the
matches and of what lies between them (``regexp_extract_all`` and ``split`` walk a text in the same way).

The patterns find what the plain ones find, but without backtracking that grows with the square of a run or recurses
once per repetition: runs are possessive, and a match starts at the start of a run or where the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the result, their patterns, the words that support them and their first scores.
@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    words: str
    score: float
    #: a cheap test that a text must pass to hold a match
    needs: str = ""


EMAIL = Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail|contact|write|courriel|correo", 0.9, "@")
IP = Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "ip|address|host|server|adresse", 0.6, ".")
CARD = Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "card|visa|master|credit|karte|carte|tarjeta", 0.8)
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone|tel|call|mobile|fax", 0.6, "+")
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "iban|bank|account|konto|compte|cuenta", 0.8)
SSN = Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social|security", 0.3)
BASE = (EMAIL, IP, CARD, PHONE)
KINDS = (*BASE, IBAN, SSN)
#: Characters before a match in which supporting words are looked for, what they add, and the least score of added kinds.
CONTEXT, SUPPORT, LEAST = 40, 0.3, 0.5
#: Matches that are placed in one run.
RUN = 128


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Remainder of an IBAN: its first four characters go to the end, letters count as 10 to 35."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(chars, F.lit(0), lambda acc, c: F.when(value(c) < 10, acc * 10 + value(c)).otherwise(acc * 100 + value(c)) % 97)


def confirmed(kind: Kind, m: Column) -> Column:
    if kind is IP:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind is CARD:
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind is PHONE:
        return F.length(_digits(m)).between(9, 15)
    if kind is IBAN:
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(m) == 1)
    if kind is SSN:
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return F.lit(True)


def spans(text: Column, kind: Kind) -> Column:
    """Confirmed matches of one kind: array of (kind, start, end, score, value), in code points, end exclusive."""
    possible = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    nothing = F.array().cast("array<string>")
    found = F.when(possible, F.regexp_extract_all(text, F.lit(kind.pattern), 0)).otherwise(nothing)
    pair = F.when(F.size(found) > 0, F.arrays_zip(found.alias("m"), F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found)).alias("gap"))).otherwise(
        F.array().cast("array<struct<m:string,gap:string>>"))
    row = "struct<m:string,start:int,end:int,before:string>"

    def step(acc, x):
        m, gap = x["m"], x["gap"]
        begin = acc["at"] + F.length(gap)
        end = begin + F.length(m)
        one = F.struct(m.alias("m"), begin.alias("start"), end.alias("end"), F.lower(F.right(gap, F.lit(CONTEXT))).alias("before"))
        return F.struct(end.alias("at"), F.when(confirmed(kind, m), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def run(acc, some):  # the matches of one run, placed after those before
        part = F.aggregate(some, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{row}>").alias("out")), step)
        return F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))[0]

    def place(p):  # in runs, as an array that grows match by match is copied each time
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda i: F.slice(p, i * RUN + 1, RUN))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{row}>>").alias("out"))
        return F.when(F.size(p) > 0, F.flatten(F.aggregate(cut, begin, run, lambda acc: acc["out"]))).otherwise(F.array().cast(f"array<{row}>"))

    placed = F.transform(F.array(pair), place)[0]
    score = lambda s: F.least(F.lit(1.0), F.lit(kind.score) + F.when(s["before"].rlike(kind.words), SUPPORT).otherwise(0.0))
    scored = F.transform(placed, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score"), s["m"].alias("value")))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= LEAST)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end, score, value) by kind, then start.

    Base kinds (email, ip, card, phone) are all kept; added kinds need a score of ``LEAST``.  Null and empty texts have no
    spans; a null id stays null; repeated rows stay; an empty table gives an empty result; other columns are not read."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = src.select("id", *[spans(F.col("text"), k).alias(f"k{i}") for i, k in enumerate(KINDS)])
    return found.select(F.col("id").alias(id_col), F.concat(*[F.col(f"k{i}") for i in range(len(KINDS))]).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
