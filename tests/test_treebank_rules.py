"""Treebank tokens: the rules that look behind give the tokens of the rules that take the character before."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as TX

RULES = [(r'^"', " `` "), (r'(``)', " $1 "), (r'([ (\[{<])"', "$1 `` "), (r"([:,])([^\d])", " $1 $2"), (r"([:,])$", " $1 "), (r"\.\.\.", " ... "),
         (r"([;@#$%&])", " $1 "), (r'([^\.])(\.)([\]\)}>"\']*)\s*$', "$1 $2$3 "), (r"([?!])", " $1 "), (r"([\]\[\(\)\{\}<>])", " $1 "), (r"--", " -- "),
         (r'"', " '' "), (r"(\S)('')", "$1 $2 "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 ")]


def test_tokens_of_odd_texts(spark):
    draw = random.Random(11)
    parts = list("'\"`.-ab1?!;$(){}<>[],: \n\t") + ["''", "``", "...", "--", "n't", "N'T", "'ll", "'S", "'d", "\U0001F600", "é", "\r\n", " "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(4_000)] + [None, "", "can't you'll 'tis \"so\" (he said)."]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for lower in (True, False):
        t = F.coalesce("text", F.lit(""))
        t = F.lower(t) if lower else t
        for pattern, new in RULES:
            t = F.regexp_replace(t, pattern, new)
        t = F.trim(F.regexp_replace(t, r"\s+", " "))
        want = F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, " "))
        assert df.where(~want.eqNullSafe(TX.treebank_tokens(F.col("text"), lower))).limit(3).collect() == []
