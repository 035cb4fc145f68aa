"""Texts with the odd cases that every operator has to bear."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that an operator might use itself
    T.StructField("block", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("keep_id", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("bucket", T.StringType()),
])


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that hashes by sums of powers confuse."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


ODD_TEXTS = [
    *thue_morse(1024), " ".join(thue_morse(2048)), "one two three four " + thue_morse(4096)[0], "one two three four " + thue_morse(4096)[1],
    None, "", " ", "\n\t ", "a", "A", "it's the cat's 'tis  we'll\n\n x", "naïve Straße ÀÉÎ ñandú", "日本語 テキスト 𝒳𝒴 😀😀",
    "x" * 30_000, "word " * 20_000, "1 2 3 " * 5_000, "ABC def ABC def", "abc DEF abc def", "tab\tand\x0bvt\x0cff\r\n", "\x00 nul \x7f",
    "ends with space ", "  two spaces", "''s 's's don't DON'T", "a-b_c d.e@f.gh +1 (555) 010-9999 127.0.0.1", "…—“quoted”", "½ ² Ⅷ ٣",
]


def odd_docs(spark, texts=ODD_TEXTS, langs=("en", None, "fr", "de")):
    rows = [(i * 3 + 1, t, langs[i % len(langs)], f"s{i % 2}", None if t is None else len(t), "b", "d", "k", "i", "x") for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def docs_of(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, langs[i], "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
