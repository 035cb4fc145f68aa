"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, exact_dedup, language_id, lexical_search, lm_scoring, ngram_join, packing, pii, resampling, secret_scan, token_counts, warc
from tessera.llm.common import table
from tessera.session import reliable_checkpoint, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), *vocabulary)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_file", "row_no")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k.name)).cast("long").alias(f"n_{k.name}")
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in pii.BASE]))
    return found.select("doc_id", *map(of, pii.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def secret_dictionary() -> frozenset[str]:
    """Words and word parts of a public vocabulary, of 3 to 10 letters."""
    pieces = [p for part in token_counts.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")) for p in part]
    return frozenset(p.lower() for p in pieces if p.isalpha() and 3 <= len(p) <= 10)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, dictionary = table(spark, sf_dir, "documents"), secret_dictionary()
    learned = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return secret_scan.scan(docs, secret_scan.candidates(learned, dictionary), dictionary)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("hit_spans"))
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def bpe_digests(docs: DataFrame) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = byte_bpe.encode(docs, ranks, decoded=True)
    return out.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def captures(records: DataFrame) -> DataFrame:
    """Digest columns of the captures in ``records``; a revisit is given the page of the response that it refers to."""
    records = reliable_checkpoint(records.drop("payload", "head"))  # archives are parsed once, for the columns used here
    rows = warc.assemble(records).select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.warc_type").alias("record_type"), F.col("capture.record_id").alias("record_id"), F.col("capture.refers_to").alias("to"))
    rows = reliable_checkpoint(rows)
    first = rows.where("record_type = 'response'")
    revisits = rows.where("record_type = 'revisit'").drop("record_id").join(first.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to")), "to", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(revisits.select(*names))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return captures(warc.read_records(spark, path))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        packed = packing.pack_documents(table(spark, sf_dir, "documents"), f.read())
    return packed.drop("row_file", "row_no")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_exact_dedup, op3_lm_scoring, op4_pii, op5_secret_scan, op6_decontaminate, op7_language_id, op8_byte_bpe, op9_ngram_join, op10_warc,
    op11_packing, op12_resampling, op13_lexical_search)}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op6_decontaminate": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
        win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
                FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        spot AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
               FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
        hit AS (SELECT r, item, i, n FROM spot JOIN win USING (n, s)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op9_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top, unhex(sha1(body)) AS d FROM p),
        bits AS (SELECT *, array_to_string([lpad(bin(CAST(concat('0x', substr(hex(d), i + 1, 1)) AS INTEGER)), 4, '0') for i in range(40)], '') AS b FROM q)
        SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(b[5 * i + 1] AS INTEGER) + 8 * CAST(b[5 * i + 2] AS INTEGER)
                   + 4 * CAST(b[5 * i + 3] AS INTEGER) + 2 * CAST(b[5 * i + 4] AS INTEGER) + CAST(b[5 * i + 5] AS INTEGER), 1) for i in range(32)], '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM bits""",
    "op12_resampling": rf"""
        WITH crc(i, c) AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) FROM range(256) r(i)),
        remainders AS (SELECT list(c ORDER BY i) AS tab FROM crc),
        words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
        d AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
        target AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
        tf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM target),
        df AS (SELECT doc_id, unnest(f) AS f FROM d),
        distinct_f AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION ALL SELECT f FROM tf)),
        bytes AS (SELECT f, list_transform(range(CAST(len(x) / 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS b FROM distinct_f),
        cell AS (SELECT f, xor(list_reduce(b, lambda c, v: xor(c >> 8, tab[xor(c, v) % 256 + 1]), 4294967295), 4294967295) % 10000 AS c FROM bytes, remainders),
        s AS (SELECT c, count(*) AS n FROM df JOIN cell USING (f) GROUP BY c), t AS (SELECT c, count(*) AS n FROM tf JOIN cell USING (f) GROUP BY c),
        gain AS (SELECT c, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM df) + 10000.0::DOUBLE)) / ((s.n + 1.0::DOUBLE) * ((SELECT count(*) FROM tf) + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (c)),
        weighed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS g FROM df JOIN cell USING (f) JOIN gain USING (c) GROUP BY doc_id),
        rows AS (SELECT doc_id, n, n + greatest(n - 1, 0) AS n_features, CASE WHEN n = 0 THEN 0 ELSE (g - ((g % (2 * n - 1)) + (2 * n - 1)) % (2 * n - 1)) // (2 * n - 1) END AS weight,
                        CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) AS h FROM d LEFT JOIN weighed USING (doc_id)),
        scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM rows),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n >= 20)
        SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM placed) THEN place END AS rank
        FROM scored LEFT JOIN placed USING (doc_id)""",
    "op13_lexical_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
        stats AS (SELECT count(*) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
        bag AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
        weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM bag, stats GROUP BY term, n_all),
        m AS (SELECT doc_id, 100 - 50 + (50 * len(w) * n_all) // l_all AS m FROM d, stats WHERE len(w) > 0),
        item AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}'))) AS term FROM benchmark),
        scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
                   FROM item JOIN bag USING (term) JOIN weight USING (term) JOIN m USING (doc_id) GROUP BY ALL),
        placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM placed WHERE rank <= 50""",
}
