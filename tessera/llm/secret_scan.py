"""Secret scans: a random forest on candidate strings removes false positives.

Every value that is assigned to the name of a secret is a candidate, of any length and any characters but spaces, and so is
every other long run of key-like characters, without a leading name and "=".  Its features are its length, the transitions between kinds of
characters, how much of it dictionary words cover, the path that it comes from, and the words around it.  The forest is
trained on labelled findings (at most ``rows`` of each label) and keeps candidates of probability 1/2 or more.  Texts are
read whole, in Arrow batches; only candidates are shuffled, to come together by document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrange, column, landed, slices
from tessera.session import reliable_checkpoint

#: What a candidate is without a name, the names that an assigned secret has, its value (between quotes, or up
#: to a space or to the next assignment), the prefixes of known kinds of keys, and the words that are features.
CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
LONG = 20
_NAMED = r"(?:token|secret(?:[_-]?key)?|passw(?:or)?d|api[_-]?key|access[_-]?key)\\?[\"']?\s*(?::=|=>|={1,3}|:(?!:))\s*"
ASSIGNED = re.compile(_NAMED, re.I)
_AGAIN = re.compile(r"[^\w\s]{0,8}[\w-]{0,40}?" + _NAMED, re.I)
VALUE = re.compile(
    r"""\\"([^"\\\s]+)\\"|\\'([^'\\\s]+)\\'|"((?:\\\S|[^"\\\s])+)"|'((?:\\\S|[^'\\\s])+)'|\\?["']?((?:(?![&,;]["']?[\w.-]{1,40}["']?[=:])\S)+)""")
_BARE, _CLOSING = 5, ",;)]}>\"'`"
PREFIXED = re.compile(
    r"(?<![A-Za-z0-9])(?:gh[opsru]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[\w-]{35}"
    r"|xox[abeoprs]-[\w-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:ant|proj)-[\w-]{20,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|pypi-[\w-]{50,})")
#: Characters after a name within which another name with an assignment would begin the value.
_NEXT = 80
WORDS = ("token", "secret", "password", "key", "example", "test", "http", "hash", "=", ":", '"', "'")
#: Characters around a candidate that are looked at, and hash cells of the path and of the neighbouring words.
AROUND, PATHS, NEIGHBOURS = 30, 8, 16
LEAST = 0.5
_KIND = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 for b in range(128)])
N_FEATURES = 1 + 4 + 16 + 1 + PATHS + len(WORDS) + NEIGHBOURS
CANDIDATES = "start int, end int, value string, labelled double, features array<float>"


def coverage(value: str, dictionary: frozenset[str], longest: int = 10, shortest: int = 3) -> float:
    """Share of the characters that greedy longest dictionary words cover."""
    low, i, covered = value.lower(), 0, 0
    while i < len(low):
        for n in range(min(longest, len(low) - i), shortest - 1, -1):
            if low[i : i + n] in dictionary:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / len(low)


def features(value: str, before: str, after: str, path: str, dictionary: frozenset[str]) -> list[float]:
    kinds = _KIND[np.minimum(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32), 127)]
    share = np.bincount(kinds, minlength=4) / len(kinds)
    moves = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16) / max(len(kinds) - 1, 1)
    cells = np.zeros(PATHS + NEIGHBOURS)
    cells[zlib.crc32(path.encode("utf-8", "replace")) % PATHS] = 1
    for w in re.findall(r"\w+", before)[-2:] + re.findall(r"\w+", after)[:1]:
        cells[PATHS + zlib.crc32(w.lower().encode("utf-8", "replace")) % NEIGHBOURS] = 1
    near = before.lower()
    return [len(value), *share, *moves, coverage(value, dictionary), *cells[:PATHS], *(float(w in near) for w in WORDS), *cells[PATHS:]]


def assigned(text: str) -> Iterator[tuple[int, int, int]]:
    """(start of the name, start and end of the value) of what is assigned to names of secrets, whatever its length."""
    last = pos = 0
    while m := ASSIGNED.search(text, pos):
        pos = m.end()
        if _AGAIN.match(text, pos, pos + _NEXT):  # another name follows, which has the value
            continue
        v = VALUE.match(text, pos)
        if v is None:
            continue
        start, end = v.span(v.lastindex)
        if v.lastindex == _BARE:
            end = start + len(v[_BARE].rstrip(_CLOSING))
        if end > start:
            name = m.start()
            while name > last and (text[name - 1].isalnum() or text[name - 1] in "_-"):
                name -= 1
            yield name, start, end
            last = pos = end


def runs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of long runs, parted behind "=" that more follows: the last part, and others of LONG characters."""
    for m in CANDIDATE.finditer(text, start, end):
        a, stop = m.span()
        i = a
        while i < stop:  # one pass: "=" in front, what is not "=", and "=" behind
            part = i
            while i < stop and text[i] == "=":
                i += 1
            j = text.find("=", i, stop)
            i = stop if j < 0 else j
            while i < stop and text[i] == "=":
                i += 1
            if i == stop or i - part >= LONG:
                yield part, i


def spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, assigned) of the candidates of a text, by start, without overlaps: each assigned value, and the runs
    outside of those and of their names."""
    out, at = [], 0
    for name, start, end in assigned(text):
        out += [(*x, False) for x in runs(text, at, name)]
        out.append((start, end, True))
        at = end
    return out + [(*x, False) for x in runs(text, at, len(text))]


def candidates(docs: DataFrame, dictionary: Iterable[str], id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """A row for each candidate: id, row_file, row_no, start and end (code points), value, ``labelled`` (1 where it is
    assigned to a name of secrets and has a digit, or has the prefix of a known kind of key, else 0) and features."""
    src = arrange(docs, {id_col: "id", text_col: "text", path_col: "path"}).select(
        "id", "row_file", "row_no", F.col("text").cast("string").alias("text"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"))
    kind = dict(src.dtypes)["id"]
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(dictionary))

    def find(batches):
        for b in slices(batches):
            t = pa.Table.from_batches([b])
            row, out = [], []
            for i, (text, path) in enumerate(zip(column(t, "text").to_pylist(), column(t, "path").to_pylist(), strict=True)):
                for start, end, named in spans(text or ""):
                    value, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
                    sure = named and any(c.isdigit() for c in value) or PREFIXED.search(value) is not None
                    row.append(i)
                    out.append((start, end, value, float(sure), features(value, before, after, path, sent.value)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.float32())]
            place = t.select(["id", "row_file", "row_no"]).take(pa.array(row, pa.int64()))
            yield from pa.table([*place.columns, *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["id", "row_file", "row_no", "start", "end", "value", "labelled", "features"]).to_batches()

    return src.mapInArrow(find, f"id {kind}, row_file string, row_no long, {CANDIDATES}")


def train(labelled: DataFrame, rows: int = 5000, trees: int = 20, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest of labelled findings (features, labelled 0 or 1), about ``rows`` of each label drawn by hash; None unless
    both labels are there."""
    labelled = reliable_checkpoint(labelled)  # counted, drawn from, and read by every pass of the forest
    counted = {r["labelled"]: r["n"] for r in labelled.groupBy("labelled").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counted) < 2:
        return None
    draw = F.pmod(F.xxhash64("row_file", "row_no", "start", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    share = F.coalesce(*[F.when(F.col("labelled") == k, min(1.0, rows / n)) for k, n in sorted(counted.items())])
    data = labelled.where(draw < share).select(array_to_vector("features").alias("features"), F.col("labelled").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed).fit(data)


def scan(docs: DataFrame, labelled: DataFrame | None, dictionary: Iterable[str], id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per input row: the id, ``n_candidates``, ``n_secrets`` and ``secrets``, an array of (start, end, score,
    value) by start.

    ``labelled``: findings as ``candidates`` gives them, with labels; where they can't train a forest, their own label
    decides.  Null and empty texts have no candidates; a null path counts as empty; a null id stays null; repeated rows
    stay apart; an empty table gives an empty result; other columns are not read."""
    dictionary, docs = frozenset(dictionary), landed(docs)
    docs_at = arrange(docs, {id_col: "id"}, text=None).select("id", "row_file", "row_no")
    found = reliable_checkpoint(candidates(docs, dictionary, id_col, text_col, path_col))  # texts are scanned once
    model = train(labelled) if labelled is not None else None
    if model is None:
        scored = found.withColumn("score", F.col("labelled"))
    else:
        judged = model.transform(found.withColumn("features", array_to_vector("features")))
        scored = judged.withColumn("score", vector_to_array("probability")[1])
    row = F.struct("start", "end", "score", "value")
    by_doc = scored.groupBy("row_file", "row_no").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.array_sort(F.collect_list(F.when(F.col("score") >= LEAST, row))).alias("secrets"))
    out = docs_at.join(by_doc, ["row_file", "row_no"], "left")
    secrets = F.coalesce("secrets", F.array().cast(by_doc.schema["secrets"].dataType))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), secrets.alias("secrets"))
