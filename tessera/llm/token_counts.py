"""Token counts by a linear longest-match automaton.

Word pieces are taken greedily: the longest vocabulary piece that starts a word, then the longest continuation piece,
and so on.  The automaton is the vocabulary trie with failure links; a node also holds how many pieces are popped when
its failure link is followed, so a word is counted in one pass over its characters and no piece is ever built.  A word
with a part that no piece covers counts as one unknown token.

Every text is read whole in Arrow batches, without a shuffle.  A task remembers the counts of the words that it saw
last (at most ``MEMO`` of them), as most words repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: Words: runs of letters and digits, and every other character that is not white space.
WORD = r"\w+|[^\w\s]"
#: Entries that a task's memory of word counts may hold; it starts anew beyond that.
MEMO = 200_000
#: Characters a vocabulary may have, as it is sent to all executors.
MAX_VOCABULARY = 64 << 20


class PieceAutomaton:
    """``initial``: pieces that may start a word; ``inner``: pieces that may continue one."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.go: list[dict[str, int]] = [{}, {}]
        is_piece = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for p in pieces:
                if not p:
                    continue
                u = root
                for ch in p:
                    v = self.go[u].get(ch)
                    if v is None:
                        v = len(self.go)
                        self.go[u][ch] = v
                        self.go.append({})
                        is_piece.append(False)
                    u = v
                is_piece[u] = True
        n = len(self.go)
        #: node after the popped pieces (-1: none), and how many pieces are popped on the way
        self.fail, self.pops = [-1] * n, [0] * n
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for ch, v in self.go[u].items():
                    below.append(v)
                    if is_piece[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and ch not in self.go[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.go[z][ch], popped
            level = below

    def count(self, word: str) -> int:
        """Pieces of the word, or -1 if some part of it is in no piece."""
        go, fail, pops = self.go, self.fail, self.pops
        u, n = 0, 0
        for ch in word:
            while (v := go[u].get(ch)) is None:
                if fail[u] < 0:
                    return -1
                n += pops[u]
                u = fail[u]
            u = v
        while u > 1:  # the end of the word: pop what is left until the root of continuations
            if fail[u] < 0:
                return -1
            n += pops[u]
            u = fail[u]
        return n


def piece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece file: those after the word mark start words, the others continue them; a single
    character may do either, so that marks count as words.  Control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, inner = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            initial.append(piece[1:])
        else:
            inner.append(piece)
            if len(piece) == 1:
                initial.append(piece)
    return initial, inner


def token_counts(docs: DataFrame, initial: list[str], inner: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_tokens`` and ``n_unknown`` (words that no pieces cover, one token
    each).  Null and empty texts have 0 of all; a null id stays null; repeated rows stay; an empty table gives an empty
    result; other columns are not read."""
    if (size := sum(map(len, initial)) + sum(map(len, inner))) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary of {size} characters; at most {MAX_VOCABULARY} are sent to the executors")
    sent = docs.sparkSession.sparkContext.broadcast((initial, inner))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(src.dtypes)["id"]

    def count(batches):
        automaton, words, memo = PieceAutomaton(*sent.value), re.compile(WORD).findall, {}
        for b in slices(batches):
            n_words, n_tokens, n_unknown = [], [], []
            for text in b.column(1).to_pylist():
                found = words(text) if text else []
                try:
                    counts = [memo[w] for w in found]
                except KeyError:
                    if len(memo) > MEMO:
                        memo.clear()
                    counts = []
                    for w in found:
                        if (c := memo.get(w)) is None:
                            c = automaton.count(w)
                            if len(w) <= 64:
                                memo[w] = c
                        counts.append(c)
                missing = counts.count(-1)
                n_words.append(len(counts))
                n_tokens.append(sum(counts) + 2 * missing)
                n_unknown.append(missing)
            ints = [pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown)]
            yield pa.RecordBatch.from_arrays([b.column(0), *ints], ["id", "n_words", "n_tokens", "n_unknown"])

    out = src.mapInArrow(count, f"id {kind}, n_words long, n_tokens long, n_unknown long")
    return out.withColumnRenamed("id", id_col)
