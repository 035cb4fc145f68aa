"""Posts and prompt assembly.

Per account, at most ``n`` recent and ``n`` successful texts are kept by
salted two-level windows (never an unbounded group), then gathered with
``array_sort(collect_list(struct(rank, text)))`` -- bounded by ``n`` -- and
joined into the numbered lists of the prompt with ``transform`` /
``array_join``.  Generation (T2) reuses the batched model mechanism of E6.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.metrics import top_texts_per_group

# Prompt wording of the reference, in order of assembly.
RECENT_HEADER = "The following are the most recent tweets written by {account}:\n"
SUCCESS_HEADER = "The following are the most successful tweets ever written by {account}:\n"
LIST_END = "\n"
TONE = ", written in a {tone} tone,"
BOTH_TAIL = ("The following is an {account} tweet about {topic}{tone} that is related to recent events and has a "
             "high chance of being successful and is less than 280 characters long:\n")
SUCCESS_TAIL = ("The following is an {account} tweet about {topic}{tone} that has a high chance of being successful "
                "and is less than 280 characters long:\n")
RECENT_TAIL = ("The following is an {account} tweet about {topic}{tone} that is related to recent events and is less "
               "than 280 characters long:\n")
# Not in the reference (it fails without examples): the same sentence without them.
PLAIN_TAIL = "The following is an {account} tweet about {topic}{tone} that is less than 280 characters long:\n"


def recent_texts(posts: DataFrame, account: str = "account", ts: str = "ts", kind: str = "kind",
                 id_col: str = "post_id", n: int = 5, exclude=("retweet", "reply")) -> DataFrame:
    """Each account's ``n`` latest posts (ties by id, newest first),
    excluded kinds removed.  The reference asks its source for max(n, 5)
    posts and keeps n, which is the same set."""
    kept = posts.where(~F.col(kind).isin(list(exclude))) if exclude else posts
    return top_texts_per_group(kept, account, ts, n, True, id_col=id_col, name="rank")


def _numbered(items: Column) -> Column:
    """"1. text\\n2. text\\n" from an array of (rank, text) structs sorted by rank."""
    return F.array_join(F.transform(items, lambda it, i: F.concat((i + 1).cast("string"), F.lit(". "), it["text"],
                                                                   F.lit("\n"))), "")


def _fill(template: str, account: Column, topic: str, tone: str | None) -> Column:
    """Render a template whose only per-row field is the account name."""
    tone_txt = TONE.format(tone=tone) if tone else ""
    head, tail = template.split("{account}")
    return F.concat(F.lit(head), account, F.lit(tail.format(topic=topic, tone=tone_txt)))


def build_prompts(recent: DataFrame | None, successful: DataFrame | None, account: str, topic: str,
                  tone: str | None = None, account_name: Callable[[Column], Column] | None = None,
                  text_col: str = "text", user_prompt: str | None = None,
                  accounts: DataFrame | None = None) -> DataFrame:
    """One prompt per account from ranked recent and successful texts
    (``account, rank, text`` rows, at most n per account).  A user prompt
    overrides the template.  ``accounts`` lists the accounts to write for
    (default: those in either list); one with neither list gets the plain
    sentence."""
    if accounts is None and recent is None and successful is None:
        raise ValueError("give accounts, or at least one list")
    name = account_name or (lambda c: c.cast("string"))

    def gathered(df, alias):
        if df is None:
            return None
        return df.groupBy(account).agg(
            F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"),
                                                 F.col(text_col).alias("text")))).alias(alias))

    r, s = gathered(recent, "_recent"), gathered(successful, "_success")
    if accounts is not None:
        both = accounts.select(account).distinct()
        for part in (r, s):
            both = both if part is None else both.join(part, account, "left")
    elif r is not None and s is not None:
        both = r.join(s, account, "full_outer")
    else:
        both = r if r is not None else s
    if r is None:
        both = both.withColumn("_recent", F.lit(None).cast("array<struct<rank:bigint,text:string>>"))
    if s is None:
        both = both.withColumn("_success", F.lit(None).cast("array<struct<rank:bigint,text:string>>"))
    acc = name(F.col(account))
    has_r = F.coalesce(F.size("_recent"), F.lit(0)) > 0
    has_s = F.coalesce(F.size("_success"), F.lit(0)) > 0
    recent_block = F.concat(_fill(RECENT_HEADER, acc, topic, tone), _numbered(F.col("_recent")), F.lit(LIST_END))
    success_block = F.concat(_fill(SUCCESS_HEADER, acc, topic, tone), _numbered(F.col("_success")), F.lit(LIST_END))
    prompt = (F.when(has_r & has_s, F.concat(recent_block, success_block, _fill(BOTH_TAIL, acc, topic, tone)))
              .when(has_s, F.concat(success_block, _fill(SUCCESS_TAIL, acc, topic, tone)))
              .when(has_r, F.concat(recent_block, _fill(RECENT_TAIL, acc, topic, tone)))
              .otherwise(_fill(PLAIN_TAIL, acc, topic, tone)))
    if user_prompt:
        prompt = F.lit(user_prompt)
    return both.select(account, prompt.alias("prompt"))


def generate_texts(prompts: DataFrame, make_predict_fn: Callable, batch_size: int = 16,
                   prompt_col: str = "prompt", out: str = "generated") -> DataFrame:
    """One generated text per prompt from a user-supplied generator
    (``make_predict_fn() -> fn(np.ndarray[str]) -> np.ndarray[str]``), first
    choice kept, trimmed."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.StringType(), batch_size=batch_size)
    return prompts.withColumn(out, F.trim(udf(F.col(prompt_col))))


def first_line_generator():
    """A model-free generator for tests: the first line of the prompt."""
    def make():
        def predict(prompts: np.ndarray) -> np.ndarray:
            return np.array([str(p).split("\n", 1)[0] for p in prompts], dtype=object)
        return predict
    return make
