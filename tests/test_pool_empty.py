"""Pooled token states of rows without tokens."""

from tessera.operators.embed import pool_token_states


def test_rows_without_tokens_get_null(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0]], [1, 0]), (2, [], []), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, states array<array<double>>, attention_mask array<int>")
    first = {r.id: r.vector for r in pool_token_states(df, mode="start_token_hidden").collect()}
    masked = {r.id: r.vector for r in pool_token_states(df).collect()}
    padded = {r.id: r.vector for r in pool_token_states(df, include_padding=True).collect()}
    assert first == {1: [1.0, 2.0], 2: None, 3: None}
    assert masked == {1: [1.0, 2.0], 2: None, 3: None} and padded == {1: [2.0, 3.0], 2: None, 3: None}
