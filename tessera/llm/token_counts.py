"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidy, unused


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) in place of the text.

    Batches hold about as many bytes each, whatever the rows' lengths; long texts are
    cut before blanks at which the ids cannot change, never truncated. A null text
    counts as empty (0, 0, false); rows repeat as they do in df; columns of df named
    like a result are replaced. A `.model` file goes through sentencepiece, and a `.json`
    file whose rules are not known to allow cuts is given whole texts.
    """
    out = ("n_bytes", "n_tokens", "over_limit")
    keep, hidden = [c for c in df.columns if c not in (text, *out)], unused(df, "text")
    slim = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(hidden))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .encoding import encoder

        enc = encoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, hidden, 1 << 20):
                texts = part.column(part.num_columns - 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(enc.counts(texts), pa.int64())], names=[*keep, "n_tokens"])

    counted = slim.withColumn("n_bytes", F.octet_length(hidden).cast("long")).select(*keep_cols(keep), "n_bytes", hidden)
    keep = [*keep, "n_bytes"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema.fields[:-1]) + ", n_tokens long"
    return counted.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def keep_cols(names: list[str]) -> list:
    return [F.col(f"`{c}`") for c in names]
