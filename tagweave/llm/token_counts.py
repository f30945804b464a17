"""op3: token counts of whole texts by rank-synchronous array merging."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tagweave.llm.common import map_rows, table
from tagweave.llm.ragged_bpe import PieceModel, count_tokens

SPACE = "▁"
#: A pre-token: marks for blanks, then what follows up to the next one. No piece has a mark behind another character.
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Counts of distinct pre-tokens that a Python worker keeps; it starts anew beyond that, which only costs time.
CACHE = 400_000


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def pretokens(text: str) -> list[str]:
    """The text as sentencepiece normalises it (a leading blank is added, blanks become marks), cut before marks."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[-1] == " " or text[0] == " ":
        return SEGMENT.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text under a sentencepiece BPE model, without special tokens.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row per input row. A null or empty
    text has 0 bytes and 0 tokens; null ids stay null; repeated rows give repeated results; other columns are ignored.
    Texts are never cut: a long one is split only where no piece of the vocabulary can reach across.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _model(model_path), {}
        for b in batches:
            rows = b.column(1).to_pylist()
            split = [pretokens(t or "") for t in rows]
            fresh = list({w for ws in split for w in ws if w not in cache})
            if len(cache) + len(fresh) > CACHE:
                cache = {}
                fresh = list({w for ws in split for w in ws})
            for k in range(0, len(fresh), 50_000):
                part = fresh[k : k + 50_000]
                cache.update(zip(part, count_tokens(part, model).tolist(), strict=True))
            n = [sum(map(cache.__getitem__, ws)) for ws in split]
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_rows(docs.select(id_col, text_col), run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 32k piece model."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
