"""Operator 10: byte-level BPE encoding and decoding by backtracking over longest matches.

Empty cases: null and empty text have no ids and decode to no bytes; other columns of the input never meet the
operator's own names, since it takes only the columns it is told. Repeated rows each keep a row, null ids too; an empty table gives none. Texts of
any length are encoded whole, in time linear in their words. There are no ties: every text has one encoding.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from . import common
from .tokens import BacktrackingBPE, Remembered, public


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BacktrackingBPE:
    """One a worker process."""
    return BacktrackingBPE(path, pattern)


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import itertools

    c = codec(path, pattern)

    def encode(texts):
        return [[r for w in c.split.findall(t) for r in c.encode_word(w.encode("utf-8", "surrogatepass"))] for t in texts]

    return Remembered(encode, lambda parts: list(itertools.chain.from_iterable(parts)))


def encode_decode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", digest: bool = False) -> DataFrame:
    """(id, ids array<int>, decoded binary); digest=True gives n_tokens, ids_sha256 and decoded_sha256 in their place,
    so that neither ids nor bytes leave the worker."""
    made = "ids array<int>, decoded binary" if not digest else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import hashlib

        import pandas as pd
        import public_tokenizers

        path = public(vocabulary)
        c, encode = codec(path, public_tokenizers.PATTERN), _encoder(path, public_tokenizers.PATTERN)
        names = list(map(str, range(len(c.word))))
        for pdf in batches:
            rows = []
            for text in pdf["t"]:
                ids = encode(text or "")
                plain = c.decode(ids)
                if digest:
                    shown = " ".join(map(names.__getitem__, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(plain).hexdigest()))
                else:
                    rows.append((ids, plain))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in made.split(", ")])
            out.insert(0, id_column, pdf["i"].array)
            yield out

    return docs.selectExpr(f"`{id_column}` AS i", f"`{text_column}` AS t").mapInPandas(run, f"`{id_column}` {kind}, {made}")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"), digest=True)
