"""Token counts through a digest cache.

Contents are addressed by digest, the cache by digest and tokenizer version
(the digest of the vocabulary file).  Distinct misses are encoded in Arrow
batches and appended; see ``content_store``.  The content is normalised by
reading null as the empty text and no further, since any other change could
change the count.

The vocabulary file describes byte-level BPE.  Texts of common characters are
encoded with ``tiktoken`` over the vocabulary read from that same file, which
gives the same ids several times faster; a text with any other character goes
through ``tokenizers`` itself, since the two libraries' Unicode tables may
differ there.  Special strings inside texts count as one token each, which is
that library's default.

Defined results: a null or empty text has no tokens and no bytes; equal rows
give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .content_store import ContentStore, folder

LIMIT = 1024
#: Names the folder of the digest cache; unset, every run has a new one.
CACHE = "spark.gatewise.counts"
# The pre-tokenisation pattern that byte-level BPE of this family is defined by.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII but for rare controls, Latin letters with accents, common punctuation.
COMMON = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ–—‘-„…€]*")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself if printable, else from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in own):
        letters[chr(256 + k)] = b
    return letters


def _ranked(model: dict, special: list[str]) -> bool:
    """Whether pieces are numbered in the order of the merges that make them, so that ids can stand for ranks."""
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    vocabulary = model["vocab"]
    made = ["".join(p) for p in pairs]
    whole = sorted((i, p) for p, i in vocabulary.items() if p not in special)
    letters = len(whole) - len(made)
    return (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and [p for _, p in whole[letters:]] == made
        and all(len(p) == 1 for _, p in whole[:letters])
    )


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from text to the number of its tokens, for one worker."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    special = [t["content"] for t in described["added_tokens"]]
    plain = (
        described["pre_tokenizer"].get("type") == "ByteLevel"
        and described["normalizer"] is None
        and described["pre_tokenizer"].get("use_regex", True)
        and not described["pre_tokenizer"].get("add_prefix_space")
        and _ranked(described["model"], special)
        and not any(t[k] for t in described["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    )
    fast = None
    if plain:
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in piece): i
            for piece, i in described["model"]["vocab"].items()
            if piece not in special
        }
        fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut = re.compile("|".join(map(re.escape, special))) if special else None

    def count(text: str) -> int:
        if fast is None or not COMMON.fullmatch(text):
            return len(own.encode(text, add_special_tokens=False))
        if cut is None or not cut.search(text):
            return len(fast.encode_ordinary(text))
        parts = cut.split(text)
        return len(parts) - 1 + sum(len(fast.encode_ordinary(p)) for p in parts)

    return count


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class TokenCounter:
    """Counts under one vocabulary file, cached in ``cache_path``.  The file must be readable on every executor."""

    def __init__(self, spark: SparkSession, vocabulary: str, cache_path: str):
        self.vocabulary = vocabulary
        self.store = ContentStore(spark, cache_path, "n_bytes long, n_tokens long", tokenizer_version(vocabulary))

    def _encode(self, misses: DataFrame) -> DataFrame:
        path = self.vocabulary

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            count = counter(path)
            texts = batch.column(1).to_pylist()
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([count(t) for t in texts], pa.int64()),
                ],
                ["content", "n_bytes", "n_tokens"],
            )

        return common.map_batches(misses, run, "content binary, n_bytes long, n_tokens long")

    def count(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, n_bytes, n_tokens)`` for every row of ``docs``."""
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
        keys = self.store.complete(rows, "body", self._encode)
        return self.store.attach(keys).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = TokenCounter(spark, str(public_tokenizers.path("byte_bpe_50k.json")), folder(spark, CACHE, "counts"))
    found = tokens.count(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
