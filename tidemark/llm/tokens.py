"""Token ids and token counts of whole texts by the library a vocabulary file belongs to."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_chunks

BATCH_BYTES = 1 << 20
LONG = 1 << 16
# Byte-level pre-tokenisation starts a token at a single space between two other characters.
BORDER = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the pattern of byte-level pre-tokenisation.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters of which every Unicode version has one opinion.
SETTLED = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ‐-…€]*")


def split_long(text: str, limit: int = LONG) -> list[str]:
    """A text in parts of about `limit` characters, cut at safe borders only; a stretch without one stays whole."""
    out, begin = [], 0
    while len(text) - begin > limit:
        border = BORDER.search(text, begin + limit)
        if border is None:
            break
        out.append(text[begin : border.start()])
        begin = border.start()
    out.append(text[begin:])
    return out


class Encoder:
    """Ids of texts, from the content of a vocabulary file; made once in each Python worker."""

    made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, name: str, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.ranked = None
        self.splits = False
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(content.decode("utf-8"))
            self.tokenizer.no_padding()
            self.tokenizer.no_truncation()
            spec = json.loads(content)
            before = spec.get("pre_tokenizer") or {}
            self.splits = (
                before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
                and not spec.get("normalizer")
                and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
            )
            if self.splits:
                self.ranked = self._by_ranks(spec)
            self.encode = lambda texts: self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        elif name.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode = lambda texts: processor.encode(texts, num_threads=1)
        else:
            raise ValueError(f"no library for {name}")

    @staticmethod
    def _by_ranks(spec: dict):
        """The same merges as ranks, several times faster; None unless ids are in the order of merges."""
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        letters = len(ByteLevel.alphabet())
        ordered = all(vocab.get("".join(m)) == letters + i for i, m in enumerate(merges))
        if model["type"] != "BPE" or not ordered or model.get("dropout") or model.get("ignore_merges"):
            return None
        # the printable stand-ins of bytes: visible Latin-1 characters are themselves, the others follow from 256 on
        shown = [b for b in range(256) if chr(b) in ByteLevel.alphabet()]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def get(cls, name: str, content: bytes) -> Encoder:
        key = (name, len(content))
        if key not in cls.made:
            cls.made[key] = cls(name, content)
        return cls.made[key]

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text: one batch call, long texts in parts."""
        parts = [split_long(t) if self.splits else [t] for t in texts]
        flat = iter([len(e) for e in self.encode([p for ps in parts for p in ps])])
        return [sum(next(flat) for _ in ps) for ps in parts]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers.

        Texts of settled characters are merged by rank, all others by the tokenizer itself.
        """
        out: list[bytes | None] = [None] * len(texts)
        if self.ranked is not None:
            for i, text in enumerate(texts):
                if SETTLED.fullmatch(text):
                    out[i] = self.ranked.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, self.encode([texts[i] for i in rest]) if rest else []):
            out[i] = np.array(getattr(found, "ids", found), "<u4").tobytes()
        return out


def vocabulary(spark, path: str):
    """A vocabulary file as a broadcast of its name and bytes (a few MB); the file is read by the driver only."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast((os.path.basename(path), file.read()))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids with `n_bytes`, `n_tokens` and `over_limit` (more than `limit` tokens), one row per row of `docs`.

    Batches hold about a megabyte of text each, whatever their number of rows; long texts
    are split where the pre-tokeniser splits anyway; lengths only leave the function.
    Begin, end and other added tokens are left out; special strings inside a text are
    handled as the library does by default. Null text is empty: 0 tokens. Null ids and
    repeated rows are returned as they are; an empty table gives an empty result.
    """
    shared = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(*shared.value)
        for batch in in_chunks(batches, "text", BATCH_BYTES):
            n = encoder.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
