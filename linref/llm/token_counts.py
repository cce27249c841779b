"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where their tokens agree."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, LIMIT = 1 << 16, 1 << 10, 512
#: Characters on which both libraries' character classes are sure to agree: ASCII but separators, Latin letters, common punctuation.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7f\xa1-ɏ‐-‧€]*")


#: A space between two characters that aren't white space.
_LONE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """The byte-level BPE of a tokenizers file, by the ranks file of the same vocabulary, which encodes several times faster.

    Texts with characters outside _PLAIN are left to the tokenizers library itself."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        every = ranks | {k.encode(): v for k, v in special.items()}
        self.sizes = np.zeros(max(every.values()) + 1, np.int64)
        for token, i in every.items():
            self.sizes[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token ends; tokens that end within a character have the end of the character."""
        if _PLAIN.fullmatch(text):
            return np.cumsum(self.sizes[np.asarray(self.fast.encode(text, allowed_special="all"), np.int64)])
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bytes_to = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
        return bytes_to[np.array([b for _, b in self.slow.encode(text, add_special_tokens=False).offsets], np.int64)]

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) > chunk:
            return count_spliced(self.ends, text, chunk, overlap)
        return len(self.fast.encode(text, allowed_special="all") if _PLAIN.fullmatch(text) else self.slow.encode(text, add_special_tokens=False).ids)


def count_spliced(ends, text: str, chunk: int, overlap: int) -> int:
    """The number of tokens of a text of which only chunks are encoded at a time; ends(text) gives the byte at which each token ends.

    Two neighbouring chunks overlap. They are spliced at the last byte in the overlap that ends a token in both and lies between a
    character that isn't white space and a single space before another such character: no pre-token reaches across that place, and what
    follows does not depend on what came before, so both chunks' tokens are those of the whole text there. When the overlap has
    no such place it is doubled, in the end up to the whole text."""
    done, start, count = 0, 0, 0  # bytes counted; where the present chunk starts, in characters and in bytes
    start_byte = 0
    while True:
        stop = min(len(text), start + chunk)
        part = text[start:stop]
        here = ends(part) + start_byte
        if stop == len(text):
            return count + int((here > done).sum())
        wide = overlap
        while True:
            back = max(start, stop - wide)
            if back == start:  # nothing agreed within the whole chunk: take a longer one
                chunk *= 2
                break
            raw_before = len(text[start:back].encode()) + start_byte
            ahead = ends(text[back : min(len(text), back + chunk)]) + raw_before
            shared = text[back:stop]
            code = np.frombuffer(shared.encode("utf-32-le"), np.uint32)
            size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            place = (np.cumsum(size) - size)[[m.start() for m in _LONE.finditer(shared)]] + raw_before
            agreed = np.intersect1d(np.intersect1d(here, ahead), place)
            agreed = agreed[agreed > done]
            if len(agreed):
                at = int(agreed[-1])
                count += int(((here > done) & (here <= at)).sum())
                done, start, start_byte = at, back, raw_before
                break
            wide *= 2


_encoders: dict[tuple, Encoder] = {}


def _counts(paths: tuple[str, str, str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _encoders:
            _encoders[paths] = Encoder(*paths)
        count = _encoders[paths].count
        for batch in batches:
            n = np.fromiter((count(t.as_py()) for t in batch.column("text")), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(df: DataFrame, json_path: str, ranks_path: str, pattern: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text.

    Special strings in a text count as their one token, as is the tokenizers library's default; no begin or end tokens. Null or empty text:
    0 bytes, 0 tokens. Repeated rows and null keys: each row its own result. Empty table: no rows. Other columns are ignored."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return docs.mapInArrow(_counts((json_path, ranks_path, pattern), limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
