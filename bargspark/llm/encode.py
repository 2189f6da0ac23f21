"""Problem 6: every text as ids of a public byte-level BPE, by forced-boundary splitting.

Two neighbouring bytes that stand next to each other inside no token of the
vocabulary can never be joined by a merge, so a token boundary between them is
certain. `Encoder` reads the vocabulary, tabulates which of the 65,536 byte
pairs occur inside a token, and cuts a text only at pairs that do not:

* before ASCII white space that follows anything else, which gives fragments of
  a word with the white space before it (in this vocabulary only the pair A0 20
  occurs inside tokens, so nothing is cut after characters that end in A0).
  White space stays with what follows it, as the pattern's look-ahead looks to
  the right, so it never sees a false end of text;
* inside a fragment, between two letters whose bytes form such a pair, where the
  last cut is 16 characters or more away: one rule for fragments of any length,
  which leaves ordinary words whole and keeps a text without white space from
  being one piece.

Fragments are encoded independently, each distinct one once per worker, and
their ids are concatenated.

Defined results: null and empty texts give the empty list; strings of special
tokens are ordinary text; the text is taken as stored, without normalising.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, slices, spread

#: Fixed: the white space of ASCII. Parts inside a fragment have at least LEAST characters.
WHITE, LEAST = " \t\n\r\f\v", 16


def vocab_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inside = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self.cut = re.compile(self._pattern())
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo = Memo(self._fragment)

    def _pattern(self) -> str:
        """White space and what follows it up to the next white space; on past it where a pair of the two bytes there occurs inside a token."""
        joined = [a for a in range(256) if chr(a) not in WHITE and self.inside[a, [ord(w) for w in WHITE]].any()]
        w, solid = f"[{WHITE}]", f"[^{WHITE}]"
        if not joined:
            return f"{w}*{solid}+|{w}+"
        low = {a & 0x3F for a in joined if a >= 0x80}
        ends = "".join(re.escape(chr(a)) for a in joined if a < 0x80) + "".join(chr(c) for c in range(0x80, 0x10000) if c & 0x3F in low and not 0xD800 <= c < 0xE000)
        if low:
            ends += "\U00010000-\U0010ffff"
        return f"{w}*{solid}+(?:(?<=[{ends}]){w}+{solid}*)*|{w}+"

    def _inner(self, fragment: str) -> list[str]:
        """Cuts between letters that no token joins."""
        out, start = [], 0
        for i in range(LEAST, len(fragment)):
            a, b = fragment[i - 1], fragment[i]
            if i - start >= LEAST and a.isalpha() and b.isalpha() and not self.inside[a.encode()[-1], b.encode()[0]]:
                out.append(fragment[start:i])
                start = i
        return [*out, fragment[start:]]

    def _fragment(self, fragment: str) -> bytes:
        return b"".join(np.array(self.bpe.encode_ordinary(p), np.int32).tobytes() for p in self._inner(fragment))

    def fragments(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian int32 bytes."""
        return b"".join(map(self.memo.__getitem__, self.fragments(text))) if text else b""


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): one row per row of df. No shuffle, except where the scan has fewer splits than the cluster cores."""
    path = path or vocab_path()

    def run(batches):
        enc = encoder(path)
        for batch in slices(batches, text):
            parts = [enc.ids(t) for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int64) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(key, text)).mapInArrow(run, schema)
