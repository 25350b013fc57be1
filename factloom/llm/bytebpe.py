"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where the split pattern always has a boundary: before a blank, line break or other
white space that follows anything else, and between a full stop, comma or the like of Chinese and
Japanese and a letter of these or of Korean after it. No match of the pattern runs from other signs
into white space, nor from such a mark into a letter, and none looks behind itself, so the pieces' ids
joined are the ids of the whole. Letters without any such place between them are one match of the
pattern, of any length, and stay one piece. Decoding joins the tokens' raw
bytes, so texts come back to the byte, also where a token holds part of a character.

Null texts count as empty: no ids. Repeated rows each get a row. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from factloom.llm.common import per_text

#: Code points of a piece at least, after which the next safe boundary cuts.
PIECE = 50_000
_SAFE = re.compile("(?<=\\S)[ \\t\\n\\r\u3000]|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """`text` cut at safe boundaries, each piece at least `size` long but for the last."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode(text: str, ranks_path: str, pattern: str, size: int = PIECE) -> np.ndarray:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    enc = encoding(ranks_path, pattern)
    parts = [np.array(enc.encode_ordinary(p), "<u4") for p in pieces(text, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, ranks_path: str, pattern: str) -> bytes:
    return encoding(ranks_path, pattern).decode_bytes(ids.tolist())


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (id_col, ids array<int>)."""
    ranks = ranks_path or default_ranks()
    return per_text(df, text_col, [id_col], pa.schema([("ids", pa.list_(pa.int32()))]), "ids array<int>", lambda t: (encode(t, ranks, pattern).astype(np.int32),))


def round_trips(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (id_col, n_tokens long, ids_sha256, decoded_sha256): encodes, decodes the ids, digests both."""
    ranks = ranks_path or default_ranks()

    def both(text: str) -> tuple[int, str, str]:
        ids = encode(text, ranks, pattern)
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(ids, ranks, pattern)).hexdigest()

    out = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return per_text(df, text_col, [id_col], out, "n_tokens long, ids_sha256 string, decoded_sha256 string", both)
