"""Byte-level BPE with a local rank file: encoding and raw-byte decoding.

Texts are cut at safe boundaries, i.e. before ASCII white space that follows a character that isn't white space. No match
of the split pattern goes over such a place and its lookahead doesn't see past it, so the pieces' ids, end to end, are the
text's ids. Pieces repeat (" the"), so each distinct piece of a slice of texts is encoded once by the library.

Null text counts as empty (no ids); each row is handled by itself, so ties, repeated rows and empty tables need no rule, and
only the named id and text columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame

from bidloom.llm.common import buffer, keyed, lean, WHITE

#: Distinct pieces are joined to texts of about this many bytes.
JOIN_BYTES = 1 << 16
#: Most pieces that a worker keeps the ids of.
KNOWN_PIECES = 500_000


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the pieces: starts of texts, and white space after what surely isn't white space.

    After an ASCII character or one of two bytes (other than U+0085 and U+00A0) that is known; after a longer one it is
    left uncut, as some of those are white space.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        space, before = WHITE[data[1:]], data[:-1]
        lead = np.concatenate([[0], data[:-2]])
        known = (before > 0x20) & (before < 0x7F) | (before >= 0x80) & (lead > 0xC2) & (lead < 0xE0)
        cut[1:-1] = space & known
    cut[offsets] = True
    return np.flatnonzero(cut)


def _distinct_ids(distinct: pa.Array, encode_many: Callable[[list[str]], list], token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct pieces: (ids, first of each piece, number of each piece)."""
    if not len(distinct):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, at, raw = distinct.buffers()
    at, raw = np.frombuffer(at, np.int32)[: len(distinct) + 1].astype(np.int64), np.frombuffer(raw, np.uint8)
    last, lead = raw[at[1:] - 1], raw[np.maximum(at[1:] - 2, 0)]
    joined = WHITE[raw[at[:-1]]] & (np.diff(at) > 1) & ((last > 0x20) & (last < 0x7F) | (last >= 0x80) & (lead > 0xC2) & (lead < 0xE0))
    order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
    size = np.diff(at)[order]
    together = int(size[: int(joined.sum())].sum())
    source = np.repeat(at[:-1][order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text = raw[source].tobytes()
    ends = np.cumsum(size)
    stops = ends[: int(joined.sum())]
    runs = np.unique(np.append(stops[np.searchsorted(stops, np.arange(JOIN_BYTES, together, JOIN_BYTES))], together)) if together else stops
    bounds = np.concatenate([[0], runs, ends[int(joined.sum()) :]]).astype(np.int64)
    got = encode_many([text[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    flat = np.concatenate([np.asarray(x, np.uint32) for x in got])
    reach = np.concatenate([[0], np.cumsum(token_bytes[flat])])
    stop = np.searchsorted(reach, ends)
    start, count = np.zeros((2, len(order)), np.int64)
    count[order] = np.diff(stop, prepend=0)
    start[order] = stop - count[order]
    return flat, start, count


class Known:
    """Pieces whose ids a worker keeps for later slices (about 50 bytes each): KNOWN_PIECES at most, then it begins anew."""

    def __init__(self):
        self.pieces, self.flat = pa.array([], pa.binary()), np.zeros(0, np.uint32)
        self.start, self.count = np.zeros((2, 0), np.int64)

    def ids(self, distinct: pa.Array, encode: Callable[[pa.Array], tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode`` of all distinct pieces, which gets those only that aren't known."""
        where = pc.index_in(distinct, value_set=self.pieces)
        new = where.is_null().to_numpy(zero_copy_only=False)
        fresh = distinct.filter(pa.array(new))
        ids, start, count = encode(fresh)
        place = pc.fill_null(where, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[new] = len(self.pieces) + np.arange(len(fresh))
        flat, starts, counts = np.concatenate([self.flat, ids]), np.concatenate([self.start, len(self.flat) + start]), np.concatenate([self.count, count])
        out = flat, starts[place], counts[place]
        if len(starts) > KNOWN_PIECES:
            self.__init__()
        else:
            self.pieces, self.flat, self.start, self.count = pa.concat_arrays([self.pieces, fresh]), flat, starts, counts
        return out


def pieces_to_ids(texts: pa.Array, encode_many: Callable[[list[str]], list], token_bytes: np.ndarray, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and len + 1 offsets.

    ``encode_many`` is the library's encoder of a list of texts; ``token_bytes`` has each id's length. Distinct pieces that
    begin with white space and end otherwise go to it joined, as the places between them are safe too. Pieces that are ``known``
    from earlier texts aren't encoded again.
    """
    data, offsets = buffer(texts)
    cuts = safe_cuts(data, offsets)
    if len(cuts) < 2:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    coded = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    encode = functools.partial(_distinct_ids, encode_many=encode_many, token_bytes=token_bytes)
    flat, start, count = known.ids(coded.dictionary, encode) if known else encode(coded.dictionary)
    code = coded.indices.to_numpy(zero_copy_only=False)
    many = count[code]
    to = np.concatenate([[0], np.cumsum(many)])
    return flat[np.repeat(start[code] - to[:-1], many) + np.arange(to[-1])], to[np.searchsorted(cuts, offsets)]


@functools.cache
def rank_encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The library's encoding for a rank file (lines of base64 bytes and rank), without special tokens, and its ids' lengths."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def ids_of(texts: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts by a rank file, end to end, and len + 1 offsets."""
    encoding, lengths = rank_encoding(path, pattern)
    return pieces_to_ids(texts, lambda many: [encoding.encode_to_numpy(x) for x in many], lengths)


def encode(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, ids array<int>) for each row."""

    def run(texts: pa.Array) -> list[pa.Array]:
        ids, at = ids_of(texts, path, pattern)
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))]

    return keyed(run, df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), "id long, ids array<int>").withColumnRenamed("id", id_column)


def decode(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row (id, raw binary) for each row of ids: the tokens' bytes, which needn't be valid UTF-8. Null ids give no bytes."""

    def run(batches):
        for batch in batches:
            encoding = rank_encoding(path, pattern)[0]
            raw = [encoding.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    return df.selectExpr(f"`{id_column}` as id", f"`{ids_column}` as ids").mapInArrow(lean(run), "id long, raw binary").withColumnRenamed("id", id_column)


def round_trip(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode in one pass: (id, n_tokens, ids_sha256, decoded_sha256) for each row, so ids needn't leave the task."""

    def run(texts: pa.Array) -> list[pa.Array]:
        encoding = rank_encoding(path, pattern)[0]
        ids, at = ids_of(texts, path, pattern)
        little = ids.astype("<u4")
        ends = at.tolist()
        rows = [little[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [
            pa.array(np.diff(at), pa.int64()),
            pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in rows]),
            pa.array([hashlib.sha256(encoding.decode_bytes(x.tolist())).hexdigest() for x in rows]),
        ]

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return keyed(run, df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), schema).withColumnRenamed("id", id_column)
