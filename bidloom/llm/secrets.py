"""Secret scan with a recursive decoding worklist.

Each text is scanned as it stands (the base spans), then its layers are unwrapped: URL escapes, Unicode escapes and
compatibility forms, base64 runs, and compressed bytes inside those or under escapes. Every new layer is scanned and unwrapped again until
none is new; a layer already seen at the same place is dropped, which ends cycles. A layer carries, for each character, the
span of the text it came from, so what is found inside is reported in the text's own code points. A base64 run may stand beside
other characters of its alphabet (a path, an underscore), so it is decoded from each of its first four characters, which meets
any place where one could begin. Plain content maps to the groups of four characters that hold it, compressed content to the
characters from its first byte to its last.

Null and empty texts have no spans, an empty table gives no rows. Rows are handled one by one (repeated rows give repeated results) and only the named
columns are read. Bytes that are no UTF-8 or UTF-16 are read as Latin-1. All members of compressed bytes are read, and compression
inside compression is opened as it comes. Content of more than ``most_bytes`` is handled in blocks that overlap by ``OVERLAP`` bytes
and so is never held whole; ``oversize`` says so.

Base64 text may be wrapped in lines of 16 characters or more of either alphabet, indented or quoted. Where escapes or odd characters
are replaced, the new layer has the lines that hold them, not the whole text again, so chance ones in decoded noise cost little and
time is in proportion to length.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import itertools
import lzma
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import keyed

#: The kinds, their patterns, and the least length of the part that counts (group 2, or the match).
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": re.compile(ASSIGN, re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Where these don't occur, neither a secret nor a layer does (for the vectorised pass over all texts).
MAYBE_SECRET = rf"(?i:{ASSIGN})|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"


def _odd() -> list[tuple[int, int]]:
    """Ranges of characters that are invisible or stand for others: format characters, the joiner U+034F and variation selectors,
    and all that NFKC changes. Planes without any are left out."""
    out: list[tuple[int, int]] = []
    for c in (*range(0x80, 0xAC00), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        x = chr(c)
        if unicodedata.category(x) == "Cf" or c == 0x34F or 0xFE00 <= c < 0xFE10 or 0xE0100 <= c < 0xE01F0 or unicodedata.normalize("NFKC", x) != x:
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


_RANGES = _odd()
ODD = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _RANGES) + "]")
MAYBE_LAYER = r"%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|\\[uUxX]|&#|[A-Za-z0-9+/_-]{16}|[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _RANGES) + "]"

MOST_BYTES = 64 << 20
#: Bytes that the blocks of a large layer share.
OVERLAP = 1 << 20

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
#: Runs of bytes as escapes and plain characters, for compressed bytes; and how those begin.
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~-])+")
ESCAPED_BYTES = re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|\\[\\'"nrtabfv0]|[ !#-&(-\[\]-~])+""")
ONE_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\.|.", re.DOTALL)
PLAIN = dict(zip("nrtabfv0", "\n\r\t\a\b\f\v\0", strict=True))
STANDARD = str.maketrans("-_", "+/")
MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64 text, each but the last ended by a line feed, with an indent or marks of a quotation or comment before it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t>#*|;]{0,16}+)++[A-Za-z0-9+/_-]+={0,2}")
SOLID = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LINE = re.compile(r"[ \t>#*|;]{0,16}[A-Za-z0-9+/_%=-]{16,}[ \t\r]*")
#: What divides the stretches of a layer that were cut out: no pattern goes over it.
BETWEEN = "\n \n"
#: Bytes fed to a decompressor at once, and bytes by which chance signatures are told from compressed content.
FEED, PROBE = 1 << 16, 1 << 12
#: Layers of compression inside one another that are opened where each is too large to be held.
DEEPEST = 64


class Layer(NamedTuple):
    """A decoded text; character i came from starts[i]:ends[i] of the whole text."""

    text: str
    starts: np.ndarray
    ends: np.ndarray


def matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets that stand plainly in a text."""
    out = []
    for kind in KINDS:
        for m in PATTERNS[kind].finditer(text):
            if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def _stretches(text: str, changes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The whole lines that changes a:b lie in, and lines of base64 text beside those: what a change can have a part in, as neither a
    secret nor another layer's run goes over the end of a line. All of the text where that is most of it."""
    breaks = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
    out: list[tuple[int, int]] = []
    for a, b in changes:
        if out and b <= out[-1][1]:
            continue
        low, high = bisect_left(breaks, a) - 1, bisect_left(breaks, b)
        while low > 0 and breaks[low] + 1 > (out[-1][1] if out else 0) and LINE.fullmatch(text, breaks[low - 1] + 1, breaks[low]):
            low -= 1
        while high < len(breaks) - 1 and LINE.fullmatch(text, breaks[high] + 1, breaks[high + 1]):
            high += 1
        begin, end = breaks[low] + 1, breaks[high]
        if out and begin <= out[-1][1] + 1:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return [(0, len(text))] if 2 * sum(b - a for a, b in out) > len(text) else out


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """Replace matches by (characters, source lengths) of ``decode``; of the rest the lines around them stay."""
    changes = []
    for m in pattern.finditer(layer.text):
        new, lengths = decode(m[0])
        if new != m[0]:
            changes.append((m.start(), m.end(), new, lengths))
    if not changes:
        return None
    texts, starts, ends, i = [], [], [], 0
    for low, high in _stretches(layer.text, [x[:2] for x in changes]):
        if texts:
            texts.append(BETWEEN)
            starts.append(np.full(len(BETWEEN), layer.ends[low - 1]))
            ends.append(np.full(len(BETWEEN), layer.ends[low - 1]))
        at = low
        while i < len(changes) and changes[i][1] <= high:
            a, b, new, lengths = changes[i]
            i += 1
            texts += [layer.text[at:a], new]
            begin = a + np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64) if new else np.zeros(0, np.int64)
            starts += [layer.starts[at:a], layer.starts[begin]]
            ends += [layer.ends[at:a], layer.ends[begin + np.asarray(lengths, np.int64) - 1] if new else begin]
            at = b
        texts.append(layer.text[at:high])
        starts.append(layer.starts[at:high])
        ends.append(layer.ends[at:high])
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends))


def _percent(run: str) -> tuple[str, list[int]]:
    raw = unquote_to_bytes(run)
    try:
        text = raw.decode()
        return text, [3 * len(c.encode()) for c in text]
    except UnicodeDecodeError:
        return raw.decode("latin-1"), [3] * len(raw)


def _escape(run: str) -> tuple[str, list[int]]:
    if run[0] == "&":
        text = html.unescape(run)
        return text, [len(run) - len(text) + 1] + [1] * (len(text) - 1) if text else []
    code = int(run[2:].strip("{}"), 16)
    return (chr(code), [len(run)]) if code < 0x110000 else (run, [1] * len(run))


def _compatible(one: str) -> str:
    return "" if unicodedata.category(one) in ("Cf", "Mn") else unicodedata.normalize("NFKC", one)


def _folded(layer: Layer) -> Layer:
    """A layer's lines with odd characters, less the invisible ones and with the characters that the others stand for."""
    at = [m.start() for m in ODD.finditer(layer.text)]
    table = {ord(c): _compatible(c) for c in {layer.text[i] for i in at}}
    many = np.ones(len(layer.text), np.int64)
    many[at] = [len(table[ord(layer.text[i])]) for i in at]
    texts, starts, ends = [], [], []
    for low, high in _stretches(layer.text, [(i, i + 1) for i in at]):
        if texts:
            texts.append(BETWEEN)
            starts.append(np.full(len(BETWEEN), layer.ends[low - 1]))
            ends.append(starts[-1])
        texts.append(layer.text[low:high].translate(table))
        starts.append(np.repeat(layer.starts[low:high], many[low:high]))
        ends.append(np.repeat(layer.ends[low:high], many[low:high]))
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends))


def _surrogates(layer: Layer) -> Layer:
    """Pairs of surrogate escapes become one character."""
    return _replaced(layer, re.compile("[\ud800-\udbff][\udc00-\udfff]"), lambda x: (x.encode("utf-16", "surrogatepass").decode("utf-16"), [2])) or layer


def _kind(raw) -> str | None:
    """How bytes are compressed, by their first ones."""
    first = bytes(raw[:6])
    if first[:2] == b"\x1f\x8b" or first[:1] == b"\x78" and len(first) > 2 and int.from_bytes(first[:2], "big") % 31 == 0:
        return "zlib"
    return "bzip2" if first[:3] == b"BZh" else "xz" if first == b"\xfd7zXZ\x00" else "zstd" if first[:4] == b"\x28\xb5\x2f\xfd" else None


class _Source:
    """Chunks of bytes as a file to read from."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.rest = chunks, b""

    def read(self, size: int) -> bytes:
        self.rest = self.rest or bytes(next(self.chunks, b""))
        out, self.rest = self.rest[:size], self.rest[size:]
        return out


def _decompressed(chunks: Iterator[bytes], size: int, left: list[int], bare: bool = False) -> Iterator[bytes]:
    """The content of compressed chunks in pieces of at most ``size``, member after member; it ends where they are damaged. In the
    end ``left`` has the number of bytes after the last member. ``bare``: the first is deflate without a header."""
    left[:] = [0]
    data = b""
    try:
        while True:
            while len(data) < 8 and (more := bytes(next(chunks, b""))):
                data += more
            kind = "bare" if bare else _kind(data)
            if kind is None:
                left[:] = [len(data) + sum(map(len, chunks))]
                return
            bare = False
            if kind == "zstd":
                tool = zstandard.ZstdDecompressor().stream_reader(_Source(itertools.chain([data], chunks)), read_across_frames=True)
                while piece := tool.read(size):
                    yield piece
                return
            tool = bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor() if kind == "xz" else zlib.decompressobj(-15 if kind == "bare" else 47)
            while not tool.eof:
                if not data and getattr(tool, "needs_input", True) and not (data := bytes(next(chunks, b""))):
                    return
                if kind in ("bzip2", "xz"):
                    piece, data = tool.decompress(data, size), b""
                else:
                    saved = tool.copy()
                    try:
                        piece = tool.decompress(data, size)
                    except zlib.error:
                        yield from _before_damage(saved, data, size)
                        return
                    data = tool.unconsumed_tail
                if piece:
                    yield piece
            data = tool.unused_data
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


def _before_damage(tool, data: bytes, size: int) -> Iterator[bytes]:
    """What a damaged chunk gives up to the damage: in ever smaller steps, as a step that fails gives nothing."""
    size = min(size, FEED)
    while size:
        saved = tool.copy()
        try:
            piece = tool.decompress(data, size)
        except zlib.error:
            tool, size = saved, size // 16
            continue
        data = tool.unconsumed_tail
        if not piece:
            return
        yield piece


def _fed(raw) -> Iterator[memoryview]:
    view = memoryview(raw)
    return (view[i : i + FEED] for i in range(0, len(view), FEED))


def _pieces(raw, size: int, left: list[int], bare: bool = False) -> Iterator[bytes]:
    return _decompressed(_fed(raw), size, left, bare)


def _holds(raw) -> bool:
    """Whether bytes with a signature of compression do give content."""
    part = raw[:PROBE] if _kind(raw) == "zlib" else raw
    return next(_pieces(part, 1, []), None) is not None


def _peeled(chunks: Iterator[bytes], size: int) -> Iterator[bytes]:
    """Chunks of content without the compression inside it, as they come, down to DEEPEST layers."""
    for _ in range(DEEPEST):
        first = b""
        while len(first) < 8 and (more := next(chunks, b"")):
            first += more
        chunks = itertools.chain([first], chunks)
        if _kind(first) is None:
            break
        kept: list[bytes] | None = []
        source = chunks

        def noted(source=source, kept=kept):
            for x in source:
                if not kept or kept[0] is not None:
                    kept.append(x)
                yield x

        inner = _decompressed(noted(), size, [])
        below = next(inner, None)
        if below is None:  # it only looks compressed
            chunks = itertools.chain(list(kept), source)
            break
        kept[:] = [None]
        chunks = itertools.chain([below], inner)
    return chunks


def _blocks(pieces: Iterator[bytes], most: int) -> Iterator[bytes]:
    """Content in blocks of at most ``most`` bytes, each beginning with the end of the one before; pieces are at most as long as
    ``_piece(most)``."""
    shared = min(OVERLAP, most // 2)
    block = bytearray()
    for piece in pieces:
        if len(block) + len(piece) > most:
            yield bytes(block)
            del block[: max(0, len(block) - shared) & ~1]
        block += piece
    if block:
        yield bytes(block)


def _piece(most: int) -> int:
    return max(1, min(1 << 20, most - min(OVERLAP, most // 2) - 1))


def _whole(block: bytes, first: bool) -> bytes:
    """A block of a large layer less the bytes of UTF-8 characters that its ends cut; the blocks beside it have them."""
    start = 0 if first else next((i for i in range(min(4, len(block))) if block[i] & 0xC0 != 0x80), 0)
    for i in range(1, min(4, len(block)) + 1):
        if block[-i] & 0xC0 != 0x80:
            size = 1 if block[-i] < 0xC0 else 2 if block[-i] < 0xE0 else 3 if block[-i] < 0xF0 else 4
            return block[start : len(block) - i if size > i else None]
    return block[start:]


def _texts(raw, most: int, over: list[bool], bare: bool = False) -> Iterator[str]:
    """The content of compressed bytes (``bare``: without a header) as text, down to what isn't compressed, in blocks where it is
    large (``over`` then gets an entry); nothing where they only look compressed."""
    seen, first = set(), raw
    while bare or _kind(raw) is not None:
        content = _pieces(raw, _piece(most), [], bare)
        bare = False
        held, size = [], 0
        for piece in content:
            held.append(piece)
            size += len(piece)
            if size > most:
                break
        if size > most:
            over.append(True)
            yield from _large(_blocks(_peeled(itertools.chain(held, content), _piece(most)), most))
            return
        below = b"".join(held)
        if not below or (key := xxhash.xxh3_128_digest(below)) in seen:
            break
        seen.add(key)
        raw = below
    if raw is not first:
        yield _readable(raw)


def _large(blocks: Iterator[bytes]) -> Iterator[str]:
    """The blocks of a large layer as text, each without the characters that its ends cut."""
    below = next(blocks, b"")
    mark = below[:2] if below[:2] in (b"\xff\xfe", b"\xfe\xff") else b""
    wide = mark or below[1::2].count(0) > len(below) // 4
    yield _readable(below[: len(below) & ~1] if wide else _whole(below, True))
    for block in blocks:
        yield _readable(mark + block[: len(block) & ~1] if wide else _whole(block, False))


def _readable(raw: bytes) -> str:
    """Bytes as text: UTF-8, UTF-16 where zero bytes say so, or Latin-1."""
    try:
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return raw.decode("utf-16")
        if len(raw) % 2 == 0 and raw[1::2].count(0) > len(raw) // 4:
            return raw.decode("utf-16-le")
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _is_deflate(raw: bytes) -> bool:
    """Are bytes that aren't text a whole deflate stream without a header?"""
    if len(raw) < 8 or _is_text(raw):
        return False
    tool, rest = zlib.decompressobj(-15), raw
    try:
        while not tool.eof and rest:
            tool.decompress(rest, 1 << 16)
            rest = tool.unconsumed_tail
    except zlib.error:
        return False
    return tool.eof


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


def _bytes_of(run: str) -> bytes:
    """The bytes of characters of the base64 alphabet; what is left over in the end counts for nothing."""
    run = run.translate(STANDARD)
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _opened(layer: Layer, parts: list[tuple[int, int]], most: int, over: list[bool]) -> Iterator[Layer]:
    """The layers that a base64 run may hold, whose characters are the parts a:b of a layer."""
    solid = "".join(layer.text[a:b] for a, b in parts)
    at = np.concatenate([np.arange(a, b) for a, b in parts])[: len(solid.rstrip("="))]
    stop, solid = int(layer.ends[parts[-1][1] - 1]), solid.rstrip("=")
    starts, ends = layer.starts[at], layer.ends[at]
    for shift in range(min(4, max(1, len(solid) - 11))):
        raw = _bytes_of(solid[shift:])
        view = memoryview(raw)
        group = shift + 4 * (np.arange(len(raw)) // 3)
        begin, end = starts[group], np.where(group + 4 < len(solid), ends[np.minimum(group + 3, len(solid) - 1)], stop)
        whole = lambda inner, x, y: Layer(inner, np.broadcast_to(begin[x], len(inner)), np.broadcast_to(end[y], len(inner)))  # noqa: B023, E731
        if _kind(raw) is None and _is_deflate(raw):
            for inner in _texts(raw, most, over, bare=True):
                yield whole(inner, 0, -1)
        for m in MAGIC.finditer(raw):
            if _holds(view[m.start() :]):
                for inner in _texts(view[m.start() :], most, over):
                    yield whole(inner, m.start(), -1)
        text = _readable(raw)
        if len(text) == len(raw):
            yield Layer(text, begin, end)
            continue
        size = np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in text), np.int64, len(text))
        if size.sum() == len(raw):
            last = np.cumsum(size) - 1
            yield Layer(text, begin[last - size + 1], end[last])
            continue
        yield Layer(raw.decode("latin-1"), begin, end)
        yield whole(text, 0, -1)


def _hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _byte_run(run: str) -> tuple[bytes, list[int]]:
    """The bytes of a run of escapes and plain characters, and where each ends in it."""
    raw, ends = bytearray(), []
    for m in ONE_BYTE.finditer(run):
        one = m[0]
        raw.append(int(one[-2:], 16) if len(one) > 2 else ord(PLAIN.get(one[1], one[1])) if len(one) == 2 else ord(one))
        ends.append(m.end())
    return bytes(raw), ends


def _unwrapped(layer: Layer, runs: set, most: int, over: list[bool]) -> Iterator[Layer]:
    """All layers one step below, one at a time; ``runs`` has the runs of this text already opened, by place."""
    text = layer.text

    def inside(inner: str, begin: int, end: int) -> Layer:
        return Layer(inner, np.broadcast_to(np.int64(begin), len(inner)), np.broadcast_to(np.int64(end), len(inner)))

    if "%" in text and (new := _replaced(layer, URL, _percent)):
        yield new
    if ("\\" in text or "&#" in text or "%u" in text) and (new := _replaced(layer, ESCAPE, _escape)):
        yield _surrogates(new)
    if not text.isascii() and ODD.search(text):
        yield _folded(layer)
    for sign, pattern in (("%", URL_BYTES), ("\\x", ESCAPED_BYTES)):
        for m in pattern.finditer(text) if sign in text else ():
            if sign not in m[0]:
                continue
            raw, ends = _byte_run(m[0])
            view = memoryview(raw)
            for at in MAGIC.finditer(raw):
                a = m.start() + (ends[at.start() - 1] if at.start() else 0)
                begin, part = int(layer.starts[a]), view[at.start() :]
                if not _holds(part) or (key := (begin, int(layer.ends[m.end() - 1]), xxhash.xxh3_128_digest(part))) in runs:
                    continue
                runs.add(key)
                left = [0]
                for _ in _pieces(part, FEED, left):
                    pass
                end = int(layer.ends[m.start() + ends[len(raw) - 1 - left[0]] - 1])
                for inner in _texts(part, most, over):
                    yield inside(inner, begin, end)
    found = [[m.span()] for m in BASE64.finditer(text)]
    if "\n" in text:
        found += [[x.span() for x in SOLID.finditer(text, *m.span())] for m in WRAPPED.finditer(text)]
    for parts in found:
        a, b = parts[0][0], parts[-1][1]
        if (key := (int(layer.starts[a]), int(layer.ends[b - 1]), _hash(text[a:b]))) not in runs:
            runs.add(key)
            yield from _opened(layer, parts, most, over)


def scan(text: str, most_bytes: int = MOST_BYTES) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], bool]:
    """(base spans, all spans, oversize) of one text; spans by start, then kind as listed, then end."""
    base = matches(text)
    spans, seen, runs, over = set(base), set(), set(), []
    place = np.arange(len(text) + 1)
    work = [iter([Layer(text, place[:-1], place[1:])])]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        key = (_hash(layer.text), int(layer.starts[0]), int(layer.ends[-1])) if layer.text else (b"", 0, 0)
        if key in seen:
            continue
        seen.add(key)
        if layer.text is not text:
            spans |= {(kind, int(layer.starts[a : b].min()), int(layer.ends[a:b].max())) for kind, a, b in matches(layer.text)}
        work.append(_unwrapped(layer, runs, most_bytes, over))
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(spans, key=order), bool(over)


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scanned(texts: pa.Array):
    """(row, base, all, oversize) of the texts that may hold something."""
    maybe = pc.or_(pc.match_substring_regex(texts, MAYBE_SECRET), pc.match_substring_regex(texts, MAYBE_LAYER))
    rows = np.flatnonzero(pc.fill_null(maybe, False).to_numpy(zero_copy_only=False))
    for i, text in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist(), strict=True):
        yield i, text, *scan(text)


def find(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: (id, base, spans, oversize); base and spans are arrays of (kind, start, end), end exclusive."""

    def run(texts: pa.Array) -> list[pa.Array]:
        base, spans, over = [[] for _ in texts], [[] for _ in texts], [False] * len(texts)
        for i, _, b, s, o in _scanned(texts):
            base[i], spans[i], over[i] = b, s, o
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda many: pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in one] for one in many], kind)
        return [rows(base), rows(spans), pa.array(over)]

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    found = keyed(run, df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), f"id long, base {span}, spans {span}, oversize boolean")
    return found.withColumnRenamed("id", id_column)


def digest(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The spans of ``find`` as counts, a hash and a string: (id, n_assign, n_access, n_hex, base_sha256, spans, oversize)."""

    def run(texts: pa.Array) -> list[pa.Array]:
        counts, empty = np.zeros((3, len(texts)), np.int64), hashlib.sha256(b"").hexdigest()
        sha, spans, over = [empty] * len(texts), [""] * len(texts), [False] * len(texts)
        for i, _, b, s, o in _scanned(texts):
            for kind, _, _ in b:
                counts[KINDS.index(kind), i] += 1
            sha[i], spans[i], over[i] = hashlib.sha256(joined(b).encode()).hexdigest(), joined(s), o
        return [*map(pa.array, counts), pa.array(sha), pa.array(spans), pa.array(over)]

    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, oversize boolean"
    return keyed(run, df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), schema).withColumnRenamed("id", id_column)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """A text with all spans (overlapping ones joined) replaced by a mark."""
    out, at = [], 0
    for _, a, b in spans:
        if b > at:
            out += [text[at:a], mark] if a >= at else []
            at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows and columns; secrets in the text column are replaced by ``[secret]``, null stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        values = pa.array(texts, pa.string(), from_pandas=True)
        out = values.to_pylist()
        for i, text, _, spans, _ in _scanned(values):
            out[i] = redacted(text, spans)
        return type(texts)(out, dtype=object)

    return df.withColumn(text_column, clean(F.col(text_column)))
