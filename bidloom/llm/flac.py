"""FLAC for 8-bit mono samples: an encoder, a decoder with checksums, and PCM blocks with sample offsets.

The encoder takes for each frame what gives the fewest bits: a linear predictor (LPC, from the frame's autocorrelation), a fixed
predictor (order 0 to 4), each with its Rice parameter, verbatim samples, or a constant. Frames of these kinds are decoded many
at a time: one lane for each frame, and a numpy step decodes the next Rice code, or predicts the next sample, of every lane. All
other frames are read one by one: partitioned residuals, five-bit parameters, escapes, wasted bits, other depths, and stereo.
The decoder checks the CRC-8 of each header, the CRC-16 of each frame, the MD5 of the samples and their number. A seek table
gives each frame's first sample and byte offset.

Null text counts as empty: its payload is 64 zero bytes. Texts may have any length. Equal texts give equal bytes. Repeated rows
get repeated results and an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bidloom.llm.common import buffer, keyed, lean, slices

RATE, BLOCK, PAD = 8000, 1024, 64
#: Lanes that are decoded together at most.
LANES = 8192
MAX_ORDER = 4
#: The linear predictor's order, and the bits of its coefficients; shorter frames have none.
LPC_ORDER, PRECISION, LPC_LEAST = 8, 12, 64


def _crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (bits - 1) else c << 1
        table[i] = c & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(parts: list[bytes]) -> np.ndarray:
    """CRC-16 of byte strings. The longest come first, so those that have a byte at a step are always the first ones."""
    sizes = np.array([len(x) for x in parts], np.int64)
    out = np.zeros(len(parts), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    for a in range(0, len(parts), LANES):
        who = order[a : a + LANES]
        columns = np.ascontiguousarray(_padded([parts[i] for i in who.tolist()], sizes[who]).T)
        c = np.zeros(len(who), np.uint32)
        live = len(who) - np.searchsorted(sizes[who][::-1], np.arange(len(columns)), side="right")
        for column, n in zip(columns, live.tolist(), strict=True):
            c[:n] = CRC16[(c[:n] >> 8) ^ column[:n]] ^ ((c[:n] << 8) & 0xFFFF)
        out[who] = c
    return out


def _utf8(number: int) -> bytes:
    """The frame number in the stretched UTF-8 form."""
    if number < 0x80:
        return bytes([number])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | number & 0x3F)
        number >>= 6
        if number < limit:
            break
        limit >>= 1
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | number, *reversed(tail)])


def _header(number: int, size: int) -> bytes:
    """A frame header: fixed block size, rate and depth from the stream's header, mono, 8 bits."""
    head = bytes([0xFF, 0xF8, 0x70, 0x02]) + _utf8(number) + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    """Write numbers of ``width`` bits at bit offsets."""
    for i in range(width):
        bits[at + i] = (values >> (width - 1 - i)) & 1


def _predicted(samples: np.ndarray, order: int) -> np.ndarray:
    """Residuals of a fixed predictor over rows; the first ``order`` columns are left out."""
    return np.diff(samples, order, axis=1)


def _linear(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number coefficients (rows of LPC_ORDER, for the samples before, nearest first) and their shifts."""
    x = samples.astype(np.float64)
    n = x.shape[1]
    lags = np.stack([(x[:, k:] * x[:, : n - k]).sum(1) for k in range(LPC_ORDER + 1)], 1)
    error, weights = lags[:, 0] * (1 + 1e-9) + 1e-9, np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):  # Levinson and Durbin's recursion over all rows
        reflection = (lags[:, i + 1] - (weights[:, :i] * lags[:, i:0:-1]).sum(1)) / error
        weights[:, :i] -= reflection[:, None] * weights[:, i - 1 :: -1][:, :i] if i else 0
        weights[:, i] = reflection
        error = np.maximum(error * (1 - reflection * reflection), 1e-9)
    largest = np.abs(weights).max(1)
    shift = np.clip(PRECISION - 2 - np.frexp(largest)[1], 0, 15)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(weights * np.exp2(shift)[:, None]), -most, most).astype(np.int32), shift.astype(np.int32)


def _linear_residual(samples: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """What a linear predictor leaves; the first LPC_ORDER columns are left out."""
    n = samples.shape[1]
    sums = np.zeros((len(samples), n - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        sums += weights[:, j, None] * samples[:, LPC_ORDER - 1 - j : n - 1 - j]
    return samples[:, LPC_ORDER:] - (sums >> shift[:, None])


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of two Rice parameters for each row, and the bits of the row's codes with it."""
    folded = (residual << 1) ^ (residual >> 31)
    count = folded.shape[1]
    guess = np.log2(np.maximum(folded.sum(1, dtype=np.int64) / max(count, 1), 1)).astype(np.int32)
    low = np.maximum(guess - 1, 0)
    one, two = ((folded >> k[:, None]).sum(1, dtype=np.int64) + count * (1 + k) for k in (low, guess))
    return np.where(one < two, low, guess), np.minimum(one, two)


def encode_frames(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of equal size (rows of signed samples), each with its header but without its CRC-16."""
    n, size = samples.shape
    head = [_header(x, size) for x in numbers]
    best = np.full(n, 8 * size, np.int64)  # verbatim
    choice, param = np.full(n, -1), np.zeros(n, np.int64)
    for order in range(min(MAX_ORDER, size - 1) + 1):
        k, cost = _rice(_predicted(samples, order))
        cost += 8 * order + 10
        better = cost < best
        if not better.any():
            break  # higher orders would only follow the noise more closely
        best, choice, param = np.where(better, cost, best), np.where(better, order, choice), np.where(better, k, param)
    if size >= LPC_LEAST:
        weights, shift = _linear(samples)
        residual = _linear_residual(samples, weights, shift)
        k, cost = _rice(residual)
        better = cost + 8 * LPC_ORDER + 9 + PRECISION * LPC_ORDER + 10 < best
        choice, param = np.where(better, LPC_ORDER, choice), np.where(better, k, param)
    flat = (samples == samples[:, :1]).all(1)
    choice[flat] = -2
    out: list[bytes] = [b""] * n
    for kind in np.unique(choice).tolist():
        rows = np.flatnonzero(choice == kind)
        own = samples[rows]
        if kind == -2:
            bodies = [bytes([0x00, x & 0xFF]) for x in own[:, 0].tolist()]
        elif kind == -1:
            bodies = [b"\x02" + x.astype(np.int8).tobytes() for x in own]
        elif kind == LPC_ORDER:
            first = [(np.full(len(rows), PRECISION - 1), 4), (shift[rows], 5), *((w, PRECISION) for w in weights[rows].T)]
            bodies = _rice_bodies(31 + LPC_ORDER, own[:, :LPC_ORDER], first, residual[rows], param[rows])
        else:
            bodies = _rice_bodies(8 + kind, own[:, :kind], [], _predicted(own, kind), param[rows])
        for i, body in zip(rows.tolist(), bodies, strict=True):
            out[i] = head[i] + body
    return out


def _padded(parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Byte strings as rows of a table, with zeros after them."""
    table = np.zeros((len(parts), int(sizes.max()) if len(parts) else 0), np.uint8)
    table[np.arange(table.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return table


def _rice_bodies(kind: int, warm: np.ndarray, first: list[tuple[np.ndarray, int]], r: np.ndarray, param: np.ndarray) -> list[bytes]:
    """Subframes: their kind, warm-up samples, numbers of given widths, and residuals in one Rice partition; whole bytes each."""
    n, order = warm.shape
    folded = (r << 1) ^ (r >> 31)
    quotient = folded >> param[:, None]
    length = quotient + 1 + param[:, None]
    begin = 8 + 8 * order + sum(width for _, width in first) + 10
    ends = begin + np.cumsum(length, 1)
    total = (ends[:, -1] if ends.shape[1] else np.full(n, begin)) + 7 & ~7
    base = np.cumsum(total) - total
    bits = np.zeros(int(total.sum()), np.uint8)
    at = base
    for value, width in [(np.full(n, kind << 1), 8), *((x & 0xFF, 8) for x in warm.T), *first]:
        _put(bits, at, value, width)
        at = at + width
    _put(bits, base + begin - 4, param, 4)  # after two bits of coding method and four of partition order, all zero
    at = base[:, None] + ends - length + quotient
    bits[at] = 1
    for k in np.unique(param).tolist():
        rows = param == k
        _put(bits, at[rows] + 1, folded[rows], k)
    raw, cuts = np.packbits(bits).tobytes(), (base >> 3).tolist()
    return [raw[a : a + m] for a, m in zip(cuts, (total >> 3).tolist(), strict=True)]


def encode(payloads: list[bytes], block: int = BLOCK, rate: int = RATE) -> list[bytes]:
    """FLAC streams of 8-bit mono samples (a byte less 128), each with STREAMINFO and a seek table of all frames."""
    tasks: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, payload in enumerate(payloads):
        for number, at in enumerate(range(0, len(payload), block)):
            part = payload[at : at + block]
            tasks.setdefault(len(part), []).append((i, number, part))
    frames: list[list[bytes]] = [[b""] * -(-len(x) // block) for x in payloads]
    for size, group in tasks.items():
        for a in range(0, len(group), LANES):
            part = group[a : a + LANES]
            samples = np.frombuffer(b"".join(x for _, _, x in part), np.uint8).reshape(-1, size).astype(np.int32) - 128
            for (i, number, _), frame in zip(part, encode_frames(samples, [x for _, x, _ in part]), strict=True):
                frames[i][number] = frame
    checks = iter(crc16([x for own in frames for x in own]).tolist())
    frames = [[x + next(checks).to_bytes(2, "big") for x in own] for own in frames]
    return [_stream(payload, own, block, rate) for payload, own in zip(payloads, frames, strict=True)]


def _stream(payload: bytes, frames: list[bytes], block: int, rate: int) -> bytes:
    sizes = [len(x) for x in frames] or [0]
    samples = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    packed = rate << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(samples).digest()
    offsets = np.cumsum([0, *sizes[:-1]]).tolist()
    points = b"".join((i * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, len(payload) - i * block).to_bytes(2, "big") for i, at in enumerate(offsets) if frames)
    return b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(frames)


class Damaged(ValueError):
    """A stream that isn't valid, or whose checksums don't hold."""


def _read_utf8(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    more = 7 - (first ^ 0xFF).bit_length()
    number = first & (0x3F >> more)
    for i in range(1, more + 1):
        number = number << 6 | data[at + i] & 0x3F
    return number, at + more + 1


def read_header(stream: bytes) -> dict:
    """STREAMINFO, seek points and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise Damaged("no FLAC marker")
    at, found, last = 4, {"points": []}, False
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            found |= {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            found["points"] = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
    if "block" not in found:
        raise Damaged("no STREAMINFO")
    return found | {"frames": at}


class Bits:
    """Reads numbers off a byte string."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise Damaged("a frame ends early")
        self.at += n
        return int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


#: Fixed values of the format: block sizes and sample depths by code, and coefficients of the fixed predictors.
SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _frame_header(data: bytes, at: int, info: dict) -> dict:
    """What a frame's header says, with its CRC-8 checked; ``body`` is where the subframes begin."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise Damaged("no frame where one should begin")
    codes, form = data[at + 2], data[at + 3]
    number, to = _read_utf8(data, at + 4)
    if (code := codes >> 4) in (6, 7):
        size = int.from_bytes(data[to : to + code - 5], "big") + 1
        to += code - 5
    else:
        size = SIZES[code]
    to += {12: 1, 13: 2, 14: 2}.get(codes & 15, 0)
    if crc8(data[at:to]) != data[to]:
        raise Damaged("a frame header's checksum is wrong")
    first = number if data[at + 1] & 1 else number * info["block"]
    return {"first": first, "size": size, "form": form >> 4, "bits": DEPTHS.get(form >> 1 & 7, info["bits"]), "body": to + 1}


def _residual(bits: Bits, size: int, order: int) -> list[int]:
    wide, parts = 4 + bits.take(2), bits.take(4)
    out: list[int] = []
    for i in range(1 << parts):
        count = (size >> parts) - (order if i == 0 else 0)
        k = bits.take(wide)
        if k == (1 << wide) - 1:
            depth = bits.take(5)
            out += [bits.signed(depth) for _ in range(count)]
        else:
            for _ in range(count):
                folded = bits.unary() << k | (bits.take(k) if k else 0)
                out.append(folded >> 1 ^ -(folded & 1))
    return out


def _subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    head = bits.take(8)
    kind, wasted = head >> 1 & 63, bits.unary() + 1 if head & 1 else 0
    depth -= wasted
    if kind == 0:
        samples = [bits.signed(depth)] * size
    elif kind == 1:
        samples = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        samples = [bits.signed(depth) for _ in range(order)]
        shift, weights = 0, FIXED.get(order, [])
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, size, order):
            samples.append(r + (sum(w * x for w, x in zip(weights, samples[: -order - 1 : -1], strict=True)) >> shift if order else 0))
    else:
        raise Damaged(f"subframe of an unknown kind {kind}")
    return np.array(samples, np.int64) << wasted


def read_frame(data: bytes, at: int, info: dict) -> tuple[dict, np.ndarray, int]:
    """One frame of any kind: (header, samples by channel, where the next begins)."""
    head = _frame_header(data, at, info)
    bits, form = Bits(data, 8 * head["body"]), head["form"]
    side = {8: 1, 9: 0, 10: 1}.get(form)
    channels = [_subframe(bits, head["size"], head["bits"] + (i == side)) for i in range(form + 1 if form < 8 else 2)]
    if form == 8:
        channels[1] = channels[0] - channels[1]
    elif form == 9:
        channels[0] = channels[0] + channels[1]
    elif form == 10:
        middle = channels[0] << 1 | channels[1] & 1
        channels = [(middle + channels[1]) >> 1, (middle - channels[1]) >> 1]
    end = (bits.at + 7 >> 3) + 2
    if end > len(data) or int(crc16([data[at : end - 2]])[0]) != int.from_bytes(data[end - 2 : end], "big"):
        raise Damaged("a frame's checksum is wrong")
    return head, np.stack(channels), end


def _residuals(frames: list[bytes], at: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Residuals of frames with one Rice partition, whose parameter is at the bit offsets ``at``; a lane for each frame.

    Lanes with most residuals come first, so those still at work are always the first ones.
    """
    order = np.argsort(-counts, kind="stable")
    frames, at, counts = [frames[i] for i in order.tolist()], at[order], counts[order]
    sizes = np.array([len(x) for x in frames], np.int64)
    base = np.cumsum(sizes) - sizes
    raw = b"".join(frames) + bytes(16)
    flat = np.frombuffer(raw, np.uint8)
    words = np.zeros(len(flat), np.uint64)
    for i in range(8):
        words[: len(flat) - i] |= flat[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    at = base * 8 + at
    k = (words[at >> 3] << (at & 7).astype(np.uint64) >> np.uint64(60)).astype(np.int64)
    at, limit = at + 4, (base + sizes) * 8
    back, keep = np.minimum(64 - k, 63).astype(np.uint64), k > 0
    steps = int(counts[0]) if len(counts) else 0
    out = np.zeros((steps, len(frames)), np.int16)
    live = len(counts) - np.searchsorted(counts[::-1], np.arange(steps), side="right")
    some_zero = not keep.all()
    for i, n in enumerate(live.tolist()):
        here, own = at[:n], k[:n]
        word = words[here >> 3] << (here & 7).astype(np.uint64)
        zeros = 52 - np.frexp((word >> np.uint64(12)).astype(np.float64))[1]
        rest = ((word << (zeros + 1).astype(np.uint64)) >> back[:n]).astype(np.int64)
        folded = (zeros << own) | (np.where(keep[:n], rest, 0) if some_zero else rest)
        far = (zeros > 44) | (zeros + own > 50)
        if far.any():
            for lane in np.flatnonzero(far).tolist():
                bits = Bits(raw, int(at[lane]))
                zeros[lane] = bits.unary()
                folded[lane] = int(zeros[lane]) << int(k[lane]) | (bits.take(int(k[lane])) if k[lane] else 0)
        out[i, :n] = folded >> 1 ^ -(folded & 1)
        here += zeros + 1 + own
        if i % 64 == 0 and (here > limit[:n]).any():
            raise Damaged("a frame ends early")
    found = np.ascontiguousarray(out.T)
    back_to = np.argsort(order)
    return [found[j, : counts[j]] for j in back_to.tolist()]


def _undone(warm: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """Samples (rows) from the warm-up samples of a fixed predictor and its residuals: running sums, one for each order."""
    order = warm.shape[1]
    x = residuals.astype(np.int32)
    for o in range(order, 0, -1):
        x = np.diff(warm, o - 1, axis=1)[:, -1:] + np.cumsum(x, 1, dtype=np.int32)
    return np.concatenate([warm, x], 1)


def _predicted_on(warm: np.ndarray, weights: np.ndarray, shift: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """Samples (rows) from the warm-up samples of linear predictors and their residuals: one step for all rows at a time."""
    n, order = warm.shape
    out = np.zeros((order + residuals.shape[1], n), np.int32)
    out[:order] = warm.T
    back, left = np.ascontiguousarray(weights[:, ::-1].T), np.ascontiguousarray(residuals.T)
    for t in range(residuals.shape[1]):
        out[order + t] = left[t] + ((back * out[t : t + order]).sum(0, dtype=np.int32) >> shift)
    return out.T


class Lane(NamedTuple):
    """How a frame is decoded beside others: its kind (order of a fixed predictor, -1 verbatim, -2 constant, -3 linear), the
    linear order and bits of coefficients, and the bit offset of the Rice parameter in the frame."""

    kind: int
    order: int = 0
    precision: int = 0
    rice: int = 0


def _lane(frame: bytes, body: int) -> Lane | None:
    """The lane of a frame, or None where it is read by itself."""
    kind = frame[body]
    if kind == 0x02:
        return Lane(-1)
    if kind == 0x00:
        return Lane(-2)
    linear = kind >= 0x40 and not kind & 1
    if not linear and kind not in (0x10, 0x12, 0x14, 0x16, 0x18):
        return None
    order = (kind >> 1) - 31 if linear else kind - 0x10 >> 1
    precision = (frame[body + 1 + order] >> 4) + 1 if linear else 0
    rice = 8 * (body + 1 + order) + (9 + precision * order if linear else 0)
    if linear and (precision > 15 or frame[body + 1 + order] >> 3 & 1):  # a negative shift is not of the format
        return None
    head = int.from_bytes(frame[rice >> 3 : (rice >> 3) + 3], "big") >> (14 - (rice & 7)) & 0x3FF
    if head >> 4 or head & 15 == 15:  # another coding method, partitions, or an escape
        return None
    return Lane(-3 if linear else order, order, precision, rice + 6)


def _coefficients(frames: list[bytes], body: list[int], order: int, precision: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, shifts) of linear predictors of one order and precision."""
    size = (9 + precision * order + 7) >> 3
    raw = np.array([np.frombuffer(frame, np.uint8, size, at + 1 + order) for frame, at in zip(frames, body, strict=True)])
    bits = np.unpackbits(raw, axis=1).astype(np.int32)
    place = 1 << np.arange(precision - 1, -1, -1)
    place[0] = -place[0]
    return bits[:, 9 : 9 + precision * order].reshape(len(frames), order, precision) @ place, bits[:, 4:9] @ (1 << np.arange(4, -1, -1))


def decode(streams: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(info, samples by channel) of streams, with all checksums verified; info has ``blocks``: (first sample, samples) of each frame."""
    infos = [read_header(x) for x in streams]
    parts: list[dict[int, np.ndarray]] = [{} for _ in streams]
    groups: dict[tuple[int, int, int, int], list[tuple[int, dict, bytes, int]]] = {}
    for i, (stream, info) in enumerate(zip(streams, infos, strict=True)):
        begin, points = info["frames"], info["points"]
        if sum(n for _, _, n in points) == info["samples"] and info["channels"] == 1 and info["bits"] == 8 and info["samples"]:
            ends = [at for _, at, _ in points[1:]] + [len(stream) - begin]
            for (_, at, _), end in zip(points, ends, strict=True):
                frame = stream[begin + at : begin + end]
                head = _frame_header(frame, 0, info)
                lane = _lane(frame, head["body"])
                if lane is None:
                    parts[i][head["first"]] = read_frame(frame, 0, info)[1]
                else:
                    groups.setdefault((lane.kind, lane.order, lane.precision, head["size"]), []).append((i, head, frame, lane.rice))
        else:
            at, done = begin, 0
            while done < info["samples"] or not info["samples"] and at < len(stream):
                head, samples, at = read_frame(stream, at, info)
                parts[i][head["first"]] = samples
                done += head["size"]
    every = [x[2] for group in groups.values() for x in group]
    if (crc16([x[:-2] for x in every]) != np.array([int.from_bytes(x[-2:], "big") for x in every], np.uint32)).any():
        raise Damaged("a frame's checksum is wrong")
    coded = [(*key, *x) for key, group in groups.items() for x in group if key[0] not in (-1, -2)]
    residuals: list[np.ndarray] = []
    for a in range(0, len(coded), LANES):
        part = coded[a : a + LANES]
        residuals += _residuals([x[6][:-2] for x in part], np.array([x[7] for x in part]), np.array([x[3] - x[1] for x in part]))
    rest = iter(residuals)
    for (kind, order, precision, size), group in groups.items():
        if kind == -1:
            samples = np.array([np.frombuffer(frame, np.int8, size, h["body"] + 1) for _, h, frame, _ in group], np.int32)
        elif kind == -2:
            samples = np.repeat(np.array([np.frombuffer(frame, np.int8, 1, h["body"] + 1) for _, h, frame, _ in group], np.int32), size, 1)
        else:
            warm = np.array([np.frombuffer(frame, np.int8, order, h["body"] + 1) for _, h, frame, _ in group], np.int32).reshape(len(group), order)
            left = np.stack([next(rest) for _ in group]).astype(np.int32)
            if kind == -3:
                samples = _predicted_on(warm, *_coefficients([x[2] for x in group], [x[1]["body"] for x in group], order, precision), left)
            else:
                samples = _undone(warm, left)
        for (i, head, _, _), own in zip(group, samples, strict=True):
            parts[i][head["first"]] = own[None]
    out = []
    for info, own in zip(infos, parts, strict=True):
        order = sorted(own)
        whole = np.concatenate([own[x] for x in order], 1) if order else np.zeros((info["channels"], 0), np.int64)
        raw = whole.T.astype(f"<i{max(1, info['bits'] + 7 >> 3)}") if info["bits"] != 24 else None
        if info["md5"] != bytes(16) and raw is not None and hashlib.md5(np.ascontiguousarray(raw).tobytes()).digest() != info["md5"] or info["samples"] and whole.shape[1] != info["samples"]:
            raise Damaged("the samples aren't those of the header")
        out.append((info | {"blocks": [(x, own[x].shape[1]) for x in order]}, whole))
    return out


def seek(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The frame that holds a sample, by the seek table: (its first sample, its samples by channel). Only that frame is read."""
    info = read_header(stream)
    for first, at, size in reversed(info["points"]):
        if first <= sample < first + size:
            return first, read_frame(stream, info["frames"] + at, info)[1]
    raise IndexError(sample)


def payloads(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of texts with zeros up to a positive multiple of PAD."""
    data, at = buffer(texts)
    raw, ends = data.tobytes(), at.tolist()
    return [raw[a:b] + bytes(max(PAD, -(-(b - a) // PAD) * PAD) - (b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def feature(samples: np.ndarray, info: dict) -> str:
    """Features of a decoded signal in whole numbers: rate, samples, blocks and the offset of the last, sum, energy, zero crossings."""
    x = samples[0].astype(np.int64)
    last = info["blocks"][-1][0] if info["blocks"] else 0
    return f"rate={info['rate']};samples={len(x)};blocks={len(info['blocks'])};last_offset={last};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def store(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a FLAC stream."""

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.diff(buffer(texts)[1])), pa.array(encode(payloads(texts)), pa.binary())]

    return keyed(run, df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), "id long, n_bytes long, media binary").withColumnRenamed("id", id_column)


def pcm_blocks(df: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """(id, block, sample_offset, samples, pcm): decoded blocks of each stream, interleaved little-endian signed samples. Null media give no rows."""
    names = ["id", "block", "sample_offset", "samples", "pcm"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                part = part.filter(part.column(1).is_valid())
                rows = []
                for key, (info, samples) in zip(part.column(0).to_pylist(), decode(part.column(1).to_pylist()), strict=True):
                    kind = f"<i{1 if info['bits'] <= 8 else 2 if info['bits'] <= 16 else 4}"
                    rows += [(key, k, first, n, samples[:, first : first + n].T.astype(kind).tobytes()) for k, (first, n) in enumerate(info["blocks"])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    found = df.selectExpr(f"`{id_column}` as id", f"`{media_column}` as media").mapInArrow(lean(run), "id long, block int, sample_offset long, samples int, pcm binary")
    return found.withColumnRenamed("id", id_column)


def described(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What stored streams (id, n_bytes, media) hold: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    sha = lambda many: pa.array([hashlib.sha256(x).hexdigest() for x in many], pa.string())

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                media = part.column(2).to_pylist()
                found = decode(media)
                back = [(samples[0] + 128).astype(np.uint8).tobytes() for _, samples in found]
                columns = [pa.array([len(x) for x in back], pa.int64()), sha(back), pa.array([zlib.crc32(x[-PAD:]) for x in back], pa.int64()), pa.array([len(x) for x in media], pa.int64()), sha(media), pa.array([feature(samples, info) for info, samples in found], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.selectExpr(f"`{id_column}` as id", "n_bytes", "media").mapInArrow(lean(run), schema).withColumnRenamed("id", id_column)


def round_trip(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Make the texts' streams, and describe what a reader finds in them.

    The streams are columns on their way from the one to the other. A job that keeps them writes ``store`` to a table, of about
    0.95 x the texts' bytes.
    """
    return described(store(df, id_column, text_column), id_column)
