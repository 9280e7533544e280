"""Units of many packets at once, found over the packets' common byte buffer.

Every function takes the bytes, where each packet starts and ends in them (packets lie one behind the other), and returns
:class:`Units`. Work is done on whole arrays; no Python object is made for a packet or a unit.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Why a packet is malformed; its code is its place here
STATUSES = ["ok", "no-start-code", "data-before-start-code", "truncated-length", "invalid-length", "empty", "forbidden-bit",
            "truncated-extension", "truncated-size", "size-too-long", "size-exceeds-packet", "missing-header"]
_CODE = {status: code for code, status in enumerate(STATUSES)}
_SIZE_BITS = range(0, 56, 7)  # Fixed value: a leb128 size has at most eight bytes


@dataclass
class Units:
    """Units by packet and place: the packet of each, its first byte and the one behind its last; a status for each packet.

    What a framing does not tell stays None.
    """

    packet: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    status: np.ndarray
    type: np.ndarray | None = None
    layer: np.ndarray | None = None
    temporal_id: np.ndarray | None = None
    hidden: np.ndarray | None = None

    def of_good_packets(self) -> Units:
        good = self.status[self.packet] == 0
        rest = {name: getattr(self, name) for name in ("type", "layer", "temporal_id", "hidden")}
        return Units(self.packet[good], self.begin[good], self.end[good], self.status,
                     **{name: None if values is None else values[good] for name, values in rest.items()})


def _bytes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes as long integers; places outside the buffer, which callers leave out, read as some other byte."""
    if not data.size:
        return np.zeros(at.shape, np.int64)
    return data[np.clip(at, 0, data.size - 1)].astype(np.int64)


def annex_b(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Units:
    """Units between start codes 00 00 01 or 00 00 00 01; only zeros may come before the first."""
    code = np.flatnonzero((data[:-2] == 0) & (data[1:-1] == 0) & (data[2:] == 1))
    packet = np.searchsorted(ends, code, side="right")
    inside = code + 3 <= ends[packet]
    code, packet = code[inside], packet[inside]
    numbers = np.bincount(packet, minlength=len(starts))
    status = np.where(numbers > 0, 0, _CODE["no-start-code"])
    led = np.flatnonzero(numbers)
    first = code[np.cumsum(numbers)[led] - numbers[led]]
    led, first = led[first > starts[led]], first[first > starts[led]]
    if led.size:
        edges = np.stack([starts[led], first], axis=1).ravel()
        status[led[np.logical_or.reduceat(data != 0, edges)[::2]]] = _CODE["data-before-start-code"]
    begin = code + 3
    following = np.append(code[1:], 0)
    ends_packet = np.append(packet[1:] != packet[:-1], True)[:len(code)]
    zero_before = (following > begin) & (_bytes_at(data, following - 1) == 0)
    end = np.where(ends_packet, ends[packet], following[:len(code)] - zero_before[:len(code)])
    return _with_headers(data, Units(packet, begin, end, status))


def length_prefixed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> Units:
    """Units behind a big-endian length of ``width`` bytes."""

    def step(at, stop):
        size = np.zeros(len(at), np.int64)
        for place in range(width):
            size = size << 8 | _bytes_at(data, at + place)
        body = at + width
        problem = np.where((size == 0) | (body + size > stop), _CODE["invalid-length"], 0)
        return body, body + size, np.where(body > stop, _CODE["truncated-length"], problem), None

    return _with_headers(data, _walk(starts, ends, step))


def av1(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Units:
    """OBUs with their types; only the last may leave out its leb128 size."""

    def step(at, stop):
        header = _bytes_at(data, at)
        payload = at + 1 + (header >> 2 & 1)
        problem = np.where(header & 0x80, _CODE["forbidden-bit"], np.where(payload > stop, _CODE["truncated-extension"], 0))
        sized = ((header & 2) != 0) & (problem == 0)
        size, more = np.zeros(len(at), np.int64), sized.copy()
        for bits in _SIZE_BITS:
            more &= payload < stop
            byte = _bytes_at(data, payload)
            size += np.where(more, (byte & 0x7F) << bits, 0)
            payload = payload + more
            done = more & (byte < 0x80)
            problem = np.where(done, -1, problem)
            more &= ~done
        complete = problem == -1
        problem = np.where(complete, np.where((size > 0xFFFFFFFF) | (payload + size > stop), _CODE["size-exceeds-packet"], 0), problem)
        unfinished = sized & ~complete
        problem = np.where(unfinished, np.where(payload >= stop, _CODE["truncated-size"], _CODE["size-too-long"]), problem)
        return at, np.where(sized, payload + size, stop), problem, header >> 3 & 0x0F

    units = _walk(starts, ends, step)
    units.status = np.where(starts == ends, _CODE["empty"], units.status)
    return units.of_good_packets()


def vp9(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Units:
    """Frames of a superframe, or the whole packet where its index does not hold; ``hidden`` frames are not shown."""
    marker = _bytes_at(data, ends - 1)
    count, width = (marker & 7) + 1, (marker >> 3 & 3) + 1
    index = ends - 2 - width * count
    holds = (ends > starts) & (marker & 0xE0 == 0xC0) & (index >= starts) & (_bytes_at(data, index) == marker)
    begins, stops = np.empty((len(starts), 8), np.int64), np.empty((len(starts), 8), np.int64)
    at = starts.astype(np.int64)
    for n in range(8):
        size = sum(np.where(place < width, _bytes_at(data, index + 1 + n * width + place) << 8 * place, 0) for place in range(4))
        begins[:, n], stops[:, n] = at, at + size
        holds &= (n >= count) | (at + size <= index)
        at = at + np.where(n < count, size, 0)
    begins[~holds, 0], stops[~holds, 0] = starts[~holds], ends[~holds]
    packet, place = np.nonzero(np.arange(8) < np.where(holds, count, 1)[:, None])
    begin, end = begins[packet, place], stops[packet, place]
    header = _bytes_at(data, begin)
    shift = np.where((header >> 4 & 3) == 3, 1, 0)  # Profile 3 has one reserved bit more
    hidden = (end > begin) & (header >> 6 == 2) & (header >> (3 - shift) & 1 == 0) & (header >> (1 - shift) & 1 == 0)
    return Units(packet, begin, end, np.zeros(len(starts), np.int64), hidden=hidden)


def _walk(starts: np.ndarray, ends: np.ndarray, step) -> Units:
    """Units that each tell where the next begins: the n-th of all packets at once, as long as packets have one.

    ``step`` takes the places and their packets' ends; it returns first and last byte, a problem's code or 0, and types.
    """
    status = np.zeros(len(starts), np.int64)
    packet = np.flatnonzero(starts < ends)
    at, found = starts[packet].astype(np.int64), []
    while packet.size:
        begin, end, problem, kind = step(at, ends[packet])
        status[packet] = problem
        found.append((packet, begin, end, begin if kind is None else kind))
        on = (problem == 0) & (end < ends[packet])
        packet, at = packet[on], end[on]
    packet, begin, end, kind = (np.concatenate(parts) for parts in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    order = np.argsort(packet, kind="stable")
    return Units(packet[order], begin[order], end[order], status, type=kind[order])


def _with_headers(data: np.ndarray, units: Units) -> Units:
    """NAL units with the fields of their two-byte header; a packet with a shorter unit is malformed."""
    units = units.of_good_packets()
    units.status[units.packet[units.end - units.begin < 2]] = _CODE["missing-header"]
    units = units.of_good_packets()
    first, second = _bytes_at(data, units.begin), _bytes_at(data, units.begin + 1)
    units.type, units.layer, units.temporal_id = first >> 1 & 0x3F, (first & 1) << 5 | second >> 3, (second & 7) - 1
    return units


def find_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, framing: str) -> Units:
    """Units by ``framing``: ``annex-b``, ``length-1`` to ``length-4``, ``av1`` or ``vp9``."""
    if framing.startswith("length-"):
        return length_prefixed(data, starts, ends, int(framing[-1]))
    return {"annex-b": annex_b, "av1": av1, "vp9": vp9}[framing](data, starts, ends)
