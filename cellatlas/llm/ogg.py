"""Media columns: Ogg physical streams with two logical streams, written and read back.

A payload is stored as unsigned 8-bit samples in packets of one logical stream; a second logical stream carries a small
text packet with the unpadded length. Pages of both are interleaved. Reading verifies each page's checksum and sequence
number, reassembles packets from the lacing values, demultiplexes the logical streams by serial number and derives each
page's time from its granule position (samples so far, at ``RATE`` a second).

Scale: one pass over the documents without any shuffle; a row's memory is a few times its text, rows are handled one at
a time, and nothing depends on other rows.

Edge cases: a null text counts as empty; an empty payload is one block of 64 zero bytes; a text of any length is whole
(pages hold at most 255 segments, packets may span pages). Equal texts give equal bytes. A damaged stream raises
``OggError`` in :func:`demux`; :func:`probe` reports it in a column instead, as it does a null media value. Ids of any type
come out unchanged; rows that repeat give a row each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

RATE = 8000
PACKET = 4096
BLOCK = 64
PCM_SERIAL, TEXT_SERIAL = 0x50434D38, 0x54455854
_PCM_HEAD = b"pcm8" + struct.pack("<IB", RATE, 1)
_TEXT_HEAD = b"text" + struct.pack("<I", 1)
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    """A stream that breaks the container's rules."""


def checksum(page: bytes) -> int:
    """Ogg's CRC (0x04C11DB7, most significant bit first, no inversion) by way of the mirrored CRC of zlib."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes((size % 255,))


def pages(serial: int, packets: list[tuple[bytes, int]], last: bool = True) -> Iterator[bytes]:
    """Pages of one logical stream from (packet, granule position at its end); the first packet has a page of its own."""
    number, continued = 0, False
    groups: list[tuple[bytes, bytes, int, bool]] = []  # lacing, body, granule position or -1, starts inside a packet
    for head, rest in ((packets[:1], False), (packets[1:], True)):
        lacing, body, granule, continued = bytearray(), bytearray(), -1, False
        for packet, position in head:
            laces, at = _lacing(len(packet)), 0
            while laces:
                if len(lacing) == 255:
                    groups.append((bytes(lacing), bytes(body), granule, continued))
                    continued = at > 0 or len(laces) < len(_lacing(len(packet)))
                    lacing, body, granule = bytearray(), bytearray(), -1
                take = laces[: 255 - len(lacing)]
                laces = laces[len(take) :]
                lacing += take
                body += packet[at : at + sum(take)]
                at += sum(take)
            granule = position
        if lacing:
            groups.append((bytes(lacing), bytes(body), granule, continued))
    for number, (lacing, body, granule, continued) in enumerate(groups):
        kind = continued | 2 * (number == 0) | 4 * (last and number == len(groups) - 1)
        page = _HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
        yield page[:22] + checksum(page).to_bytes(4, "little") + page[26:]


def mux(*streams: Iterator[bytes]) -> bytes:
    """Interleaves the pages of logical streams, all first pages first."""
    rows = [list(s) for s in streams]
    out = [s[0] for s in rows]
    for i in range(1, max(map(len, rows))):
        out += [s[i] for s in rows if i < len(s)]
    return b"".join(out)


def demux(data: bytes) -> dict[int, dict]:
    """serial: packets (bytes), pages (count), times (seconds at each page with a granule position), ended."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError(f"cut short at {at}")
        mark, version, kind, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        if mark != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"cut short at {at}")
        page = data[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"wrong checksum at {at}")
        if bool(kind & 2) == (serial in streams):
            raise OggError(f"stream {serial:#x} begins wrongly at {at}")
        s = streams.setdefault(serial, {"packets": [], "pages": 0, "times": [], "ended": False, "open": b""})
        if number != s["pages"] or bool(kind & 1) != bool(s["open"]) or s["ended"]:
            raise OggError(f"page {number} of stream {serial:#x} is out of order")
        body, part, parts = at + 27 + n, 0, [s["open"]]
        for lace in lacing:
            part += lace
            if lace < 255:
                parts.append(data[body : body + part])
                s["packets"].append(b"".join(parts))
                body, part, parts = body + part, 0, []
        s["open"] = b"".join([*parts, data[body : body + part]])
        s["pages"] += 1
        s["ended"] = bool(kind & 4)
        if granule >= 0:
            s["times"].append(granule / RATE)
        at = end
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def payload(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8, filled with zero bytes to a positive multiple of 64, and its unpadded length."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % BLOCK or BLOCK * (not raw)), len(raw)


def store(text: str | None) -> bytes:
    data, n = payload(text)
    packets = [(_PCM_HEAD, 0)] + [(data[i : i + PACKET], min(i + PACKET, len(data))) for i in range(0, len(data), PACKET)]
    return mux(pages(PCM_SERIAL, packets), pages(TEXT_SERIAL, [(_TEXT_HEAD, 0), (b"n_bytes=%d" % n, len(data))]))


def restore(media: bytes) -> tuple[bytes, int, dict[int, dict]]:
    """(payload, unpadded length, logical streams) of stored bytes."""
    streams = demux(media)
    pcm, text = streams[PCM_SERIAL]["packets"], streams[TEXT_SERIAL]["packets"]
    if pcm[0] != _PCM_HEAD or text[0] != _TEXT_HEAD:
        raise OggError("unknown codec")
    return b"".join(pcm[1:]), int(text[1].removeprefix(b"n_bytes=")), streams


def media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): the stored bytes of each whole text."""

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_columns(rows, lambda given: {"media": [store(t) for t in given["text"]]}, "media binary")


_PROBE = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def describe(stored_bytes: bytes | None) -> tuple:
    """The columns of ``_PROBE``, all from the stored bytes as they were read back."""
    if stored_bytes is None:
        return (*[None] * 7, "no media")
    try:
        data, n, streams = restore(stored_bytes)
    except (OggError, KeyError, IndexError, ValueError, struct.error) as e:
        return None, None, None, None, len(stored_bytes), hashlib.sha256(stored_bytes).hexdigest(), None, str(e)
    pcm = streams[PCM_SERIAL]
    feature = f"streams={len(streams)};pages={sum(s['pages'] for s in streams.values())};packets={len(pcm['packets']) - 1};seconds={pcm['times'][-1]:.6f};mean={sum(data[:n]) / max(n, 1):.6f};peak={max(data)}"
    return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(stored_bytes), hashlib.sha256(stored_bytes).hexdigest(), feature, None


def probe(stored_media: DataFrame) -> DataFrame:
    """(doc_id, media) to the features of each media value; ``error`` says why one can't be read."""

    names = [x.split()[0] for x in _PROBE.split(", ")]

    def run(given: dict[str, list]) -> dict[str, list]:
        rows = [describe(m) for m in given["media"]]
        return {name: [r[i] for r in rows] for i, name in enumerate(names)}

    return with_columns(stored_media.select("doc_id", "media"), run, _PROBE)
