r"""Secret scans with a recursive decoding worklist.

Base kinds, leftmost and non-overlapping in the text itself:

* assign: a name of `ASSIGN` with its value, 8 characters of value at least; the span is the whole match,
* access: `AKIA` and capital letters or digits, 16 characters at least,
* hex: a run of lower-case hexadecimal digits, 32 at least.

The worklist then unwraps layers until nothing new appears: URL escapes, Unicode escapes, base64
runs, and zlib, gzip or bzip2 streams inside base64. Every layer is scanned by the same rules and its
spans are mapped back to the characters of the original text they came from: characters of escapes
one by one, characters of a decoded run to the run as a whole. Each layer text is opened once per
document place (cycle detection). Base spans always stay; a mapped span equal to one found before is
listed once.

Streams are read to the end, every member of them; what follows a member and is none is left. A
layer of more than `MAX_LAYER` characters is scanned in pieces that share `OVERLAP` characters, so that
a compression bomb costs bounded memory: only a secret or a run longer than that may be cut where two
pieces meet. The document's own text is always read whole. A layer is text if it is UTF-8, or UTF-16 by
its mark or by the zero bytes of its Latin letters. Base64 that
goes on over line breaks is read as one run, and each of its lines as well.

Defined results: null counts as empty and has no spans; repeated rows get equal rows; other columns
are not read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import documents, small_batches

KINDS = ("assign", "access", "hex")
MAX_LAYER = 1 << 24
OVERLAP = 1 << 20
_STEP = 1 << 20
LEAST_RUN = 16

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_RUN)
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}" % LEAST_RUN
)
_SEPARATOR = re.compile(r"[+/_-]+")
#: Characters of a part of a run that are read to see whether it may hold a text.
_HEAD = 64
#: Characters of text at least in what is read behind a separator, and of a run that are decoded at once.
LEAST_TEXT = 12
_PART = 1 << 16
_BLANK = str.maketrans("", "", " \t\r\n")
_URLSAFE = str.maketrans("-_", "+/")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in one text."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _url_bytes(m: re.Match) -> tuple[str, list[tuple[int, int]]]:
    raw = bytes.fromhex(m.group().replace("%", ""))
    return _characters(raw, m.start(), 3)


def _characters(raw: bytes, at: int, width: int) -> tuple[str, list[tuple[int, int]]]:
    """Text of UTF-8 bytes (a byte that is none stands for itself) and each character's place."""
    out, places, i = [], [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + size].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append(chr(raw[i]))
        if len(out[-1]) != 1:  # fewer bytes left than tried
            out[-1] = out[-1][:1]
        places.append((at + i * width, at + min(len(raw), i + size) * width))
        i += size
    return "".join(out), places


def _unicode_units(m: re.Match) -> tuple[str, list[tuple[int, int]]]:
    t, at = m.group(), m.start()
    if t[1] == "x":
        return chr(int(t[2:], 16)), [(at, m.end())]
    if t[2] == "{":
        code = int(t[3:-1], 16)
        return (chr(code) if code < 0x110000 else "�"), [(at, m.end())]
    units = [int(t[i + 2 : i + 6], 16) for i in range(0, len(t), 6)]
    out, places, i = [], [], 0
    while i < len(units):
        u, n = units[i], 1
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            u, n = 0x10000 + ((u - 0xD800) << 10) + (units[i + 1] - 0xDC00), 2
        out.append(chr(u))
        places.append((at + 6 * i, at + 6 * (i + n)))
        i += n
    return "".join(out), places


class Layer:
    """A text and, for each of its characters, where it came from in the original text: arrays, one place
    (two numbers) for all of them, or nothing for the original itself."""

    def __init__(self, text: str, start: np.ndarray | int | None = None, end: np.ndarray | int | None = None) -> None:
        self.text, self.start, self.end = text, start, end

    def place(self, lo: int, hi: int) -> tuple[int, int]:
        if self.start is None:
            return lo, hi
        if isinstance(self.start, int):
            return self.start, self.end
        return int(self.start[lo:hi].min()), int(self.end[lo:hi].max())

    def unescaped(self, pattern: re.Pattern, decode) -> Layer | None:
        """The text with every match decoded in place; None without a match."""
        pieces, starts, ends, at = [], [], [], 0
        one, s, e = isinstance(self.start, int), None, None
        for m in pattern.finditer(self.text):
            text, places = decode(m)
            pieces += [self.text[at : m.start()], text]
            if not one:
                if s is None:
                    s = np.arange(len(self.text)) if self.start is None else self.start
                    e = s + 1 if self.start is None else self.end
                starts += [s[at : m.start()], [int(s[lo:hi].min()) for lo, hi in places]]
                ends += [e[at : m.start()], [int(e[lo:hi].max()) for lo, hi in places]]
            at = m.end()
        if not pieces:
            return None
        pieces.append(self.text[at:])
        if one:
            return Layer("".join(pieces), self.start, self.end)
        starts.append(s[at:])
        ends.append(e[at:])
        return Layer("".join(pieces), np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64))

    def runs(self) -> Iterator[Layer]:
        """The texts inside base64 runs, compressed ones unpacked, one piece at a time."""
        for m in _RUN.finditer(self.text):
            yield from self._read(*m.span())
        for m in _WRAPPED.finditer(self.text):
            for at, to in _wrapped(m):
                yield from self._layers(at, to)

    def _layers(self, at: int, to: int) -> Iterator[Layer]:
        lo, hi = self.place(at, to)
        for text in _opened(self.text[at:to].translate(_BLANK)):
            yield Layer(text, lo, hi)

    def _read(self, at: int, to: int) -> Iterator[Layer]:
        """A run, or what can be read in it.

        What stands in front (a path, a name) shifts base64 out of step, and what stands behind ends it: a run
        that is no text as a whole is tried from behind each of its separators and in each of the
        four steps. Where the first characters promise a stream it is read as one; where they are text, it is
        text as far as its bytes are, and the search goes on behind that, so a run is read about once.
        """
        told = False
        for layer in self._layers(at, to):
            told = True
            yield layer
        if told:
            return
        body = self.text[at:to].rstrip("=").translate(_URLSAFE)
        done = 0
        for start in chain(range(1, 4), (m.end() for m in _SEPARATOR.finditer(body))):
            if start < done or len(body) - start < LEAST_RUN:
                continue
            head = _decoded(body[start : start + _HEAD])
            if _is_stream(head) or head.count(0) >= len(head) // 3 or head[:2] in (b"\xff\xfe", b"\xfe\xff"):
                stop = len(body) - (len(body) - start) % 4
                for layer in self._layers(at + start, at + stop):
                    done = stop
                    yield layer
            elif len(text := _shown(head)) >= LEAST_TEXT:
                text, stop = _text_of(body, start)
                done = stop
                yield Layer(text, *self.place(at + start, at + stop))


def _wrapped(m: re.Match) -> list[tuple[int, int]]:
    """Places of wrapped base64 in lines of its characters: equally long lines with the shorter one after them."""
    lines = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[^\s]+", m.group())]
    width = [to - at for at, to in lines]
    out, first = [], 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or width[k] != width[first]:
            last = k if k < len(lines) and width[k] < width[first] else k - 1
            if last > first and width[first] >= LEAST_RUN:
                out.append((lines[first][0], lines[last][1]))
            first = k
    return out


def _opener(head: bytes) -> Callable | None:
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:1] == b"\x78":
        return zlib.decompressobj
    return None


def _inflated(parts: Iterator[bytes], new: Callable) -> Iterator[bytes]:
    """The bytes of all members of a stream; raises if it is none, ends at a later fault."""
    d, told = new(), False
    try:
        for data in parts:
            while True:
                out = d.decompress(data, _STEP)
                if out:
                    told = True
                    yield out
                if d.eof:
                    data = d.unused_data
                    d = new()
                    if not data:
                        break
                else:
                    data = getattr(d, "unconsumed_tail", b"")
                    if not data and not out:
                        break
    except (zlib.error, OSError, EOFError, ValueError):
        if not told:
            raise


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """The bytes, decompressed as often as they are a stream."""
    head, parts = raw, iter(())
    while (new := _opener(head)) is not None:
        more = _inflated(chain([head], parts), new)
        try:
            inner = next(more, None)
        except (zlib.error, OSError, EOFError, ValueError):
            break
        if inner is None or inner == head:
            break
        head, parts = inner, more
    return chain([head], parts)


def _opened(run: str) -> Iterator[str]:
    """The text that a base64 run holds, if it holds one; a long one in pieces that overlap."""
    body = run.rstrip("=").translate(_URLSAFE)
    if len(body) % 4 == 1:
        return
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    for codec in _codecs(raw):
        told = False
        try:
            for text in _texts(_unpacked(raw), codec):
                told = True
                yield text
        except UnicodeDecodeError:
            pass
        if told:
            return


def _codecs(raw: bytes) -> list[str]:
    """Encodings to try, in order, by the first bytes of what is unpacked."""
    head = next(iter(_unpacked(raw)), b"")[:512]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return ["utf-16"]
    even, odd = head[::2].count(0), head[1::2].count(0)
    if max(even, odd) >= len(head) // 8 and len(head) > 3 and (even == 0) != (odd == 0):
        return ["utf-16-le" if odd else "utf-16-be", "utf-8"]
    return ["utf-8"]


def _texts(parts: Iterator[bytes], codec: str) -> Iterator[str]:
    """The decoded text, a long one in pieces that overlap."""
    decoder = codecs.getincrementaldecoder(codec)()
    held, size, shared = [], 0, 0
    for data in parts:
        held.append(decoder.decode(data))
        size += len(held[-1])
        if size >= MAX_LAYER:
            text = "".join(held)
            yield text
            held, size = [text[-OVERLAP:]], min(OVERLAP, size)
            shared = size
    held.append(decoder.decode(b"", True))
    text = "".join(held)
    if len(text) > shared:
        yield text


def _decoded(run: str) -> bytes:
    """The bytes of a run of the standard alphabet without padding, as far as it goes."""
    left = len(run) % 4
    return base64.b64decode(run[: len(run) - (left == 1)] + "=" * ((4 - left) % 4 if left != 1 else 0))


def _is_stream(head: bytes) -> bool:
    """Whether bytes begin as a gzip, bzip2 or zlib stream, by all that its header fixes."""
    if head[:3] == b"\x1f\x8b\x08" or head[:3] == b"BZh" and head[4:10] == b"1AY&SY":
        return True
    return len(head) > 1 and head[0] == 0x78 and int.from_bytes(head[:2]) % 31 == 0


def _shown(raw: bytes) -> str:
    """The text that bytes begin with: UTF-8, up to the first character that is not shown."""
    text = raw.decode("utf-8", "replace")
    return next((text[:k] for k, c in enumerate(text) if c == "\ufffd" or not (c.isprintable() or c in "\t\r\n")), text)


def _text_of(body: str, start: int) -> tuple[str, int]:
    """The text of a run from `start` as far as its bytes are UTF-8, and the place in the run where that ends."""
    decoder, out, at = codecs.getincrementaldecoder("utf-8")(), [], start
    while at < len(body):
        raw = _decoded(body[at : at + _PART])
        try:
            out.append(decoder.decode(raw))
        except UnicodeDecodeError as fault:
            held = len(fault.object) - len(raw)  # what the decoder had kept of the part before
            out.append(fault.object[: fault.start].decode("utf-8"))
            return "".join(out), min(len(body), at + -(-max(0, fault.start - held) * 4 // 3))
        at += _PART
    return "".join(out), len(body)


def _inner(layer: Layer) -> Iterator[Layer | None]:
    """The layers right inside one, made when they are asked for."""
    if "%" in layer.text:
        yield layer.unescaped(_URL, _url_bytes)
    if "\\u" in layer.text or "\\x" in layer.text:
        yield layer.unescaped(_UNICODE, _unicode_units)
    yield from layer.runs()


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as sorted (start, kind, end) in code points of the text.

    The worklist holds, for each layer that is open, what is left of the layers in it; a layer is worked off before
    the next one beside it is unpacked, so no more than one piece a level of nesting is held at once.
    """
    if not text:
        return [], []
    base = sorted(scan(text))
    every = dict.fromkeys(base)
    seen = {hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest() + b"whole"}
    work = [_inner(Layer(text))]
    while work:
        layer = next(work[-1], work)
        if layer is work:
            work.pop()
            continue
        if layer is None:
            continue
        # A layer with the same text at the same place has been opened.
        place = b"whole" if len(layer.text) == 0 else b"%d:%d" % layer.place(0, len(layer.text))
        key = hashlib.sha1(layer.text.encode("utf-8", "surrogatepass")).digest() + place
        if key in seen:
            continue
        seen.add(key)
        for lo, kind, hi in scan(layer.text):
            start, end = layer.place(lo, hi)
            every[(start, kind, end)] = None
        work.append(_inner(layer))
    return base, sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


def secret_spans(docs: DataFrame, text_col: str = "text") -> Column:
    """A struct column for `docs`: base and spans, as strings kind:start:end joined by commas."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<n_assign: long, n_access: long, n_hex: long, base: string, spans: string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, every = find_secrets(t)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), joined(base), joined(every)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans"])

    return find(F.col(text_col))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", secret_spans(docs).alias("s")).select(
        "doc_id", "s.n_assign", "s.n_access", "s.n_hex", F.sha2("s.base", 256).alias("base_sha256"), F.col("s.spans").alias("spans")
    )
