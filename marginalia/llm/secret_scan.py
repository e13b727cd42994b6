"""Secret scan with a recursive decoding worklist.

A text is the first layer. Each layer is scanned with the base patterns; then every decoder
(URL escapes, Unicode escapes and character references, base64 with optional compression) unwraps
it once as a whole, and a result not seen before joins the worklist. The loop ends at the fixpoint:
layers are known by a digest, so layers that decode to each other end too. Every character of a layer
keeps the code-point interval of the original text it came from, so all spans are in the original.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import map_batches, texts_of

#: Kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
PACKED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs on successive lines, read as one.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t>]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: No base match, and no encoding of one, is shorter; all of them are ASCII.
ASCII_RUN = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
SQUEEZED = re.compile(rb"\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78](?=[\x00-\xff])")
#: What a compressed layer unfolds to beyond this is read in parts, each with the end of the one before:
#: the guard against archive bombs.
MAX_UNFOLDED = 64 << 20
OVERLAP = 1 << 20

Span = tuple[int, int, str]


@dataclass
class Layer:
    """A text and, but for the original, the interval of the original behind each character."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    path: tuple[str, ...] = ()
    part: bool = False  # one of many parts of a large payload

    def interval(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())


def scan(text: str) -> list[Span]:
    """Base matches as (start, end, kind), leftmost and not overlapping within a kind."""
    found: list[Span] = []
    low = text.lower() if any(c in text for c in ":=") else ""
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _utf8(raw: bytes | bytearray) -> str:
    """The text of bytes; what is no UTF-8 becomes a replacement character, the rest stays."""
    return raw.decode("utf-8", "replace")


def _header(raw: bytes | memoryview) -> int:
    """The window bits for gzip or zlib bytes, else 0."""
    if raw[:2] == b"\x1f\x8b":
        return 31
    return 15 if len(raw) > 2 and raw[0] & 0x8F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0 else 0


def _unfold(raw: bytes | memoryview) -> Iterator[tuple[str, int]]:
    """Texts of all members of gzip or zlib bytes, in parts, each with the number of bytes read so far.

    A damaged or cut gzip member gives what it holds before the damage; zlib bytes, whose mark is short,
    must be whole.
    """
    kept, told, at = bytearray(), 0, 0  # of the bytes kept, the first `told` were in the part before
    while kind := _header(raw[at : at + 3]):
        machine, start, good, pending = zlib.decompressobj(kind), at, len(kept), b""
        while not machine.eof and (pending or at < len(raw)):
            data = pending or bytes(raw[at : at + 4096])
            at += 0 if pending else len(data)
            try:
                kept += machine.decompress(data, MAX_UNFOLDED - len(kept))
            except zlib.error:
                break
            pending = machine.unconsumed_tail
            if len(kept) >= MAX_UNFOLDED:
                yield _utf8(kept), at
                del kept[:-OVERLAP]
                told = good = len(kept)
        if not machine.eof:
            if kind == 15:
                del kept[good:]
                at = start
            break
        at -= len(machine.unused_data)
    if len(kept) > told:
        yield _utf8(kept), at


#: The interval of a run, what it decodes to and, where that is compressed, (alignment, byte) of its start.
Piece = tuple[int, int, str, tuple[int, int] | None]


def _whole(value: str | None, run: str) -> list[list[Piece]]:
    return [] if value is None else [[(0, len(run), value, None)]]


def _percent(run: str) -> list[list[Piece]]:
    return _whole(_utf8(bytes.fromhex(run.replace("%", ""))), run)


def _escape(run: str) -> list[list[Piece]]:
    if run.startswith("\\x"):
        return _whole(_utf8(bytes.fromhex(run.replace("\\x", ""))), run)
    if run.startswith("\\u"):
        return _whole(bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "replace"), run)
    number = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    return _whole(chr(number) if 0 < number < 0x110000 and not 0xD800 <= number < 0xE000 else None, run)


_ALPHABET = str.maketrans("-_", "+/", "= \t\r\n>")


def _bytes_at(body: str, shift: int) -> bytes:
    """The bytes of base64 characters from place `shift` on; a last character that is too few is left."""
    body = body[shift:]
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _packed(run: str) -> list[list[Piece]]:
    """Readings of a base64 run: as a whole, and of what lies in it at each of the four alignments.

    Four characters hold three bytes, so a payload behind or before other characters of the alphabet is
    among the bytes of one alignment, whatever adjoins it.
    """
    body = run.translate(_ALPHABET)
    places = [i for i, c in enumerate(run) if c not in "= \t\r\n>"] if len(body) < len(run.rstrip("=")) else range(len(body))
    readings: list[list[Piece]] = []
    whole, part = False, None
    if len(body) % 4 != 1:
        raw = _bytes_at(body, 0)
        part = next(_unfold(raw), None)
        if part is not None:
            readings.append([(0, len(run), part[0], (0, 0))])
        try:
            readings.append([(0, len(run), raw.decode("utf-8"), None)])
            whole = True
        except UnicodeDecodeError:
            whole = part is not None and part[1] == len(raw)
    for shift in range(1 if whole else 0, 4):
        raw = _bytes_at(body, shift)
        found = [(m.start(), m.end(), m[0].decode(), None) for m in ASCII_RUN.finditer(raw)]
        at, view = part[1] if part and not shift else 0, memoryview(raw)
        for m in SQUEEZED.finditer(raw):
            if m.start() >= at and _header(view[m.start() : m.start() + 3]) and (inner := next(_unfold(view[m.start() :]), None)):
                at = m.start() + inner[1]
                found.append((m.start(), at, inner[0], (shift, m.start())))
        pieces, end = [], 0
        for a, b, value, more in sorted(found, key=lambda f: f[:2]):
            if a >= end:
                pieces.append((places[shift + a * 4 // 3], places[min(shift + (b * 4 + 2) // 3, len(body)) - 1] + 1, value, more))
                end = b
        if pieces:
            readings.append(pieces)
    return readings


def _parts(run: str, shift: int, start: int) -> Iterator[str]:
    """What a compressed run unfolds to behind its first MAX_UNFOLDED bytes, part by part."""
    raw = memoryview(_bytes_at(run.translate(_ALPHABET), shift))
    for k, (value, _) in enumerate(_unfold(raw[start:])):
        if k:
            yield value


#: Decoder name, what must occur for it to be tried, pattern of an encoded run, its readings.
DECODERS: tuple[tuple[str, tuple[str, ...], re.Pattern[str], Callable[[str], list[list[Piece]]]], ...] = (
    ("url", ("%",), PERCENT, _percent),
    ("unicode", ("\\u", "\\x", "&#"), ESCAPES, _escape),
    ("base64", (), PACKED, _packed),
    ("base64", ("\n",), WRAPPED, _packed),
)


def _replaced(layer: Layer, pieces: list[Piece], name: str) -> Layer:
    starts = np.arange(len(layer.text)) if layer.starts is None else layer.starts
    ends = np.arange(1, len(layer.text) + 1) if layer.ends is None else layer.ends
    texts, lows, highs, at = [], [], [], 0
    for a, b, value, _ in pieces:
        low, high = layer.interval(a, b)
        texts += [layer.text[at:a], value]
        lows += [starts[at:a], np.full(len(value), low)]
        highs += [ends[at:a], np.full(len(value), high)]
        at = b
    texts.append(layer.text[at:])
    lows.append(starts[at:])
    highs.append(ends[at:])
    return Layer("".join(texts), np.concatenate(lows), np.concatenate(highs), (*layer.path, name))


def unwrap(layer: Layer) -> Iterator[Layer]:
    """Each layer that one decoder makes of `layer`; runs that do not decode stay as they are.

    A run with several readings gives a layer for each of them.
    """
    for name, signs, pattern, decode in DECODERS:
        if signs and not any(s in layer.text for s in signs):
            continue
        layers: list[list[Piece]] = []
        large = []
        for m in pattern.finditer(layer.text):
            for k, reading in enumerate(decode(m[0])):
                if k == len(layers):
                    layers.append([])
                layers[k] += [(m.start() + a, m.start() + b, value, None) for a, b, value, _ in reading]
                large += [(m.start(), a, m.end(), more) for a, _, value, more in reading if more and len(value) >= MAX_UNFOLDED // 4]
        for pieces in layers:
            yield _replaced(layer, pieces, name)
        layers.clear()
        for start, a, end, more in large:
            low, high = layer.interval(start + a, end)
            for value in _parts(layer.text[start:end], *more):
                yield Layer(value, np.full(len(value), low), np.full(len(value), high), (*layer.path, name), part=True)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def find_secrets(text: str) -> tuple[list[Span], dict[Span, tuple[str, ...]]]:
    """Base spans of the text, and all spans (base and decoded) with the decoders that led to them."""
    base = scan(text)
    found: dict[Span, tuple[str, ...]] = {span: () for span in base}
    seen = {_digest(text)} if text else set()

    def explore(first: Layer) -> None:
        work = deque([unwrap(first)])
        while work:
            for layer in work.popleft():
                if (mark := _digest(layer.text)) in seen:
                    continue
                seen.add(mark)
                for a, b, kind in scan(layer.text):
                    found.setdefault((*layer.interval(a, b), kind), layer.path)
                if layer.part:
                    explore(layer)  # to its end, so that one part is held at a time
                else:
                    work.append(unwrap(layer))

    explore(Layer(text))
    return base, found


def _joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in order)


SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, "
    "n_decoded bigint, layers string"
)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Base and decoded spans of every text; one row per row of `docs`.

    Spans are `kind:start:end` in code points of the original, end exclusive, ordered by start, then
    kind. A decoded span covers the whole encoded run behind its characters. `layers` names the
    decoder chains that gave spans. A null or empty text has none. Rows are independent.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(7)]
        for value in batch.column("text"):
            base, found = find_secrets(value.as_py())
            counts = [sum(1 for s in base if s[2] == kind) for kind in KINDS]
            chains = sorted({"+".join(path) for path in found.values() if path})
            row = (*counts, _joined(base), _joined(list(found)), len(found) - len(set(base)), ",".join(chains))
            for column, cell in zip(rows, row, strict=True):
                column.append(cell)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
        arrays = [batch.column("doc_id")] + [pa.array(r, kind) for r, kind in zip(rows, kinds, strict=True)]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_decoded", "layers"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return map_batches(texts_of(docs), work, SCHEMA)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, base or decoded, replaced by `mark`; overlapping spans become one."""
    _, found = find_secrets(text)
    if not found:
        return text
    pieces, at, end = [], 0, -1
    for a, b, _ in sorted(found):
        if a >= end and a >= at:
            pieces += [text[at:a], mark]
        end = max(end, b)
        at = max(at, b)
    pieces.append(text[at:])
    return "".join(pieces)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with secrets replaced in `text` and `n_chars` counted anew; all columns and rows stay.

    A null text stays null.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = [None if (t := v.as_py()) is None else redacted(t, mark) for v in batch.column("text")]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = map_batches(docs, work, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
