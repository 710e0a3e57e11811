"""SentencePiece encoding that keeps byte offsets, and decoding.

A text is normalised piece of text by piece of text: at each place the longest
prefix that the model's compiled character map knows (a double-array trie with
its replacements) is replaced, any other character stands for itself. Every
normalised character records the byte of the source that it came from. The
byte-pair merges run over the normalised text, and each piece is projected
through that alignment to the span of source bytes that it covers.

Merges never cross a pair of characters that no piece of the vocabulary holds
side by side, so texts are cut there (above all before a word's space mark) and each
distinct stretch is merged once: the same pieces as over the whole text, in
linear time on prose. Stretches without such a cut use a heap.

The model file is read once on the driver and travels with the functions; its
size does not grow with the data. Texts are encoded whole.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import cached_property
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The space mark of the pieces.
MARK = "▁"
#: Fixed values of the model format: kinds of pieces and the kind of model that is read here.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
#: Stretches up to so many characters are remembered, so many at a time.
_SHORT = 64
_REMEMBERED = 200_000
#: Bytes of texts or ids that are worked on together (a longer one alone).
_BATCH = 1 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at:at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled character map (empty: none)."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.replacements = b""
        if blob:
            size, = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.replacements = blob[4 + size:]
        self._plain: set[str] = set()

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and byte length of the longest known prefix of ``text`` from ``at``."""
        node = self._below(0, self.units[0])
        found = None
        for k in range(at, len(text)):
            node ^= text[k]
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node = self._below(node, unit)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        begin, size = found
        return self.replacements[begin:self.replacements.index(b"\0", begin)], size

    @staticmethod
    def _below(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 1 << 9) >> 6))

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """(replacement or character itself, bytes of the source it stands for), in order."""
        raw = text.encode()
        at = 0
        skip = 0
        for char in text:
            size = len(char.encode())
            if skip:
                skip -= size
                continue
            if char not in self._plain:
                hit = self.longest(raw, at)
                if hit:
                    yield hit[0].decode(), hit[1]
                    at += hit[1]
                    skip = hit[1] - size
                    continue
                if not self._starts(char):
                    self._plain.add(char)
            yield char, size
            at += size

    def _starts(self, char: str) -> bool:
        """Whether some key goes through all bytes of ``char``."""
        node = self._below(0, self.units[0])
        for byte in char.encode():
            node ^= byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                return False
            node = self._below(node, unit)
        return True


class Model:
    """A byte-pair model with byte fallback, read from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces, trainer, normalizer = [], {}, {}
        for key, value in _fields(raw):
            if key == 1:
                one = dict(_fields(value))
                pieces.append((one.get(1, b"").decode(), struct.unpack("<f", one.get(2, bytes(4)))[0], one.get(3, NORMAL)))
            elif key == 2:
                trainer = dict(_fields(value))
            elif key == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0):
            raise ValueError("only byte-pair models with byte fallback are read")
        if {kind for *_, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not read")
        self.pieces = pieces
        self.bos, self.eos, self.unknown = trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0)
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.suffix = bool(trainer.get(24, 0))
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.costs = {p: -s for p, s, kind in pieces if kind == NORMAL}
        self.byte_ids = [0] * 256
        self.id_bytes = np.full(len(pieces), -1, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
                self.id_bytes[i] = int(p[1:-1], 16)
        self.lengths = np.array([len(p) if kind == NORMAL else 1 for p, _, kind in pieces], np.int64)
        #: Pairs of characters that some piece holds side by side; merges happen only there.
        self.pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        # a word's mark never follows another character inside a piece: words are apart
        apart = not any(b == MARK and a != MARK for a, b in self.pairs)
        self.stretch = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else r"[\s\S]+")
        self._known: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("merges", "surfaces")} | {"_known": {}}

    # normalisation

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and per character (and its end) the byte of ``text`` where its source begins."""
        if not text:
            return "", np.zeros(1, np.int64)
        mark = MARK if self.escape else " "
        if not self.map.units and not self.squeeze:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            starts = np.concatenate([[0], np.cumsum(widths)])
            out = text.replace(" ", mark)
            if self.dummy:
                out, starts = (out + mark, np.append(starts, starts[-1])) if self.suffix else (
                    mark + out, np.concatenate([[0], starts]))
            return out, starts
        return self._normalize_parts(text, mark)

    def _normalize_parts(self, text: str, mark: str) -> tuple[str, np.ndarray]:
        parts = self.map.parts(text) if self.map.units else ((c, len(c.encode())) for c in text)
        chars: list[str] = []
        starts: list[int] = []
        at = 0
        after_space = self.squeeze
        head = True
        for out, size in parts:
            if head:
                if self.squeeze and out == " ":
                    at += size
                    continue
                head = False
                if self.dummy and not self.suffix:
                    chars.append(mark)
                    starts.append(at)
            if after_space:
                out = out.lstrip(" ")
            for c in out:
                chars.append(mark if c == " " else c)
                starts.append(at)
            if out:
                after_space = out.endswith(" ")
            at += size
            after_space = after_space and self.squeeze
        if head:
            return "", np.full(1, 0, np.int64)
        while self.squeeze and chars and chars[-1] == mark:
            chars.pop()
            at = starts.pop()
        if self.dummy and self.suffix:
            chars.append(mark)
            starts.append(at)
        return "".join(chars), np.array([*starts, at], np.int64)

    # pieces

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) and their source spans in bytes (int32, a row per id); no begin or end ids.

        A character that no piece holds becomes its bytes: the last of these ids spans it, the ones
        before are empty spans at its start.
        """
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`encode` of each text; stretches that are new to all of them are merged together."""
        plain = [self.normalize(t) for t in texts]
        parts = [self.stretch.findall(p) for p, _ in plain]
        known = self._known
        new = set().union(*parts).difference(known)
        if len(known) + len(new) > _REMEMBERED:
            known.clear()
            new = set().union(*parts)
        known.update(self._merge_all([p for p in new if len(p) <= _SHORT]))
        long = {p: self.merged(p) for p in new if len(p) > _SHORT}
        known.update(long)
        for (_, starts), found in zip(plain, parts):
            ids = np.frombuffer(b"".join(map(known.__getitem__, found)), "<u4")
            yield ids, self._spans(ids, starts)
        for p in long:
            del known[p]

    def _spans(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        width = self.lengths[ids]
        byte = self.id_bytes[ids]
        goes_on = np.zeros(len(ids), bool)
        goes_on[:-1] = (byte[:-1] >= 0) & (byte[1:] & 0xC0 == 0x80) & (byte[1:] >= 0)
        width[goes_on] = 0
        end = np.cumsum(width)
        return np.stack([starts[end - width], starts[end]], 1).astype(np.int32)

    @cached_property
    def merges(self) -> tuple[np.ndarray, ...]:
        """Id of every character that is a piece; and, sorted, the pairs of pieces that make a piece, with its id and cost."""
        chars = np.full(0x110000, -1, np.int64)
        found = {}
        for piece, i in self.ids.items():
            if len(piece) == 1:
                chars[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    found[left * len(self.pieces) + right] = i
        keys = np.array(sorted(found), np.int64)
        made = np.array([found[k] for k in keys.tolist()], np.int64)
        cost = np.array([-score for _, score, _ in self.pieces])
        # one more entry, which no pair equals
        return chars, np.append(keys, -1), np.append(made, 0), np.append(cost[made], inf)

    def _pairs_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What merging each pair makes, and its cost (infinite: no piece)."""
        _, keys, made, cost = self.merges
        key = left * len(self.pieces) + right
        at = np.searchsorted(keys[:-1], key)
        hit = (keys[at] == key) & (left >= 0) & (right >= 0)
        return made[at], np.where(hit, cost[at], inf)

    def _merge_all(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Packed ids of short stretches: in all of one length at once, merge each one's best pair (the
        leftmost of equals) until none has any left."""
        by_length: dict[int, list[str]] = {}
        for p in parts:
            by_length.setdefault(len(p), []).append(p)
        for n, words in by_length.items():
            points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, n)
            symbols = self.merges[0][points]
            # a character that is no piece is kept as a negative number
            symbols = np.where(symbols < 0, -1 - points, symbols)
            made, cost = self._pairs_of(symbols[:, :-1], symbols[:, 1:])
            rows = np.arange(len(words))
            while len(rows):
                width = symbols.shape[1]
                if width > 1:
                    best = cost.argmin(1)
                    more = cost[np.arange(len(rows)), best] < inf
                else:
                    more = np.zeros(len(rows), bool)
                done, ids = rows[~more].tolist(), symbols[~more]
                raw = ids.astype("<u4").tobytes()
                for i, r in enumerate(done):
                    yield words[r], raw[4 * width * i:4 * width * (i + 1)]
                for i in np.flatnonzero((ids < 0).any(1)).tolist():
                    yield words[done[i]], self._packed(ids[i])
                rows, symbols = rows[more], symbols[more]
                if not len(rows):
                    break
                made, cost, best = made[more], cost[more], best[more]
                every = np.arange(len(rows))
                symbols[every, best] = made[every, best]
                left = np.ones(symbols.shape, bool)
                left[every, best + 1] = False
                symbols = symbols[left].reshape(len(rows), width - 1)
                left = np.ones(cost.shape, bool)
                left[every, best] = False
                made, cost = made[left].reshape(len(rows), width - 2), cost[left].reshape(len(rows), width - 2)
                for side in (0, 1):
                    # the pair that ends with the new piece, and the one that begins with it
                    at = best - 1 + side
                    has = (at >= 0) & (at < width - 2)
                    at, row = at[has], every[has]
                    made[row, at], cost[row, at] = self._pairs_of(symbols[row, at], symbols[row, at + 1])

    def _packed(self, symbols: np.ndarray) -> bytes:
        """Ids as packed integers; a character that is no piece (-1 - its code point) by its bytes."""
        out: list[int] = []
        for s in symbols.tolist():
            out += [s] if s >= 0 else [self.byte_ids[b] for b in chr(-1 - s).encode()]
        return np.array(out, "<u4").tobytes()

    def merged(self, part: str) -> bytes:
        """Packed ids of a long stretch: cut where no piece goes on, then merged."""
        cuts = [0, *(i for i in range(1, len(part)) if part[i - 1:i + 1] not in self.pairs), len(part)]
        pieces = [part[a:b] for a, b in zip(cuts, cuts[1:])]
        short = dict(self._merge_all(list({p for p in pieces if len(p) <= _SHORT})))
        return b"".join(short[p] if len(p) <= _SHORT else self._merge_many(p) for p in pieces)

    def _merge_many(self, part: str) -> bytes:
        """The same by a heap, for long stretches."""
        symbols: list[str | None] = list(part)
        left = list(range(-1, len(part) - 1))
        right = list(range(1, len(part) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, k: int) -> None:
            if i >= 0 and k < len(symbols):
                both = symbols[i] + symbols[k]
                cost = self.costs.get(both)
                if cost is not None:
                    heap.append((cost, i, k, both))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        while heap:
            _, i, k, both = heapq.heappop(heap)
            # stale if either side has been merged since
            if symbols[i] is None or symbols[k] is None or right[i] != k or symbols[i] + symbols[k] != both:
                continue
            symbols[i], symbols[k] = both, None
            right[i] = right[k]
            if right[k] < len(symbols):
                left[right[k]] = i
            held = len(heap)
            offer(left[i], i)
            offer(i, right[i])
            fresh = heap[held:]
            del heap[held:]
            for entry in fresh:
                heapq.heappush(heap, entry)
        return self._packed(np.array([self.ids.get(s, -1 - ord(s[0])) for s in symbols if s is not None], np.int64))

    # decoding

    @cached_property
    def surfaces(self) -> list[str | None]:
        """Text of every id but bytes beyond ASCII (None)."""
        shown = {NORMAL: lambda p: p.replace(MARK, " "), UNKNOWN: lambda p: self.unknown_surface, CONTROL: lambda p: "",
                 BYTE: lambda p: chr(int(p[1:-1], 16)) if int(p[1:-1], 16) < 0x80 else None}
        return [shown[kind](p) for p, _, kind in self.pieces]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids are silent, runs of byte ids are UTF-8 (a byte that is none: U+FFFD)."""
        at = 0
        out: list[str] = []
        # the mark in front, which encoding added
        while self.dummy or self.squeeze:
            while at < len(ids) and self.pieces[ids[at]][2] == CONTROL:
                at += 1
            if at == len(ids) or self.pieces[ids[at]][2] != NORMAL:
                break
            piece = self.pieces[ids[at]][0]
            out.append(piece.removeprefix(MARK).replace(MARK, " "))
            at += 1
            if out[-1] or (piece.startswith(MARK) and not self.squeeze):
                break
        ids = ids[at:]
        surface = self.surfaces.__getitem__
        # runs of bytes beyond ASCII, which make characters together
        wide = np.flatnonzero(self.id_bytes[ids] >= 0x80)
        at = 0
        for run in np.split(wide, np.flatnonzero(np.diff(wide) > 1) + 1) if len(wide) else ():
            out += map(surface, ids[at:run[0]].tolist())
            out.append(_text_of(self.id_bytes[ids[run]].astype(np.uint8).tobytes()))
            at = int(run[-1]) + 1
        out += map(surface, ids[at:].tolist())
        return "".join(out)


def _text_of(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def _rows(names: list[str], schema: pa.Schema, kept: int, produce) -> object:
    """A function over batches: the first ``kept`` columns as they are, and what ``produce`` makes of the next one,
    for about so many of its bytes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(kept)
            sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy().astype(np.int64)
            filled = np.cumsum(sizes) // _BATCH
            cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    found = produce(values.slice(a, b - a).to_pylist())
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), schema.types)]
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(kept)] + columns, names)

    return run


def encode(docs: DataFrame, model: Model, keep: list[str], text: str = "text", ends: bool = True,
           arrays: bool = False) -> DataFrame:
    """Ids and source spans of every text.

    Returns the columns ``keep`` of ``docs`` and, replacing columns of these names, ``ids`` (little-endian unsigned
    32-bit integers) and ``spans`` (begin and end byte in the source per id, signed 32-bit), packed or as arrays
    (of int; begin and end in turn). With ``ends``, a begin id (an empty span at 0) and an end id (an empty span at
    the text's end) are added. A null text is empty, and an empty one has those two ids only. No rows give no rows.
    """
    keep = [c for c in keep if c not in ("ids", "spans")]

    def all_of(values: list[str | None]) -> Iterator[tuple]:
        texts = [v or "" for v in values]
        for text, (ids, spans) in zip(texts, model.encode_many(texts)):
            if ends:
                size = len(text.encode())
                ids = np.concatenate([[model.bos], ids, [model.eos]])
                spans = np.concatenate([[[0, 0]], spans, [[size, size]]])
            ids, spans = ids.astype("<u4"), spans.astype("<i4")
            yield (ids.astype(np.int32), spans.ravel()) if arrays else (ids.tobytes(), spans.tobytes())

    rows = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string"))
    kind, arrow = ("array<int>", pa.list_(pa.int32())) if arrays else ("binary", pa.binary())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keep)]]
                       + [f"ids {kind}", f"spans {kind}"])
    return rows.mapInArrow(_rows([*keep, "ids", "spans"], pa.schema([("ids", arrow), ("spans", arrow)]), len(keep), all_of),
                           schema)


def decode(rows: DataFrame, model: Model, keep: list[str], ids: str = "ids") -> DataFrame:
    """Texts of packed ids: the columns ``keep`` and ``decoded`` (null ids: an empty text)."""
    keep = [c for c in keep if c != "decoded"]

    def all_of(values: list[bytes | None]) -> Iterator[tuple[str]]:
        for value in values:
            yield (model.decode(np.frombuffer(value or b"", "<u4")),)

    chosen = rows.select(*[F.col(c) for c in keep], F.col(ids))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:len(keep)]]
                       + ["decoded string"])
    return chosen.mapInArrow(_rows([*keep, "decoded"], pa.schema([("decoded", pa.string())]), len(keep), all_of), schema)

