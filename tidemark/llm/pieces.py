"""SentencePiece encoding with byte spans, and decoding.

The library's model file names a normaliser: a compiled character map (a double-array trie of UTF-8 prefixes and
their replacements), dummy prefix and white space rules. ``Normalizer`` applies it by longest prefix and keeps, for
every normalised byte, the original byte it came from; a piece's span is that of its normalised bytes, projected back.
Segmentation is the library's own, so ids are exactly the library's. Models have byte fallback: without it a piece for
unknown characters doesn't tell how long they were.

Null texts count as empty and give the begin and end ids. Texts of any length are encoded whole, in one worker; shorter
ones a slice at a time. Repeated rows stay repeated. Extra columns are not read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import release_memory

MARK = "▁"
#: UTF-8 bytes of text encoded at a time within a batch (one text may be longer), so that memory stays bounded.
SLICE_BYTES = 1 << 20


class Normalizer:
    """Longest-prefix normalisation through a compiled character map, with source alignment."""

    def __init__(self, charsmap: bytes = b"", add_dummy_prefix: bool = True, remove_extra_whitespaces: bool = False, escape_whitespaces: bool = True):
        self.dummy, self.squeeze = add_dummy_prefix, remove_extra_whitespaces
        self.blank = MARK.encode() if escape_whitespaces else b" "
        self.units: tuple[int, ...] = ()
        self.replacements, self.first = b"", None
        if charsmap:
            size = struct.unpack_from("<I", charsmap)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.replacements = charsmap[4 + size :]
            starts = [bytes([b]) for b in range(1, 256) if self._steps(self._child(0), b)]
            self.first = re.compile(b"[" + b"".join(map(re.escape, starts)) + b"]") if starts else None

    def _child(self, node: int) -> int:
        """Where the children of a node are, before their byte is mixed in."""
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)

    def _steps(self, base: int, byte: int) -> bool:
        return base ^ byte < len(self.units) and self.units[base ^ byte] & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes, value) of the longest prefix of ``data`` from ``at`` that the trie holds; (0, -1) if none."""
        best, value, base = 0, -1, self._child(0)
        for k in range(at, len(data)):
            if not self._steps(base, data[k]):
                break
            node = base ^ data[k]
            base = self._child(node)
            if self.units[node] & 0x100:
                best, value = k + 1 - at, self.units[base] & 0x7FFFFFFF
        return best, value

    def replaced(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, length, replacement) of the longest prefixes that the map holds, from the front; the rest stays as it is."""
        at = 0
        while self.first and (m := self.first.search(data, at)):
            at = m.start()
            n, value = self.longest(data, at)
            if n:
                yield at, n, self.replacements[value : self.replacements.index(b"\0", value)]
            lead = data[at]
            at += n or (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each and for their end, the original byte offset."""
        plain, parts, places, done = np.frombuffer(data, np.uint8), [], [], 0
        for at, n, out in self.replaced(data):
            parts += [plain[done:at], np.frombuffer(out, np.uint8)]
            places += [np.arange(done, at), at + np.arange(n) if len(out) == n else np.full(len(out), at)]
            done = at + n
        values = np.concatenate([*parts, plain[done:]]) if parts else plain
        source = np.concatenate([*places, np.arange(done, len(data))]) if places else np.arange(len(data))
        blank, end = values == 0x20, len(data)
        if self.squeeze:  # blanks at the front go, of others the first of a run stays, but for the last run
            keep = np.flatnonzero(~(blank & np.concatenate([[True], blank[:-1]])))
            if len(keep) and blank[keep[-1]]:
                end, keep = int(source[keep[-1]]), keep[:-1]
            values, source, blank = values[keep], source[keep], blank[keep]
        if not len(values):
            return b"", np.zeros(1, np.int64)
        wide = np.where(blank, len(self.blank), 1)
        places = np.flatnonzero(blank)
        places = places + (len(self.blank) - 1) * np.arange(len(places))  # where each blank's mark begins
        out = np.repeat(values, wide)
        for k, byte in enumerate(self.blank):
            out[places + k] = byte
        mark = self.blank if self.dummy else b""
        return mark + out.tobytes(), np.concatenate([np.full(len(mark), source[0]), np.repeat(source, wide), [end]])


class Codec:
    """Encodes texts to ids and spans, and decodes ids; one to a worker and model."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        # Normalised bytes of each piece: a byte piece is one byte, whatever its name.
        self.widths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with begin and end."""
        return [x.astype("<u4") for x in self.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1, return_type="numpy")]

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Original byte offsets at which pieces begin, and where the last one ends; begin and end ids have empty spans."""
        widths = self.widths[ids]
        widths[0] = widths[-1] = 0
        normal, source = self.normalize(text.encode())
        return source[np.concatenate([[0], np.minimum(np.cumsum(widths), len(normal))])]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.sp.decode([x.astype(np.int32) for x in ids], num_threads=1)


@cache
def codec(model: str | Callable[[], str]) -> Codec:
    """The codec of a model file; a function is asked for its path here, where the file is opened."""
    return Codec(model() if callable(model) else model)


def _slices(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of at most SLICE_BYTES of text, with their texts; only one part is held as Python strings."""
    ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), np.int64))
    start = 0
    while start < len(ends):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [t or "" for t in part.column(text_col).to_pylist()]
        start = stop


def encode_documents(docs: DataFrame, model: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, n_tokens, ids, starts) for every row: packed little-endian unsigned 32-bit integers.

    ``starts`` has one entry more than ``ids``: piece k is bytes starts[k] to starts[k + 1] of the text's UTF-8. ``model``
    is a path, or a function that gives it: workers call it, so the file may lie elsewhere on each machine. ``decode``
    adds ``decoded``, the ids decoded by the library in the same worker, so that a task needs one worker and not two.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["__id", "n_tokens", "ids", "starts"] + ["decoded"] * decode

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch, "__text"):
                ids = codec(model).ids(texts)
                starts = [codec(model).spans(t, x).astype("<u4").tobytes() for t, x in zip(texts, ids, strict=True)]
                columns = [part.column("__id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(starts, pa.binary())]
                if decode:
                    columns.append(pa.array(codec(model).decode(ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    read = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    return read.mapInArrow(run, f"__id {kind}, n_tokens bigint, ids binary, starts binary" + ", decoded string" * decode).withColumnRenamed("__id", id_col)


def decode_documents(encoded: DataFrame, model: str | Callable[[], str], id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, text) from packed ids, by the library's decode."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                some = [np.frombuffer(x, "<u4") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("n_tokens"), part.column("ids"), pa.array(codec(model).decode(some), pa.string())], ["__id", "n_tokens", "ids", "text"])
        release_memory()

    read = encoded.select(encoded[id_col].alias("__id"), "n_tokens", "ids")
    return read.mapInArrow(run, f"__id {kind}, n_tokens bigint, ids binary, text string").withColumnRenamed("__id", id_col)
