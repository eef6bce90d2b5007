"""SentencePiece BPE encoding that knows where in the original text each piece came from, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map has, and for every byte of the
normalised text the byte of the original that it came from is kept.  Pieces are merged in the normalised text, and the
recorded alignment projects each of them back to a span of original bytes.

Texts are worked off where they lie, in slices of bounded size, without a shuffle: no merge crosses a place where a
piece can only begin, so words are merged by themselves, each distinct one of a slice once.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices, text_bytes

SPACE = "▁"  # U+2581 stands for a space in pieces
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words of more characters are merged one by one; bytes of text worked off at once.
LONGEST, SLICE = 64, 1 << 20
#: The value of two neighbours that make no piece.
NONE = float("-inf")


class CharMap:
    """A compiled character map: a double-array trie of byte strings over their replacements.

    The file format: the trie's size in bytes, its 32-bit units, then the replacements, each ended by a zero byte.
    A unit holds a label, an offset to its children and whether a value hangs below it.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]
        self.plain: dict[str, bool] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``data`` has at ``at``."""
        units, node, found = self.units, 0, None
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(0, start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def begins(self, char: str) -> bool:
        """Whether a key begins with the first byte of ``char`` and goes on with it."""
        known = self.plain.get(char)
        if known is None:
            node, known = self._offset(self.units[0]), True
            for byte in char.encode():
                node ^= byte
                if self.units[node] & 0x800000FF != byte:
                    known = False
                    break
                if self.units[node] >> 8 & 1:
                    break
                node ^= self._offset(self.units[node])
            self.plain[char] = known
        return known


@dataclass
class Model:
    """What encoding and decoding need of a model file; its size is the vocabulary's."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    char_map: bytes
    dummy_prefix: bool
    collapse: bool  # spaces at the ends go, others are one each
    escape: bool
    byte_fallback: bool
    unknown_surface: str
    of: dict[str, int] = field(init=False)
    value: dict[str, float] = field(init=False)
    sizes: list[int] = field(init=False)
    unknown: int = field(init=False)
    end: int = field(init=False)
    bytes_: list[int] = field(init=False)

    def __post_init__(self) -> None:
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces are not read")
        self.of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.value = {p: self.scores[i] for p, i in self.of.items()}
        self.sizes = [len(p.encode()) for p in self.pieces]
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>") if "</s>" in self.pieces else self.unknown
        self.bytes_ = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if self.byte_fallback else []

    @property
    def words_apart(self) -> bool:
        """Whether no piece has a space after another character, so that merges never cross the beginning of a word."""
        return not any(SPACE in p.lstrip(SPACE) for p in self.of)


def read_model(path: str) -> Model:
    """The model file of a BPE vocabulary."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec, trainer = proto.normalizer_spec, proto.trainer_spec
    if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with spaces before words are read")
    return Model(
        [p.piece for p in proto.pieces], [p.type for p in proto.pieces], [p.score for p in proto.pieces], spec.precompiled_charsmap,
        spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, trainer.byte_fallback, trainer.unk_surface,
    )


class Normaliser:
    """Texts as the model sees them, with the original byte of each of their bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.map = CharMap(model.char_map) if model.char_map else None
        self.space = np.frombuffer((SPACE if model.escape else " ").encode(), np.uint8)

    def mapped(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes after the character map, and where in ``data`` each came from."""
        if self.map is None:
            return data, np.arange(len(data))
        whole = data.tobytes()
        touched = [c for c in set(whole.decode()) if self.map.begins(c)]
        if not touched:
            return data, np.arange(len(data))
        # places where a key may begin; what lies between them stays as it is
        places = re.compile(b"|".join(re.escape(c.encode()) for c in sorted(touched)))
        parts, sources, at = [], [], 0
        while (hit := places.search(whole, at)) is not None:
            parts.append(data[at : hit.start()])
            sources.append(np.arange(at, hit.start()))
            found = self.map.longest(whole, hit.start())
            size, new = found if found is not None else (hit.end() - hit.start(), hit.group())
            parts.append(np.frombuffer(new, np.uint8))
            # an unchanged character keeps its bytes' places, a replaced key stands at its first byte
            sources.append(np.arange(hit.start(), hit.end()) if found is None else np.full(len(new), hit.start()))
            at = hit.start() + size
        parts.append(data[at:])
        sources.append(np.arange(at, len(data)))
        return np.concatenate(parts), np.concatenate(sources)

    def __call__(self, data: np.ndarray) -> tuple[str, np.ndarray]:
        """The normalised text, and the original byte of each of its bytes and of its end."""
        size = len(data)
        data, source = self.mapped(data)
        blank = data == 32
        if self.model.collapse:
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            if len(keep) and blank[0]:
                keep[0] = False
            data, source, blank = data[keep], source[keep], blank[keep]
        if not len(data):
            return "", np.array([0])
        widths = np.where(blank, len(self.space), 1)
        out, source = np.repeat(data, widths), np.repeat(source, widths)
        if len(self.space) > 1:
            at = (np.cumsum(widths) - widths)[blank]
            for i, byte in enumerate(self.space):
                out[at + i] = byte
        text = out.tobytes()
        if self.model.collapse:
            # what looks like a space goes from the end
            text = re.sub(b"(?:" + re.escape(self.space.tobytes()) + b")+\\Z", b"", text)
            size = int(source[len(text)]) if len(text) < len(source) else size
            source = source[: len(text)]
        if self.model.dummy_prefix and text:
            text = self.space.tobytes() + text
            source = np.concatenate([np.full(len(self.space), source[0]), source])
        return text.decode(), np.append(source, size)


def merged(word: str, model: Model) -> list[str]:
    """The pieces of one word: of all neighbours that make a piece together the best is merged, leftmost first, until none is left.

    A heap of pairs over a linked list, for words of any length.
    """
    value, parts = model.value.get, list(word)
    before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (best := value(p := parts[i] + parts[after[i]], NONE)) > NONE:
            heapq.heappush(heap, (-best, i, p))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j < 0 or parts[i] + parts[j] != both:
            continue  # one of the two has been merged since
        parts[i], parts[j] = both, ""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p]


class Merger:
    """Merges many words at once, as arrays of symbols: a symbol is a piece's id or, beyond these, a character of no piece."""

    NOTHING = 1 << 30  # the rank of two neighbours that make no piece

    def __init__(self, model: Model):
        self.model, self.v = model, len(model.pieces)
        self.symbol = np.arange(self.v, self.v + 0x110000, dtype=np.int64)
        for p, i in model.of.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        name = lambda x: model.of[x] if x in model.of else self.v + ord(x)
        split = lambda p: [(p[:k], p[k:]) for k in range(1, len(p))]
        whole = lambda x: len(x) == 1 or x in model.of
        pairs = sorted((name(a) << 21 | name(b), i) for p, i in model.of.items() for a, b in split(p) if whole(a) and whole(b))
        order = {s: r for r, s in enumerate(sorted(set(model.value.values()), reverse=True))}
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.made = np.array([i for _, i in pairs] or [0], np.int64)
        self.rank = np.array([order[model.scores[i]] for _, i in pairs] or [0], np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's piece (the smaller the better), and the piece."""
        key = left << 21 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.NOTHING), self.made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words one after another, and where each word's begin."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), size)
        rank, made = np.full(len(symbol), self.NOTHING), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = self.look(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            # rank before place, so that the leftmost of equal ones is the least
            best = np.minimum.reduceat(rank << 32 | np.arange(len(symbol)), first)
            open_ = (best >> 32) < self.NOTHING
            stays = np.repeat(open_, np.diff(np.append(first, len(symbol))))
            if not open_.all():
                done.append((word[~stays], symbol[~stays]))
            at = best[open_] & 0xFFFFFFFF
            symbol[at] = made[at]
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            at = place[at]
            symbol, word, rank, made = symbol[stays], word[stays], rank[stays], made[stays]
            for i in (at, at[at > 0] - 1):
                here = np.zeros(len(i), bool)
                here[i + 1 < len(symbol)] = True
                here[here] = word[i[here]] == word[i[here] + 1]
                rank[i[~here]] = self.NOTHING
                i = i[here]
                rank[i], made[i] = self.look(symbol[i], symbol[i + 1])
        word, symbol = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        return symbol[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words' pieces, the bytes that each stands for, and where each word's begin; a byte piece stands for one byte."""
        short = [w if len(w) <= LONGEST else "" for w in words]
        symbol, first = self.merge(short)
        long = [i for i, w in enumerate(words) if len(w) > LONGEST]
        if long:
            found = [[self.model.of.get(p, self.v + ord(p[0])) for p in merged(words[i], self.model)] for i in long]
            symbol = np.insert(symbol, np.repeat(first[long], [len(x) for x in found]), np.concatenate(found))
            extra = np.zeros(len(words), np.int64)
            extra[long] = [len(x) for x in found]
            first = first + np.concatenate([[0], np.cumsum(extra)])
        kinds, of = np.unique(symbol, return_inverse=True)
        spelled = [self.spell(int(k)) for k in kinds]
        count = np.array([len(x) for x, _ in spelled], np.int64)
        start, n = np.cumsum(count) - count, count[of]
        pick = np.repeat(start[of] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        ids, sizes = (np.array([x for pair in spelled for x in pair[side]], np.int64)[pick] for side in (0, 1))
        return ids, sizes, np.concatenate([[0], np.cumsum(n)])[first]

    def spell(self, symbol: int) -> tuple[list[int], list[int]]:
        """Ids of a symbol and the bytes that each stands for."""
        if symbol < self.v:
            return [symbol], [self.model.sizes[symbol]]
        data = chr(symbol - self.v).encode()
        return ([self.model.bytes_[b] for b in data], [1] * len(data)) if self.model.byte_fallback else ([self.model.unknown], [len(data)])


class Encoder:
    """Encodes slices of texts; each distinct word of a slice is merged once."""

    def __init__(self, model: Model):
        self.model, self.normalise, self.merger = model, Normaliser(model), Merger(model)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if model.words_apart else lambda text: [text] if text else []

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts ``buf[off[i]:off[i + 1]]``: ids, begins and ends of their pieces, and where each text's begin."""
        words, n_words, sources = [], [0], []
        for i in range(len(off) - 1):
            text, source = self.normalise(buf[off[i] : off[i + 1]])
            words += self.cut(text)
            n_words.append(len(words))
            sources.append(source)
        distinct = list(dict.fromkeys(words))
        ids, sizes, first = self.merger.ids(distinct)
        at = np.fromiter(map(dict(zip(distinct, range(len(distinct)))).__getitem__, words), np.int64, len(words))
        count = first[at + 1] - first[at]
        pick = np.repeat(first[at] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        ptr = np.concatenate([[0], np.cumsum(count)])[n_words]
        text = np.repeat(np.arange(len(sources)), np.diff(ptr))
        # sizes of pieces add up to the normalised texts; each text's sources have one more, for its end
        size = sizes[pick]
        stop = np.cumsum(size) + text
        source = np.concatenate(sources) if sources else np.zeros(0, np.int64)
        edges = np.array([x[-1] for x in sources], np.int32)
        out = []
        for piece, last in ((ids[pick], self.model.end), (source[stop - size], edges), (source[stop], edges)):
            column = np.empty(len(pick) + len(sources), np.int32)
            column[np.arange(len(pick)) + text] = piece
            column[ptr[1:] + np.arange(len(sources))] = last
            out.append(column)
        return *out, (ptr + np.arange(len(ptr))).astype(np.int32)


def encode_pieces(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """``docs`` without their text, with ``n_tokens``, ``ids``, ``begins`` and ``ends``; own columns of these names are replaced.

    ``ids`` end with the end id.  Piece i stands for the bytes from ``begins[i]`` to ``ends[i]`` of the UTF-8 text; the end id and
    what normalisation has put in stand for none.  Of a character that was replaced by several, the first piece begins
    at it and later ones stand where the next begins.

    A null text is an empty one and has the end id alone.  Rows are encoded one by one, so repeated ids or texts are no case
    of their own; an empty table gives an empty result.  A text has less than 2 GB; a word longer than 64 characters is merged
    with a heap, in a time that hardly grows faster than the word.
    """
    made = T.StructType.fromDDL("n_tokens long, ids array<int>, begins array<int>, ends array<int>")
    kept = [c for c in docs.columns if c not in made.names and c != text_column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in slices(batches, text_column, SLICE):
            buf, off = text_bytes(batch.column(batch.schema.get_field_index(text_column)))
            ids, begins, ends, ptr = encoder.encode(buf, off)
            lists = [pa.ListArray.from_arrays(pa.array(ptr), pa.array(x)) for x in (ids, begins, ends)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(ptr).astype(np.int64)), *lists], [*kept, *made.names])

    schema = T.StructType([*(docs.schema[c] for c in kept), *made.fields])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_column}`")).mapInArrow(run, schema)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("kinspan-each-byte", _each_byte)


class Decoder:
    """Texts of ids: one table of bytes by id, gathered."""

    def __init__(self, model: Model):
        surface = {NORMAL: lambda i: model.pieces[i].replace(SPACE, " ").encode(), BYTE: lambda i: bytes([int(model.pieces[i][3:5], 16)]), UNKNOWN: lambda i: model.unknown_surface.encode()}
        table = [surface.get(k, lambda i: b"")(i) for i, k in enumerate(model.kinds)]
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.first = np.cumsum([0, *map(len, table)])
        self.control = np.array([k == CONTROL for k in model.kinds])
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(model.pieces, model.kinds)])
        self.strip = model.dummy_prefix or model.collapse
        self.byte = np.array([k == BYTE for k in model.kinds])

    def decode(self, ids: np.ndarray) -> str:
        size = self.first[ids + 1] - self.first[ids]
        data = self.data[np.repeat(self.first[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].tobytes()
        spoken = np.flatnonzero(~self.control[ids])
        if len(spoken) and self.strip and self.spaced[ids[spoken[0]]]:
            data = data[1:]  # the space before the first word was put in
        return data.decode("utf-8", "kinspan-each-byte") if self.byte[ids].any() else data.decode()


def decode_pieces(encoded: DataFrame, model: Model, *, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with the text ``decoded`` of its ids; null ids give null, no ids an empty text.

    Control ids say nothing, and the space before the first word is dropped.  Each byte of byte pieces that is no part of a
    character becomes U+FFFD; ids out of the vocabulary are an error.
    """
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            lists = batch.column(batch.schema.get_field_index(ids_column))
            flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [decoder.decode(flat[off[i] : off[i + 1]].astype(np.int64)) if lists[i].is_valid else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("decoded", T.StringType())])
    return encoded.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)
