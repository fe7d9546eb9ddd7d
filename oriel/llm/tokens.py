"""Token counting with a whole-token shortcut, and fast exact byte-level BPE ids.

Both work on the distinct pre-tokens of a few megabytes of text at a time: boundaries are found on whole
arrays, pre-tokens go through Arrow's dictionary encoding, and only distinct strings reach a tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import binary_array, prepare, slices, string_buffer

#: Distinct strings that a worker remembers before it starts anew; a cache only, results don't depend on it.
CACHE_ENTRIES = 400_000
SPACE_MARK = "▁"


@lru_cache(maxsize=4)
def shared(maker, path: str):
    """One tokenizer per worker process: its cache of pre-tokens serves all tasks of the worker."""
    return maker(path)


# --- counts: whole-token shortcut over a sentencepiece BPE vocabulary ---------------------------------------


def proto_fields(raw: bytes) -> dict[int, list]:
    """The fields of a protobuf message by number: integers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = raw[at : at + size]
            at += size
        out.setdefault(key >> 3, []).append(value)
    return out


def rewrites_nothing(model: bytes) -> bool:
    """Whether a model's normaliser leaves every character as it is, by its own settings.

    Field 3 of a model holds them: 2, a map of characters to others, is empty; 3 puts a space mark before a text
    (default: yes); 4 would drop repeated and outer spaces (default: yes), so it is no; 5 writes spaces as marks (yes).
    """
    settings = proto_fields(proto_fields(model).get(3, [b""])[-1])
    last = lambda field, default: settings.get(field, [default])[-1]
    return not last(2, b"") and last(3, 1) == 1 and last(4, 1) == 0 and last(5, 1) == 1


@lru_cache(maxsize=2)
def whole_tokens(model_path: str):
    """The processor, and the units that it encodes alone as exactly one token.

    A unit is a run of spaces with the word after it. The proof has three parts: the model's own settings say that
    no character is rewritten or dropped; no piece of the whole vocabulary holds a space mark behind another
    character, so no merge crosses from a word into the next unit and units are encoded independently; and every
    piece that can be a unit is encoded once to see whether it stays whole. Where one of the first two fails the
    shortcut is off (None).
    """
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
    crosses = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
    if crosses or not rewrites_nothing(processor.serialized_model_proto()) or SPACE_MARK not in pieces:
        return processor, None
    units = [p for p in pieces if p.startswith(SPACE_MARK)]
    alone = processor.encode([u[1:].replace(SPACE_MARK, " ") for u in units], num_threads=1)
    # a lone space is the one unit that can't be told from no text this way; its mark has a piece
    return processor, {u.replace(SPACE_MARK, " ").encode() for u, ids in zip(units, alone, strict=True) if len(ids) == 1} | {b" "}


class UnitCounts:
    """Token counts of distinct units: 1 by the shortcut, else what the library's merges give."""

    def __init__(self, model_path: str) -> None:
        self.processor, self.whole = whole_tokens(model_path)
        self.known: dict[bytes, int] = {}

    def of(self, units: list[bytes]) -> np.ndarray:
        whole, known = self.whole, self.known
        rest = [u for u in units if u not in whole and u not in known]
        if rest:
            if len(known) + len(rest) > CACHE_ENTRIES:
                known = self.known = {u: known[u] for u in units if u in known}
            ids = self.processor.encode([u[1:].decode() for u in rest], num_threads=1)
            known.update(zip(rest, map(len, ids), strict=True))
        return np.fromiter((1 if u in whole else known[u] for u in units), np.int64, len(units))


def count_texts(column: pa.Array, counts: UnitCounts) -> np.ndarray:
    """Token counts of the texts of an array (null: empty, an empty text has none)."""
    if counts.whole is None:
        return np.array([len(counts.processor.encode(t or "")) for t in column.to_pylist()], dtype=np.int64)
    column = pc.replace_substring(column.fill_null(""), SPACE_MARK, " ")  # the library reads both as the mark
    raw, ends = string_buffer(pc.binary_join_element_wise(pa.scalar(" "), column, pa.scalar("")))
    space = raw == 0x20
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[ends[:-1]] = True  # every text begins a unit, whatever the one before ends with
    at = np.flatnonzero(starts)
    coded = binary_array(raw, at, len(raw)).dictionary_encode()
    each = counts.of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    total = np.add.reduceat(each, np.searchsorted(at, ends[:-1])) if len(ends) > 1 else np.zeros(0, np.int64)
    return np.where(np.diff(ends) == 1, 0, total)  # only the prefix: an empty text


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", limit: int = 4096) -> DataFrame:
    """Token counts per row: key, n_bytes, n_tokens, over_limit.

    Nulls and empty texts count 0 tokens; rows with equal or null keys each keep their row; other columns
    are dropped, so their names can't clash. Map-side only: nothing is shuffled.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared(UnitCounts, model_path)
        for batch in batches:
            column = batch.column(1)
            n = [count_texts(column.slice(row, rows), counts) for row, rows in slices(column)]
            tokens = np.concatenate(n) if n else np.zeros(0, np.int64)
            size = np.diff(string_buffer(column)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=["k", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", key)


# --- ids: byte-level BPE ------------------------------------------------------------------------------------

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
#: Code points with classes that Unicode versions agree on; texts with others take the library's slow path.
STABLE = 0xA000


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    import regex

    classes = np.zeros(STABLE, np.uint8)
    every = "".join(map(chr, range(STABLE)))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", BLANK)):
        classes[[ord(c) for c in regex.findall(pattern, every)]] = kind
    assigned = np.zeros(STABLE, bool)
    assigned[[ord(c) for c in regex.findall(r"\P{Cn}", every)]] = True
    classes[~assigned] = 9  # not assigned yet: another library may know better
    return classes


def pretoken_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens of the byte-level pattern begin, for texts laid end to end; ``first``: each text's start.

    The pattern takes contractions, then an optional blank with a run of letters, of numbers or of other
    characters, then a run of white space up to the last one before a word, then white space.
    """
    kind = code_classes()[codes]
    n = len(codes)
    begin = np.zeros(n, bool)
    begin[first] = True
    start = begin.copy()
    start[1:] |= kind[1:] != kind[:-1]
    word = np.flatnonzero(start & (kind != BLANK) & ~begin)
    after = word[kind[word - 1] == BLANK]
    start[after - 1] = True
    start[after[codes[after - 1] == 0x20]] = False
    # contractions: a lone apostrophe that begins a pre-token, before letters of the same text
    quote = np.flatnonzero((codes == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~begin[quote + 1]]
    one, two = codes[quote + 1], np.zeros(len(quote), codes.dtype)
    longer = quote + 2 < n
    two[longer] = np.where(begin[quote[longer] + 2], 0, codes[quote[longer] + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    taken = short | double
    start[quote[taken] + 1] = False
    rest = quote[taken] + np.where(short[taken], 2, 3)
    start[rest[rest < n]] = True
    return np.flatnonzero(start)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in a byte-level vocabulary, for str.translate on Latin-1 text."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class ByteBpe:
    """Ids of whole texts, as the tokenizers library gives them without added special tokens.

    Special strings inside a text become their id, as is that library's default; such texts, and texts with
    rare code points, are encoded whole by the library. For the rest, each distinct pre-token goes through
    the library's BPE model once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fresh()

    def fresh(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def rows(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces in ``flat``/``ends``."""
        if len(self.known) + len(pieces) > CACHE_ENTRIES:
            self.fresh()
        known, letters, tokenize = self.known, byte_letters(), self.model.tokenize
        new: list[int] = []
        sizes: list[int] = []
        n = len(known)
        for p in pieces:
            if p not in known:
                ids = [t.id for t in tokenize(p.decode("latin-1").translate(letters))]
                known[p] = n
                n += 1
                new += ids
                sizes.append(len(ids))
        if sizes:
            self.flat = np.concatenate([self.flat, np.array(new, np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return np.fromiter((known[p] for p in pieces), np.int64, len(pieces))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of an array laid end to end, and the count of each text."""
        column = column.fill_null("")
        raw, ends = string_buffer(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        head = (raw & 0xC0) != 0x80  # first bytes of code points
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.concatenate([[0], np.cumsum(head)])  # code points before each byte
        text_codes = place[ends]
        odd = np.zeros(len(column), bool)
        rare = np.flatnonzero(codes >= STABLE)
        if len(rare):
            codes = np.where(codes >= STABLE, 0, codes)
        unsure = np.flatnonzero(code_classes()[codes] == 9)
        for at in (rare, unsure):
            odd[np.searchsorted(text_codes, at, side="right") - 1] = True
        for s in self.special:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        full = np.flatnonzero(np.diff(ends) > 0)
        at = pretoken_starts(codes, text_codes[full])
        byte_at = np.flatnonzero(head)[at]
        coded = binary_array(raw, byte_at, len(raw)).dictionary_encode()
        row = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        size = (self.ends[1:] - self.ends[:-1])[row]
        total = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(total[-1]) + np.repeat(self.ends[row] - total[:-1], size)
        ids = self.flat[take]
        text_ends = total[np.append(np.searchsorted(byte_at, ends[:-1]), len(byte_at))]
        if not odd.any():
            return ids, np.diff(text_ends)
        parts = [ids[text_ends[i] : text_ends[i + 1]] if not odd[i] else np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in range(len(column))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
