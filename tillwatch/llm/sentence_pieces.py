"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here: pieces with scores and types, model kind, normaliser. From it a tokenizers pipeline is built:
normaliser (character map, extra blanks, dummy prefix, metaspace marker), the unigram model with its scores, or for a BPE model
its merges in the order of the scores, byte fallback, and the matching decoder. If no piece has the marker behind another
character, texts are cut before each run of markers: no piece can cross such a cut, so the ids stay the same, and each distinct
word of a block is encoded once. Words are cut, told apart and put together again in Arrow, so Python sees only distinct ones. Whole texts are encoded by
the library's threads, words as one list. The ids that are given out are the tokenizers'.

Parity is verified with the sentencepiece library. If texts are cut and the normaliser only marks blanks, each distinct word is
checked once, when it is first met: no piece crosses a cut, so equal words make equal texts. Any other model is checked text by text.
Where the libraries differ, the ids of the model's own library are given out, `parity` is false in every row that is touched, and
counting these rows counts the repairs.

Defined results: a null text gives null ids, tokens and flags; an empty text gives no ids; repeated rows are encoded alike; an
empty table gives an empty result; texts of any length are encoded whole; other columns stay untouched.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_of, whole_rows
from .decontaminate import row_type

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: A model goes to every task; larger files are refused.
MAX_MODEL_BYTES = 64 << 20


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: whole numbers, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    character_map: bytes = b""
    dummy_prefix: bool = True
    single_blanks: bool = True
    escape_blanks: bool = True


def parsed(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode("utf-8"), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(fields(value))
            model.character_map = rules.get(2, b"")
            model.dummy_prefix, model.single_blanks, model.escape_blanks = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs that make a normal piece, best piece first."""
    ids = {piece: k for k, (piece, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    ranked = sorted(ids, key=lambda p: (-model.pieces[ids[p]][1], ids[p]))
    pairs = []
    for piece in ranked:
        halves = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        pairs += sorted(halves, key=lambda h: (ids[h[0]], ids[h[1]]))
    return pairs


#: A run of markers with what follows it.
WORD = f"{MARK}*[^{MARK}]+|{MARK}+"


def separable(model: Model) -> bool:
    """No piece has the marker behind another character."""
    return not any(MARK in piece.lstrip(MARK) for piece, _, _ in model.pieces)


def backend(data: bytes):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parsed(data)
    names = [p for p, _, _ in model.pieces]
    unknown = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], names.index(unknown) if unknown else None, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: k for k, p in enumerate(names)}, merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=50_000)
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.single_blanks:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_blanks else " "))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if separable(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    ends = [decoders.Replace(MARK, " ")] + ([decoders.ByteFallback()] if model.byte_fallback else []) + [decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*ends, *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Encoder:
    """Encodes whole texts; the ids of distinct words are kept, up to `keep` of them. Ids travel as bytes of 32-bit numbers."""

    def __init__(self, data: bytes, keep: int = 150_000, tokenizer=None, words=None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokenizer = tokenizer or backend(data)
        model = parsed(data)
        self.cut = separable(model)
        #: Without a character map or blanks to merge, the normaliser only marks blanks.
        self.plain = not model.character_map and not model.single_blanks and model.escape_blanks
        self.prefix = MARK if model.dummy_prefix else ""
        self.words, self.keep = words or backend(data), keep
        if self.cut:  # it gets normalised words
            self.words.normalizer = self.words.pre_tokenizer = None
        self.known: dict[str, bytes] = {}
        #: Words whose ids are those of the model's own library, as the tokenizers' differ.
        self.repaired: set[str] = set()
        #: What each id stands for in a decoded text.
        self.surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        #: Pieces that stand for no text of their own.
        self.unknown = [k for k, (_, _, kind) in enumerate(model.pieces) if kind in (UNKNOWN, CONTROL)]
        self.surfaces = pa.array(self.surface, pa.binary())

    def ids_of(self, texts: pa.Array, threads: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts without nulls: all ids one after the other, how many each text has, and whether both libraries agree on them."""
        if not (self.cut and self.plain):
            given = texts.to_pylist()
            own = [_pack(e.ids) for e in self.tokenizer.encode_batch_fast(given, add_special_tokens=False)]
            wanted = [_pack(x) for x in self.library.encode(given, num_threads=threads)]
            same = np.array([a == b for a, b in zip(own, wanted, strict=True)], dtype=bool)
            return np.frombuffer(b"".join(wanted), dtype=np.int32), np.array([len(x) // 4 for x in wanted], dtype=np.int64), same
        words, ends = cut_words(texts, self.prefix)
        coded = words.dictionary_encode()
        distinct, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices
        self.learn(distinct, threads)
        known = [self.known[w] for w in distinct]
        sizes = np.array([len(x) // 4 for x in known], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(known), dtype=np.int32)))

        def per_text(amounts: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(amounts[which.to_numpy()], dtype=np.int64))[ends])

        wrong = np.array([w.replace(" ", MARK) in self.repaired for w in distinct], dtype=np.int32) if self.repaired else np.zeros(len(distinct), dtype=np.int32)
        return lists.take(which).flatten().to_numpy(), per_text(sizes), per_text(wrong) == 0

    def learn(self, words: list[str], threads: int = 1) -> None:
        """Puts the ids of distinct words into `known`; a word has blanks where its pieces have markers."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.keep:
            self.known, self.repaired, new = {}, set(), words
        marked = [w.replace(" ", MARK) for w in new]
        # the library puts its own mark in front of a text, so the word is given without it
        bare = [w[len(self.prefix) :] if w.startswith(" ") else w for w in new]
        wanted = self.library.encode(bare, num_threads=threads)
        if "" in bare:  # one blank at the end of a text: an empty text has no mark
            wanted[bare.index("")] = self.library.encode("a ")[len(self.library.encode("a")) :]
        flat = np.fromiter(chain.from_iterable(wanted), dtype=np.int32)
        # as one list of words, which is one encoding: an object for every word costs more than its pieces
        whole = np.array(self.words.encode_batch_fast([marked], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.int32) if new else flat
        # pieces spell their words, so equal ids are cut at equal places; unknown ones spell nothing and are compared word by word
        if not np.array_equal(whole, flat) or np.isin(flat, self.unknown).any():
            own = self.words.encode_batch_fast(marked, add_special_tokens=False)
            self.repaired.update(w for w, mine, ids in zip(marked, own, wanted, strict=True) if mine.ids != list(ids))
        raw, ends = flat.tobytes(), (4 * np.cumsum(np.fromiter(map(len, wanted), dtype=np.int64, count=len(wanted)))).tolist()
        self.known.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends)), strict=True))

    def packed(self, texts: list[str], threads: int = 1) -> tuple[list[bytes], list[bool]]:
        """The ids of each text, and whether both libraries agree on them."""
        flat, sizes, same = self.ids_of(pa.array(texts, pa.string()), threads)
        return [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])] if texts else [], same.tolist()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [array("i", x).tolist() for x in self.packed(texts)[0]]

    def decoded(self, flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """`decode` of a block of texts: the bytes of the pieces, taken at once."""
        ends = np.append(0, np.cumsum(sizes))
        pieces = pa.concat_arrays([self.surfaces.take(pa.array(flat)), pa.array([b""])])
        at = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[ends]
        texts = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at), pieces.buffers()[2])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array(self.decode([x.tolist() for x in np.split(flat, ends[1:-1])]), pa.string())
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts) if self.prefix else texts

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        """Texts of ids: the bytes of the pieces. Where they aren't valid UTF-8, the tokenizers decoder decides."""
        out = []
        for row in ids:
            try:
                text = b"".join(map(self.surface.__getitem__, row)).decode()
                out.append(text[1:] if self.prefix and text.startswith(" ") else text)
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(list(row), skip_special_tokens=False))
        return out


def _pack(ids: Sequence[int]) -> bytes:
    return array("i", ids).tobytes()


def cut_words(texts: pa.Array, prefix: str) -> tuple[pa.StringArray, np.ndarray]:
    """The words of the texts one after the other, as `WORD` cuts them, with blanks for markers; and how many there are up to each text."""
    texts = pc.replace_substring(texts.cast(pa.string()), MARK, " ")
    if prefix:
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
    texts = pa.concat_arrays([texts, pa.array([""])])  # buffers of its own, and an end
    data = texts.buffers()[2] or pa.py_buffer(b"")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[: len(texts)]
    blank = np.frombuffer(data, dtype=np.uint8)[: ends[-1]] == ord(" ")
    starts = blank.copy()
    starts[1:] &= ~blank[:-1]
    starts[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(starts).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, ends[-1]).astype(np.int32)), data)
    return words, np.searchsorted(at, ends)


_LOADED: dict[int, Encoder] = {}


def loaded(data: bytes) -> Encoder:
    """The encoder, made once per worker."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(data)
    return _LOADED[key]


def default_model() -> str:
    """The model file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model_path: str | None = None, text: str = "text", threads: int = 2, block_bytes: int = 1 << 20) -> DataFrame:
    """docs as `row` with ids, decoded (the text of the ids), and parity."""
    path = model_path or default_model()
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"the model has over {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = whole_rows(docs)

    def run(batches):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        encoder = loaded(sent.value)
        for block in blocks(batches, block_bytes, text):
            texts = text_of(block, text)
            given = texts.drop_null()
            flat, sizes, agreed = encoder.ids_of(given, threads)
            none = texts.is_null().to_numpy(zero_copy_only=False)
            place = pa.array(np.cumsum(~none) - 1, mask=none)
            lengths = np.zeros(len(texts), dtype=np.int32)
            lengths[~none] = sizes
            ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [block.column("row"), ids, encoder.decoded(flat, sizes).take(place), pa.array(agreed).take(place)], ["row", "ids", "decoded", "parity"])

    return rows.mapInArrow(run, f"row {row_type(rows)}, ids array<int>, decoded string, parity boolean")


def with_tokens(docs: DataFrame, model_path: str | None = None, text: str = "text", **options) -> DataFrame:
    """docs with ids, n_tokens, round_trip (decoding gives the text back) and parity; an own column of such a name stays in front."""
    rows = encoded(docs, model_path, text, **options)
    extra = {"ids": F.col("ids"), "n_tokens": F.size("ids").cast("bigint"), "round_trip": F.col("decoded") == F.col(f"row.`{text}`"), "parity": F.col("parity")}
    own = {c.lower() for c in docs.columns}
    return rows.select("row.*", *[F.when(F.col("ids").isNotNull(), v).alias(k if k not in own else f"token_{k}") for k, v in extra.items()])
