"""Operator 3, SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; from it the library's normaliser (compiled character map, white-space rules, metaspace
marker), its unigram model (scores) or byte-pair model (merges in the order of their pieces' scores), byte fallback and
decoder are rebuilt. Texts are cut where no piece of the vocabulary can reach across, so that equal parts are encoded once
a worker, many at a time on several threads.

Parity: each whole raw text is encoded by the SentencePiece library too, and every text's ids are decoded and held against
the normalised text. ``parity`` is true if both agree.

Nulls and edge cases: null and empty texts have no ids; control pieces in a text are plain characters; repeated rows are
encoded each; empty tables give empty results; texts of any length are encoded whole. Extra columns are left alone.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import read, small_batches, worker_cache

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
_LONG = 48
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + n]
            i += n


class ModelFile:
    """What encoding needs of a SentencePiece model."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []  # piece, score, type
        trainer, rules = {}, {}
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
        self.type = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix = bool(trainer.get(24, 0))
        self.charsmap = rules.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.type not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and byte-pair models with a marker before words are supported")


def normalizer(m: ModelFile):
    """The library's normaliser for this model; None if it would change nothing."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def build(m: ModelFile):
    """The library's tokenizer without its normaliser, which callers apply first."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    if m.type == UNIGRAM:
        # pieces that never match text get a score that never wins
        scores = [(p, s if kind in (NORMAL, USER, UNKNOWN) else -1e6) for p, s, kind in m.pieces]
        tok = Tokenizer(models.Unigram(scores, m.unknown, m.byte_fallback))
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        plain = {p for p, _, kind in m.pieces if kind in (NORMAL, USER)}
        merges = []
        for p, score, kind in m.pieces:
            if kind == NORMAL:
                halves = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
                merges += [(-score, vocab[p], vocab[a], vocab[b], a, b) for a, b in halves]
        merges.sort()
        tok = Tokenizer(models.BPE(vocab, [x[4:] for x in merges], unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    if users := [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER]:
        tok.add_tokens(users)
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return tok


class Codec:
    """Encodes and decodes texts; parts that no piece crosses are kept, ``most`` of them."""

    def __init__(self, data: bytes, threads: int = 2, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = ModelFile(data)
        self.normalizer, self.tok, self.most = normalizer(self.model), build(self.model), most
        self.memo: dict[str, bytes] = {}
        self.wrong = 0  # how many texts the SentencePiece library has encoded otherwise
        self.peer, self.texts = None, None
        long = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER) and len(p) > 1]
        # a piece with a marker after another character could reach across words
        self.cuts = not any(MARK in p.lstrip(MARK) for p in long) and not any(kind == USER for _, _, kind in self.model.pieces)
        inside = {c for p in long for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        # ASCII signs that no piece has after a letter: a word may be cut before them
        after = {b for p in long for a, b in zip(p, p[1:]) if re.match(_LETTER, a)}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after)
        self.parts = re.compile(f"{MARK}*{_LETTER}++(?=[{MARK}{alone}{signs}]|$)|{f'[{alone}]|' * bool(alone)}{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")
        self.simple = not self.model.charsmap and not self.model.squeeze

    def normalize(self, text: str) -> str:
        if self.simple:
            return ((MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)) if text else ""
        return self.normalizer.normalize_str(text) if text else ""

    def verify_with(self, data: bytes) -> None:
        """From now on the SentencePiece library encodes each text, too."""
        import sentencepiece

        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """Little-endian unsigned 32-bit ids of each text; whether the SentencePiece library agrees on the raw text."""
        texts = [t or "" for t in texts]
        out = self._ids([self.normalize(t) for t in texts])
        if self.peer is None:
            return out, [True] * len(out)
        agree = [a == np.array(b, dtype="<u4").tobytes() for a, b in zip(out, self.peer.encode(texts, num_threads=1), strict=True)]
        self.wrong += agree.count(False)
        return out, agree

    def _ids(self, whole: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._encode(whole)
        if len(self.memo) > self.most:
            self.memo.clear()
        memo, cut, extra = self.memo, [self.parts.findall(t) for t in whole], {}
        new = list(set().union(*cut).difference(memo))
        for p, i in zip(new, self._encode(new), strict=True):
            (memo if len(p) <= _LONG else extra)[p] = i
        if extra:
            return [b"".join([memo[p] if p in memo else extra[p] for p in ps]) for ps in cut]
        return [b"".join(map(memo.__getitem__, ps)) for ps in cut]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The library's decoding. Its decoders take tokens one by one, so that each piece's text is asked for once; only bytes
        that are no character of their own depend on their neighbours, and texts with such are decoded whole."""
        if self.texts is None:
            first = next(i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == NORMAL and MARK not in p and " " not in p)
            lead = len(self.tok.decode([first], skip_special_tokens=False))
            pairs = [[first, i] for i in range(len(self.model.pieces))]
            self.texts = np.array([x[lead:] for x in self.tok.decode_batch(pairs, skip_special_tokens=False)], dtype=object)
            self.bytes = np.array([kind == BYTE and not x.isascii() for (*_, kind), x in zip(self.model.pieces, self.texts, strict=True)], dtype=bool)
        out = []
        for x in map(np.asarray, ids):
            if not len(x):
                out.append("")
            elif self.bytes[x].any():
                out.append(self.tok.decode(x.tolist(), skip_special_tokens=False))
            else:
                text = "".join(self.texts[x].tolist())
                out.append(text[1:] if self.model.dummy_prefix and text.startswith(" ") else text)
        return out


def codec_of(path: str, threads: int) -> Codec:
    """This worker's codec, verifying."""

    def make() -> Codec:
        with open(path, "rb") as f:
            data = f.read()
        codec = Codec(data, threads)
        codec.verify_with(data)
        return codec

    return worker_cache(("sentencepiece", path, threads), make)


def encode(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id, ids, n_tokens, decoded and parity of each document. model: a path that every worker has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                data, agree = codec.encode(texts)
                arrays = [np.frombuffer(d, dtype="<u4") for d in data]
                decoded = codec.decode(arrays)
                flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))
                whole = [codec.normalize(t or "").removeprefix(MARK if codec.model.dummy_prefix else "").replace(MARK, " ") for t in texts]
                parity = [a and d == w for a, d, w in zip(agree, decoded, whole, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array([len(a) for a in arrays], pa.int64()), pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array(decoded, pa.string()), pa.array(parity, pa.bool_())], names=["doc_id", "ids", "n_tokens", "ids_crc32", "decoded", "parity"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded string, parity boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", "ids_crc32", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "parity")
