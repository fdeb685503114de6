"""SentencePiece encoding and decoding, exact for merge-type (BPE) models, by backtracking.

Of the pieces that begin at a position (found by one Aho-Corasick pass) the longest is tried first; it stands if it is compatible
with the piece before it, that is, if merging the two pieces' characters anew gives the same two pieces. Where
none stands, the position goes into a bitfield of failed positions, the last piece is taken back, and the next shorter
one is tried. A sequence whose neighbours are all compatible is the one that merging gives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, worker_caches

SPACE = "▁"
#: Entries of each generation of the word cache, and of the cache of compatible pairs, in a Python worker.
MAX_WORDS, MAX_PAIRS = 120_000, 400_000


class BacktrackingEncoder:
    """Encodes as the library does for a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.ids: dict[str, int] = {}
        self.bytes: list[int | None] = [None] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[piece] = i
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.alphabet = frozenset(c for p in self.ids for c in p)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self.merged(p) == [p]:  # a piece that merging never makes is never used
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        # Merging never crosses a place that no piece spans: before a space mark after another character, and around
        # white space that is in no piece. Between such places lie the cached words.
        free = "".join(re.escape(c) for c in "\n\t\r" if c not in self.alphabet)
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{free}]+|{SPACE}+" + (f"|[{free}]" if free else "") if apart else "(?s).+").findall

    def merged(self, text: str) -> list[str]:
        """Plain merging of the characters: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text of known characters."""
        n = len(text)
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for end, size in self.automaton.iter(text):
            starts[end - size + 1].append(size)  # ends rise, so the sizes at a start rise too
        failed = bytearray(n + 1)
        stack: list[tuple[int, int, str]] = []
        at, k, last = 0, len(starts[0]) - 1, ""
        while at < n:
            sizes = starts[at]
            while k >= 0:
                end = at + sizes[k]
                if not failed[end]:
                    piece = text[at:end]
                    if not stack or self.compatible(last, piece):
                        break
                k -= 1
            if k >= 0:
                stack.append((at, k, piece))
                at, last, k = end, piece, len(starts[end]) - 1
            elif stack:
                failed[at] = 1
                at, k, _ = stack.pop()
                last = stack[-1][2] if stack else ""
            else:
                raise ValueError("no sequence of compatible pieces")  # can't happen: merging gives one
        return [p for _, _, p in stack]

    def word(self, text: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers."""
        out: list[int] = []
        if self.alphabet.issuperset(text):
            out = [self.ids[p] for p in self.pieces(text)]
        else:
            known = ""
            for c in text + "\0":
                if c in self.alphabet and c != "\0":
                    known += c
                    continue
                if known:
                    out += [self.ids[p] for p in self.pieces(known)]
                    known = ""
                out += [self.unk if self.bytes[b] is None else self.bytes[b] for b in c.encode()]
            del out[-1]  # of the added end mark
        return b"".join(i.to_bytes(4, "little") for i in out)

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian 32-bit integers."""
        found = [self.bos.to_bytes(4, "little")]
        if text:
            new, old = self.new, self.old
            for w in self.words(SPACE + text.replace(" ", SPACE)):
                ids = new.get(w)
                if ids is None:
                    ids = old.get(w) or self.word(w)
                    if len(new) >= MAX_WORDS:
                        self.old, self.new = new, {}
                        new, old = self.new, self.old
                    if len(w) <= 64:
                        new[w] = ids
                found.append(ids)
        found.append(self.eos.to_bytes(4, "little"))
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


#: What a model of another kind (unigram, other normalisation, no dummy prefix, no byte fallback) would encode otherwise.
PROBES = ("a", " lead and trail ", "two  spaces", "\ufb01ne \u2460 \uff21\u212b e\u0301 \u1112\u1161\u11ab", "tab\tline\nfeed\r\n", "\u00a0\u3000x", "\U0001f600\u0378 \ue000", "unbelievable internationalisation 12345", "\u2581mark \u4f60\u597d\u0e44\u0e17\u0e22")


def check_model(model: bytes) -> None:
    """Raises ValueError unless the encoder gives the library's ids for all probes."""
    encoder = BacktrackingEncoder(model)
    for text in PROBES:
        ids = encoder.encode(text)
        if [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] != encoder.library.encode(text, add_bos=True, add_eos=True):
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are encoded exactly")


_encoders: dict[bytes, BacktrackingEncoder] = {}


def _forget_words() -> None:
    for encoder in _encoders.values():
        for cache in (encoder.new, encoder.old, encoder.pairs):
            cache.clear()


worker_caches["op10"] = _forget_words


def _encoder(model: bytes) -> BacktrackingEncoder:
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = BacktrackingEncoder(model)
    return _encoders[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, model_path: str | None = None, values: bool = True) -> DataFrame:
    """One row per input row, with begin and end ids: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if values, ids (array)
    and decoded (text).

    A model that the method can't encode exactly raises ValueError. Null text counts as empty and gives the begin and end ids only. Any text is encoded whole. Repeated rows give
    repeated results; extra columns are ignored; an empty table gives an empty result.
    """
    import numpy as np

    spark = docs.sparkSession
    with open(model_path or default_model(), "rb") as f:
        data = f.read()
    check_model(data)
    model = spark.sparkContext.broadcast(data)  # half a MB, of fixed size
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op10")
        encoder = _encoder(model.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                packed = encoder.encode(text.as_py() or "")
                ids = np.frombuffer(packed, "<i4")
                decoded = encoder.decode(ids.tolist())
                row = [len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row + [ids, decoded] if values else row)
            columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * (5 if values else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=["doc_id", *names[: len(columns)]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
