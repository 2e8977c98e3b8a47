"""SentencePiece BPE encoding and decoding by a prefix table of last tokens (operator 13)."""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import map_arrow, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Segments and piece pairs remembered by a task; beyond these the memory starts anew.
MAX_SEGMENTS = 1 << 18
MAX_PAIRS = 1 << 20
#: Longer segments (in characters) are encoded but not remembered.
MAX_REMEMBERED = 48


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _wire(data: bytes):
    """(field number, value) of a serialised message; nested messages stay bytes."""
    at = 0

    def varint():
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
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at:at + size]
            at += size


class PieceCoder:
    """Encoder and decoder for one BPE model with byte fallback.

    The pieces of a text's prefixes nest: the encoding of a prefix is the encoding
    of a shorter prefix and one last piece. Of all pieces that end at a place (the
    automaton's matches) exactly one may follow the last piece of the prefix before it,
    where "may follow" means that merging both strings together gives those two pieces.
    One pass fills the table of last pieces; walking it backwards gives the ids.

    Texts are cut first where no merge can reach over: no piece has a blank after
    another character, none has a mark (of a set closed under this rule) after a letter or digit,
    and a character in no longer piece stays alone. All three are read from the
    vocabulary; models without the first, or that normalise, are refused.
    """

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces, scores = sp.id_to_piece(list(range(size))), sp.get_score(list(range(size)))
        spec = dict(_wire(dict(_wire(sp.serialized_model_proto()))[3]))
        if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
            raise ValueError("only models without normalisation, with a leading blank and marked blanks, are supported")
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = [b""] * size  # control pieces leave nothing
        self.byte_ids = [0] * 256
        self.byte_set: set[int] = set()
        for i, p in enumerate(pieces):
            if sp.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if sp.is_byte(i):
                value = int(p[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
                self.byte_set.add(i)
            elif sp.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.ids[p] = i
                self.bytes_of[i] = p.replace(SPACE, " ").encode()
        if len(self.byte_set) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.score = {p: scores[i] for p, i in self.ids.items() if len(p) > 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a blank after another character")
        joined = sorted({c for p in self.score for c in p} - {SPACE})
        self.automaton = ahocorasick.Automaton()
        for p in {*self.score, *joined, SPACE}:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        marks = {c for c in joined if not (c.isalpha() or c.isdecimal())}
        after = [(a, b) for p in self.score for a, b in zip(p, p[1:]) if a != SPACE]
        while inner := {b for a, b in after if b in marks and a not in marks}:
            marks -= inner
        mark, rest = (f"[{''.join(map(re.escape, sorted(s)))}]" if s else "(?!)" for s in (marks, set(joined) - marks))
        self.cut = re.compile(f"{SPACE}*(?:{mark}*{rest}+|{mark}+)|{SPACE}+|.", re.S)
        # the bytes that a piece, or a character of no piece, adds to a row of ids
        self.coded = {p: np.array([i], "<i4").tobytes() for p, i in self.ids.items()}
        self.starts_blank = frozenset(i for p, i in self.ids.items() if p.startswith(SPACE))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.segments: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The definition, for two pieces at most: merge the best pair, leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: str, piece: str) -> bool:
        """Does merging both strings give these two pieces? ``before`` is empty at the start."""
        fits = self.merged(before + piece) == ([before, piece] if before else [piece])
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[before, piece] = fits
        return fits

    def split(self, segment: str) -> list[str]:
        """The pieces of one segment from its prefix table."""
        last, pairs = [""] * (len(segment) + 1), self.pairs
        for end, piece in self.automaton.iter(segment):
            end += 1
            if last[end]:
                continue
            before = last[end - len(piece)]
            fits = pairs.get((before, piece))
            if self.may_follow(before, piece) if fits is None else fits:
                last[end] = piece
        out, end = [], len(segment)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _segment(self, segment: str) -> bytes:
        known = self.segments.get(segment)
        if known is None:
            pieces = self.split(segment) if segment[0] in self.automaton else [segment]
            known = b"".join([self.coded.get(p) or self._bytes(p) for p in pieces])
            if len(segment) <= MAX_REMEMBERED:
                if len(self.segments) >= MAX_SEGMENTS:
                    self.segments.clear()
                self.segments[segment] = known
        return known

    def _bytes(self, char: str) -> bytes:
        return np.array([self.byte_ids[b] for b in char.encode()], "<i4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers; null counts as empty."""
        if not text:
            return b""
        return b"".join(map(self._segment, self.cut.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the leading blank goes, bytes join to characters, each byte of none becomes U+FFFD."""
        ids = list(ids)
        parts = [self.bytes_of[i] for i in ids]
        first = next((i for i, p in zip(ids, parts) if p), None)
        strip = first in self.starts_blank
        if b"" not in parts:
            try:
                return b"".join(parts)[strip:].decode()
            except UnicodeDecodeError:
                pass
        return self._lenient(ids, strip)

    def _lenient(self, ids: list[int], strip: bool) -> str:
        """Bytes in a row character by character; other pieces, control pieces too, end the row."""
        parts, run = [], b""
        for i in [*ids, None]:
            if i in self.byte_set:
                run += self.bytes_of[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    run = run[1:]
            if i is not None:
                parts.append(self.bytes_of[i].decode())
        return "".join(parts)[strip:]


def piece_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string: every whole text's ids, and the text that these ids give.

    Each task builds the coder from the model file and streams its own rows; nothing is shuffled.
    Defined cases: null text is empty and has no ids; repeated rows and rows with a null doc_id are
    encoded each; other columns are left out whatever their names; an empty table gives no rows.
    Decoding gives the text back but that its own "▁" become blanks.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held: list[PieceCoder] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(PieceCoder(path or model_path()))
        coder = held[0]
        found = [coder.encode(t) for t in batch.column(1).to_pylist()]
        ids = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
        ends = np.cumsum([0, *(len(b) // 4 for b in found)])
        texts = [coder.decode(np.frombuffer(b, "<i4").tolist()) for b in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.array(texts, pa.string())],
            ["doc_id", "ids", "decoded"])

    return map_arrow(src, run, "doc_id long, ids array<int>, decoded string")


def op13_piece_bpe(spark, sf_dir: str) -> DataFrame:
    return piece_ids(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
