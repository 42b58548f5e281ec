"""Encoding to and decoding from pieces with log scores: Viterbi over a double-array trie, with byte fallback.

Text is normalised as the piece files used here ask for: a leading space, and each space as the marker U+2581. As no
piece has the marker behind another character, a text splits before its markers, and its best path is that of the parts
one after the other (a vocabulary without that property is run over whole texts). A character that no piece covers costs
ten below the least score and is written as the pieces of its UTF-8 bytes. Of paths with equal scores the one wins whose
last piece starts first.

Defined results: null and empty texts have no pieces and decode to the empty text; a null id is carried through; repeated
rows give repeated results; a marker in the text itself decodes to a space, so only such texts do not come back exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and, tidy

MARK = "▁"
#: Encoded parts a worker keeps; beyond it the store starts anew.
PARTS_KEPT = 500_000
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie over byte strings in two arrays: the child of state s by byte c is base[s] + c if check there is s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        # no state is a child in the first 257 places: a byte of zero at a state without children leads nowhere, as do all others
        free = wide = 257  # where the search for room starts: for one child, for several
        stack = [(0, 0, len(order), 0)] if order else []
        while stack:
            state, a, b, depth = stack.pop()
            if len(keys[order[a]]) == depth:
                self.value[state] = order[a]
                a += 1
            children, i = [], a
            while i < b:
                c, j = keys[order[i]][depth], i
                while j < b and keys[order[j]][depth] == c:
                    j += 1
                children.append((c, i, j))
                i = j
            if not children:
                continue
            at = start = free if len(children) == 1 else max(free, wide)
            while True:
                self._room(at + 257)
                base = at - children[0][0]
                if all(self.check[base + c] < 0 for c, _, _ in children):
                    break
                at += 1
            if at - start > 512:
                wide = at - 256
            self.base[state] = base
            for c, i, j in children:
                self.check[base + c] = state
                stack.append((base + c, i, j, depth + 1))
            while free < len(self.check) and self.check[free] >= 0:
                free += 1

    def _room(self, n: int) -> None:
        while len(self.check) < n:
            more = len(self.check)
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


class Parts(dict):
    """(packed ids, summed score) of parts of texts; one that is not known yet is encoded when it is asked for."""

    def __init__(self, best):
        self.best = best

    def __missing__(self, part: str) -> tuple[bytes, float]:
        ids, score = self.best(part)
        self[part] = found = array("I", ids).tobytes(), score
        return found


class UnigramPieces:
    """Pieces with log scores; ``kinds`` are "piece", "byte" or "other" (never matched)."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces, self.scores, self.kinds = pieces, scores, kinds
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == "byte"}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.ids = [i for i, k in enumerate(kinds) if k == "piece"]
        self.trie = DoubleArray([pieces[i].encode() for i in self.ids])
        self.unknown = min((scores[i] for i in self.ids), default=0.0) - UNKNOWN_PENALTY
        text = "".join(pieces[i] for i in self.ids)
        lone = "".join(c for c in "\n\t\r" if c not in text)  # no piece has them, so a path always stops on both sides
        splits = not any(MARK in p.lstrip(MARK) for p in (pieces[i] for i in self.ids))
        self.parts = re.compile((f"[{lone}]|" if lone else "") + f"{MARK}*[^{MARK}{lone}]+|{MARK}+" if splits else "(?s).+").findall
        self.raw = [bytes([self.byte_of[i]]) if k == "byte" else p.encode() if k == "piece" else b"" for i, (p, k) in enumerate(zip(pieces, kinds))]
        self.gain = [scores[self.ids[k]] if k >= 0 else None for k in self.trie.value]  # by state: the score of the piece that ends there
        self.known = Parts(self.best)

    def best(self, text: str) -> tuple[tuple[int, ...], float]:
        """Ids and summed score of the best path through ``text`` (already normalised)."""
        data, base, check, gain, ids = text.encode(), self.trie.base, self.trie.check, self.gain, self.ids
        n = len(data)
        score, back, by = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)  # by: the last step's state, -1 for a character without pieces
        score[0], i = 0.0, 0
        while i < n:
            here, state, j = score[i], 0, i
            first = data[i]
            after = i + (1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4)
            single = False
            for c in data[i:]:
                to = base[state] + c
                if check[to] != state:
                    break
                state = to
                j += 1
                s = gain[state]
                if s is not None:
                    if here + s > score[j]:
                        score[j], back[j], by[j] = here + s, i, state
                    if j == after:
                        single = True
            if not single and here + self.unknown > score[after]:
                score[after], back[after], by[after] = here + self.unknown, i, -1
            i = after
        out, j, value = [], n, self.trie.value
        while j > 0:
            i, state = back[j], by[j]
            out += [ids[value[state]]] if state >= 0 else [self.byte_id.get(b, 0) for b in reversed(data[i:j])]
            j = i
        return tuple(reversed(out)), score[n]

    def encode_packed(self, text: str) -> tuple[bytes, float]:
        """Ids as little-endian unsigned 32-bit numbers, and the summed score."""
        if not text:
            return b"", 0.0
        if len(self.known) > PARTS_KEPT:
            self.known.clear()
        packed, scores = zip(*map(self.known.__getitem__, self.parts(MARK + text.replace(" ", MARK))))
        return b"".join(packed), math.fsum(scores)

    def encode(self, text: str) -> tuple[list[int], float]:
        packed, score = self.encode_packed(text)
        return array("I", packed).tolist(), score

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def from_model(path: str, zipf: bool = True) -> UnigramPieces:
    """The pieces of a model file. ``zipf``: for a file that ranks pieces only, log scores by Zipf's law of the rank."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
    kinds = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece" for i in range(n)]
    if zipf:
        ranked = sorted((i for i in range(n) if kinds[i] == "piece"), key=lambda i: (-scores[i], i))
        norm = math.log(sum(1 / (r + 1) for r in range(len(ranked))) or 1)
        for r, i in enumerate(ranked):
            scores[i] = -math.log(r + 1) - norm
    return UnigramPieces(pieces, scores, kinds)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, score) of each whole text; ids is an array<int>."""
    schema = id_and(docs, "ids array<int>, score double")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = from_model(model_path)
        for b in batches:
            got = [model.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.float64())], schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(encoded), schema)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """The digest of encoding and decoding each whole text, made in one pass so that ids need not leave the worker."""
    schema = id_and(docs, "n_bytes long, n_pieces long, n_byte_pieces long, score double, ids_crc32 long, decoded_sha256 string, exact boolean")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = from_model(model_path)
        bytes_ = np.zeros(len(model.pieces), bool)
        bytes_[list(model.byte_of)] = True
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                packed, score = model.encode_packed(text)
                ids = np.frombuffer(packed, "<u4")
                back = model.decode(ids.tolist())
                rows.append((len(text.encode()), len(ids), int(bytes_[ids].sum()), score, zlib.crc32(packed), hashlib.sha256(back.encode()).hexdigest(), back == text))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds))], schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(digests), schema)
