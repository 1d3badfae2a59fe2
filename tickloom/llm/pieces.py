"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The vocabulary (pieces and scores) is read from a public model file; nothing is trained. The best segmentation of a text
has the largest sum of piece scores. The automaton reads the text once, byte by byte; at each position its output links
list all pieces that end there, and each relaxes the best score at that position. A character that is no piece by itself
may be spelt by byte pieces at a score below that of every piece. No piece goes over a space that follows another
character or over a line break, so segments between those places are solved apart, equal segments once, and many at a
time: the steps of all segments of a batch run together over arrays.

Decoding joins the pieces, and gives back the very text, whatever it holds: U+2581 in a text is spelt in bytes and never
mistaken for a space, and names of control pieces in a text are ordinary characters.

Null and empty texts have no pieces; a null decodes to an empty text; very long texts are encoded whole; repeated rows are
encoded each; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import raw

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()
# Bytes that no UTF-8 text holds stand for the three bytes of a U+2581 that the text itself holds.
LITERAL = b"\xf8\xf9\xfa"
_SEGMENT = re.compile(rb" *(?:[^ \n]+|\n)| +")
SPELT = -2
KEPT_SEGMENTS = 300_000


class Pieces:
    """Vocabulary, automaton and codec of one model."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.surface: list[bytes] = []
        ids, keys, scores = [], [], []
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_id[value] = k
                self.surface.append(bytes([value]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace("▁", " ").encode())
                ids.append(k)
                keys.append(piece.encode())
                scores.append(sp.get_score(k))
        for mark, byte in zip(LITERAL, SPACE):
            self.byte_id[mark] = self.byte_id[byte]
        spaced = [s for s in (self.surface[k] for k in ids)]
        self.cuts = not any(b"\n" in s or b" " in s.lstrip(b" ") for s in spaced)
        self.spell = min(scores, default=0.0) - 10.0
        self._build(ids, keys, scores)
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _build(self, ids: list[int], keys: list[bytes], scores: list[float]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for n, key in enumerate(keys):
            at = 0
            for byte in key:
                to = children[at].get(byte)
                if to is None:
                    to = children[at][byte] = len(children)
                    children.append({})
                at = to
            ends[at] = n
        size = len(children)
        self.goto = np.zeros((size, 256), dtype=np.int32)
        self.piece = np.full(size, -1, dtype=np.int32)  # the piece that a state spells
        self.length = np.zeros(size, dtype=np.int32)
        self.score = np.zeros(size)
        self.link = np.zeros(size, dtype=np.int32)  # the next shorter state that spells a piece; 0 for none
        for state, n in ends.items():
            self.piece[state], self.length[state], self.score[state] = ids[n], len(keys[n]), scores[n]
        fail = np.zeros(size, dtype=np.int32)
        for byte, to in children[0].items():
            self.goto[0, byte] = to
        queue = list(children[0].values())
        for state in queue:
            back = fail[state]
            self.link[state] = back if self.piece[back] >= 0 else self.link[back]
            self.goto[state] = self.goto[back]
            for byte, to in children[state].items():
                fail[to] = self.goto[back, byte]
                self.goto[state, byte] = to
                queue.append(to)

    def solve(self, segments: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of the best segmentation of each segment; segments of like length are stepped together."""
        out: list[tuple[int, ...]] = [()] * len(segments)
        order = sorted(range(len(segments)), key=lambda k: -len(segments[k]))
        at = 0
        while at < len(order):
            longest = max(1, len(segments[order[at]]))
            rows = max(1, min(20_000, 1_000_000 // longest))
            part = [k for k in order[at : at + rows] if 2 * len(segments[k]) >= longest]
            for k, ids in zip(part, self._solve([segments[k] for k in part])):
                out[k] = ids
            at += len(part)
        return out

    def _solve(self, segments: list[bytes]) -> list[tuple[int, ...]]:
        n, sizes = len(segments), np.array([len(s) for s in segments])
        width = int(sizes.max())
        text = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in segments), dtype=np.uint8).reshape(n, width)
        lead = np.where(text < 0x80, 1, np.where(text < 0xC0, 0, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, np.where(text < 0xF8, 4, 1)))))
        closes = np.zeros((n, width), dtype=np.int8)  # length of the character that ends here, else 0
        row, col = np.nonzero(lead)
        last = np.minimum(col + lead[row, col] - 1, width - 1)
        closes[row, last] = lead[row, col]
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        via = np.full((n, width + 1), SPELT, dtype=np.int32)
        state = np.zeros(n, dtype=np.int32)
        for t in range(width):
            m = int(np.searchsorted(-sizes, -t, side="left"))  # segments longer than t come first
            state = self.goto[state[:m], text[:m, t]]
            rows = np.arange(m)
            char = closes[:m, t]
            whole = np.zeros(m, dtype=bool)  # is the character a piece by itself?
            on = np.where(self.piece[state] >= 0, state, self.link[state])
            live = np.flatnonzero(on)
            while len(live):
                s = on[live]
                size = self.length[s]
                reach = best[live, t + 1 - size] + self.score[s]
                whole[live] |= size == char[live]
                better = reach > best[live, t + 1]
                won = live[better]
                best[won, t + 1] = reach[better]
                via[won, t + 1] = s[better]
                on[live] = self.link[s]
                live = live[on[live] > 0]
            spelt = rows[(char > 0) & ~whole]
            if len(spelt):
                reach = best[spelt, t + 1 - char[spelt]] + self.spell
                won = spelt[reach > best[spelt, t + 1]]
                best[won, t + 1] = reach[reach > best[spelt, t + 1]]
                via[won, t + 1] = SPELT
        place = sizes.copy()
        rows, found = [], []
        live = np.flatnonzero(place)
        while len(live):  # from the ends back
            how = via[live, place[live]]
            spelt = how == SPELT
            byte = text[live, place[live] - 1]
            found.append(np.where(spelt, self.byte_id[byte], self.piece[np.maximum(how, 0)]))
            rows.append(live)
            place[live] -= np.where(spelt, 1, self.length[np.maximum(how, 0)])
            live = live[place[live] > 0]
        if not rows:
            return [()] * n
        row, ids = np.concatenate(rows)[::-1], np.concatenate(found)[::-1]
        turn = np.argsort(row, kind="stable")
        ids, ends = ids[turn].tolist(), np.cumsum(np.bincount(row, minlength=n)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def segments(self, text: str | None) -> list[bytes]:
        b = raw(text)
        if not b:
            return []
        b = b" " + b.replace(SPACE, LITERAL)
        return _SEGMENT.findall(b) if self.cuts else [b]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.segments(t) for t in texts]
        if len(self.known) > KEPT_SEGMENTS:
            self.known.clear()
        known = self.known
        new = list({s for own in cut for s in own if s not in known})
        known.update(zip(new, self.solve([s.replace(b" ", SPACE) for s in new])))
        out = []
        for own in cut:
            ids: list[int] = []
            for s in own:
                ids += known[s]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        return b"".join([surface[k] for k in ids]).decode("utf-8", "surrogatepass")[1:]


_built: dict[str, Pieces] = {}


def built(model: bytes) -> Pieces:
    """The codec of a model, built once in each Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _built:
        _built[key] = Pieces(model)
    return _built[key]


def model_bytes(path: str = MODEL, limit: int = 64 << 20) -> bytes:
    """A model file, read where the driver runs; its size is checked, since every task gets it."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    return data


def encoded(df: DataFrame, text: str = "text", path: str = MODEL, out: str = "pieces") -> DataFrame:
    """The rows of `df` with the ids of their pieces, an array of ints."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(ids, dtype=np.int32) for ids in built(model.value).encode(texts.tolist())], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<int>")(F.col(text).cast("string")))


def decoded(df: DataFrame, ids: str = "pieces", path: str = MODEL, out: str = "decoded") -> DataFrame:
    """The rows of `df` with the text that their ids spell."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(["" if r is None else built(model.value).decode(list(r)) for r in rows], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(ids)))


def digests(df: DataFrame, text: str = "text", path: str = MODEL, out: str = "digest") -> DataFrame:
    """The rows of `df` with n_pieces, the SHA-256 of the ids (little-endian, 4 bytes each) and whether decoding gives the text.

    For tables whose ids aren't kept: they never leave the task.
    """
    model = df.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(texts: pd.Series) -> pd.DataFrame:
        codec = built(model.value)
        own = texts.tolist()
        rows = []
        for text, ids in zip(own, codec.encode(own)):
            packed = np.array(ids, dtype="<i4").tobytes()
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), codec.decode(ids) == (text or "")))
        return pd.DataFrame(rows, columns=["n_pieces", "pieces_sha256", "exact"])

    return df.withColumn(out, F.pandas_udf(run, "n_pieces long, pieces_sha256 string, exact boolean")(F.col(text).cast("string")))
