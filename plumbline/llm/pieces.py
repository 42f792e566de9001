"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All words of a batch stand in one flat array of symbols. Each round finds the best pair rank
of every word, merges it in all words at once, and closes the gaps; a word is done when no
pair of it is in the vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from plumbline.llm.common import carried, sliced, text_of

SPACE = "▁"
CACHED_WORDS = 200_000
ROWS_AT_ONCE = 500
#: Words over this many characters are merged in segments; the result is the same, shorter ones would gain nothing.
LONG_WORD = 48
NONE = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """What the merges need of a model: read on the driver, sent to the executors."""

    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray
    first_byte: int

    @classmethod
    def read(cls, model_file: str) -> Vocabulary:
        """Reads a BPE model with byte fallback, an identity normaliser and a dummy prefix."""
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in ids])
        return cls([sp.id_to_piece(i) for i in ids], np.array([sp.get_score(i) for i in ids]), ~special, sp.piece_to_id("<0x00>"))


class Encoder:
    """Encodes words; those met before are kept, up to a bound."""

    def __init__(self, v: Vocabulary):
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in v.pieces]
        self.bytes_of[v.first_byte : v.first_byte + 256] = [bytes([b]) for b in range(256)]
        self.number = [str(i) for i in range(len(v.pieces))]
        own = [i for i in range(len(v.pieces)) if v.normal[i]]
        ids = {v.pieces[i]: i for i in own}
        self.first_byte = v.first_byte
        self.char = np.full(0x110000, -1, dtype=np.int32)
        levels = {s: k for k, s in enumerate(sorted({float(v.scores[i]) for i in own}, reverse=True))}
        keys, ranks, merged, joined = [], [], [], set()
        for i in own:
            piece = v.pieces[i]
            if len(piece) == 1:
                self.char[ord(piece)] = i
            else:
                joined.update(piece)
            for k in range(1, len(piece)):
                left, right = ids.get(piece[:k]), ids.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(levels[float(v.scores[i])])
                    merged.append(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece holds a space after other characters: words cannot be merged apart")
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, dtype=np.int32)[order], NONE)
        self.merged = np.append(np.array(merged, dtype=np.int32)[order], -1)
        # Pieces of spaces only share the worst score: those merges come last, and of equal ones the leftmost goes first, so they fold from the left.
        # Scores of single characters play no part: no merge makes one.
        made = [i for i in own if len(v.pieces[i]) > 1]
        runs = {i for i in made if set(v.pieces[i]) == {SPACE}}
        worst = max(levels.values())
        fold = runs and runs == {i for i in made if levels[float(v.scores[i])] == worst}
        fold = fold and not any(v.pieces[i].startswith(SPACE * 2) and i not in runs for i in own)
        self.fold_rank = worst if fold else NONE - 1
        # Where no piece holds two characters side by side, nothing merges across them and a word may end:
        # around a newline that no longer piece holds, and before signs that follow nothing but such signs.
        stop = "" if "\n" in joined else "\n"
        signs = {c for c in joined if not c.isalpha() and c != SPACE}
        beside = {(a, b) for i in own for a, b in pairwise(v.pieces[i]) if a != SPACE}
        while late := {b for a, b in beside if b in signs and a not in signs}:
            signs -= late
        # Inside a word too, a merge never crosses two characters that no piece holds side by side.
        touching = {ord(a) << 21 | ord(b) for i in own for a, b in pairwise(v.pieces[i])}
        self.touching = np.array([*sorted(touching), np.iinfo(np.int64).max], dtype=np.int64)
        held = re.escape("".join(sorted(signs)))
        rest = rf"[^ {held}{stop}]"
        lead = rf" +[{held}]*|[{held}]+" if held else " +"
        self.words = re.compile(rf"(?:{lead}){rest}*|{rest}+" + ("|\n" if stop else ""))
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE and -1 where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def merge(self, words: list[str]) -> list[list[int]]:
        """The symbols of each word after all merges; a character without a piece is -1 - its code point.

        A long word is merged in segments that no merge can cross, so it needs few rounds.
        """
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sym = self.char[points].astype(np.int64)
        sym = np.where(sym < 0, -1 - points, sym)
        lengths = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), lengths)
        opens = np.r_[True, owner[1:] != owner[:-1]]
        inside = np.flatnonzero(np.repeat(lengths > LONG_WORD, lengths) & ~opens)
        beside = points[inside - 1] << 21 | points[inside]
        opens[inside] = self.touching[np.searchsorted(self.touching, beside)] != beside
        word = np.cumsum(opens) - 1
        segments: list[list[int]] = [[] for _ in range(int(word[-1]) + 1)]
        rank, into = self._find(sym[:-1], sym[1:])
        rank = np.append(np.where(word[1:] == word[:-1], rank, NONE), NONE)
        into = np.append(into, -1)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            done = (best == NONE) | (best == self.fold_rank)
            for k in np.flatnonzero(done):
                own = sym[starts[k] : starts[k] + size[k]].tolist()
                segments[word[starts[k]]] = self._fold(own) if best[k] == self.fold_rank else own
            live = np.repeat(~done, size)
            at = np.flatnonzero(live & (rank == np.repeat(best, size)))
            if not len(at):
                break
            # In a row of overlapping pairs every other one, from the left.
            head = np.r_[True, np.diff(at) > 1]
            first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            at = self._in_order(at, sym, word, rank, into)
            sym[at] = into[at]
            live[at + 1] = False
            # Only the pairs that a merged symbol is part of have new ranks.
            moved = np.zeros(len(sym), dtype=bool)
            moved[at] = True
            sym, word, rank, into, moved = sym[live], word[live], rank[live], into[live], moved[live]
            new = moved.copy()
            new[:-1] |= moved[1:]
            pair = np.flatnonzero(new[:-1])
            rank[pair], into[pair] = self._find(sym[pair], sym[pair + 1])
            rank[pair[word[pair] != word[pair + 1]]] = NONE
            if len(rank):
                rank[-1] = NONE
        out: list[list[int]] = [[] for _ in words]
        for k, own in zip(owner[opens].tolist(), segments, strict=True):
            out[k] += own
        return out

    def _in_order(self, at, sym, word, rank, into):
        """Of a word's equal pairs all, if merging one by one could not put another first; else its leftmost."""
        own = word[at]
        lead = np.r_[True, own[1:] != own[:-1]]
        if lead.all():
            return at
        became = sym.copy()
        became[at] = into[at]
        # What stands to the left by then: the symbol, or the pair just merged there.
        back = np.maximum(at - 1, 0)
        after_pair = np.r_[False, (at[1:] - at[:-1] == 2) & (own[1:] == own[:-1])]
        left = np.where(after_pair, became[np.maximum(at - 2, 0)], sym[back])
        l_rank = np.where((at > 0) & (word[back] == own), self._find(left, into[at])[0], NONE)
        on = np.minimum(at + 2, len(sym) - 1)
        r_rank = np.where((at + 2 < len(sym)) & (word[on] == own), self._find(into[at], sym[on])[0], NONE)
        sooner = np.minimum(l_rank, r_rank) <= rank[at]
        spoiled = np.logical_or.reduceat(sooner, np.flatnonzero(lead))
        return at[lead | ~spoiled[np.cumsum(lead) - 1]]

    def _fold(self, symbols: list[int]) -> list[int]:
        """Merges the leftmost pair until there is none; a merged symbol meets its left neighbour first."""
        out: list[int] = []
        for s in symbols:
            while out and (both := self._pair(out[-1], s)) >= 0:
                out.pop()
                s = both
            out.append(s)
        return out

    def _pair(self, left: int, right: int) -> int:
        if left < 0 or right < 0:
            return -1
        at = int(np.searchsorted(self.keys, left << 32 | right))
        return int(self.merged[at]) if self.keys[at] == left << 32 | right else -1

    def _numbers(self, symbols: list[int]) -> list[int]:
        """Ids; a character without a piece becomes the bytes of its UTF-8 form."""
        if min(symbols) >= 0:
            return symbols
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out.extend(self.first_byte + b for b in chr(-1 - s).encode("utf-8", "replace"))
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces and bytes as text, each space mark as a space; the caller takes off the dummy prefix."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def split(self, text: str) -> list[str]:
        return self.words.findall(" " + text.replace(SPACE, " ")) if text else []

    def learn(self, words: set[str]) -> None:
        """Encodes the words not met before."""
        if len(self.ids) > CACHED_WORDS:
            self.ids, self.texts = {}, {}
        new = sorted(words.difference(self.ids))
        for word, symbols in zip(new, self.merge(new) if new else [], strict=True):
            ids = self._numbers(symbols)
            self.ids[word], self.texts[word] = ",".join(map(self.number.__getitem__, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        self.learn(set(words := self.split(text)))
        return [int(x) for w in words for x in self.ids[w].split(",")]


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """Adds ids (array of int) and decoded (string) to the columns in ``keep``, or with ``digests`` n_tokens and the SHA-256 of both.

    Null text counts as empty and gives no ids. Texts of any length are encoded whole; rows
    that repeat are encoded alike; an empty table gives an empty one. Columns not named in
    ``keep`` are not returned; one in it that is named as an added one is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model_file))
    added = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digests else [("ids", "array<int>"), ("decoded", "string")]
    types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
    kept = carried(docs, keep, (n for n, _ in added))
    width = len(kept.inner)
    inner = docs.select(*kept.inner, text_of(text).alias("_pl_text"))

    def run(batches):
        encoder = Encoder(sent.value)
        for batch in sliced(batches, ROWS_AT_ONCE):
            split = [encoder.split(t) for t in batch.column(width).to_pylist()]
            encoder.learn({w for words in split for w in words})
            rows = []
            for words in split:
                ids = ",".join(map(encoder.ids.__getitem__, words))
                decoded = "".join(map(encoder.texts.__getitem__, words))[1:]
                if digests:
                    rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    rows.append(([int(x) for x in ids.split(",")] if ids else [], decoded))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[*batch.schema.names[:width], *(n for n, _ in added)])

    return kept.named(inner.mapInArrow(run, ", ".join([*kept.schema, *(f"{n} {t}" for n, t in added)])))
