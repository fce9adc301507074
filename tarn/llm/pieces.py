"""SentencePiece encoding with source offsets, and decoding.

A text is normalised by longest prefixes: the model's compiled character map
is a trie of source strings; at each place the longest one that fits is
replaced, and every character of the result records where its source ends.
The model's ranked merges then put characters together to pieces, and each
piece's span is projected to a span of bytes in the source.

Both steps are done once per distinct word of a worker.  A word begins at a run
of blanks; cutting there is exact when no source string of the map and no piece
of the vocabulary crosses such a place, which ``PieceModel`` reads off the
model (a model that fails this is applied to whole texts).  Inside a word a
place between two characters that are neighbours in no piece is a cut as well.
The new words of a slice of texts are merged together: every round ranks the
neighbours that changed, and each part of a word merges its first pair of the
best rank.  A word's pieces are kept as (id, end in the word's bytes), and the
spans of a slice of texts follow by running sums.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import held, lean, map_texts, small_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
#: Bytes of words and pieces a worker keeps, and what an entry costs beside them.
CACHE_BYTES = 64_000_000
ENTRY_BYTES = 180
#: Longer parts of words look for their best pair by a heap, one by one.
LONG_PART = 64
BLANK = "▁"
#: Kinds of pieces, model type and default texts as the model format has them: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
UNKNOWN_TEXT = " ⁇ "
#: Marks of the first and the last word of a text where they differ from others; no text can hold these.
FIRST, FINAL = "\ud800", "\udc00"
POINTS = 0x110000
NEVER = np.iinfo(np.int64).max


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a message in wire format: numbers as they are, the rest as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


class CharMap:
    """A compiled character map: a double-array trie of source strings, then their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return unit >> 10 << (8 if unit >> 9 & 1 else 0)

    def _replacement(self, at: int) -> bytes:
        value = self.units[at] & 0x7FFFFFFF
        return self.texts[value : self.texts.index(b"\0", value)]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest source string at a place, if any."""
        if not self.units:
            return None
        node, best = self._jump(self.units[0]), None
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != raw[k]:
                break
            unit = self.units[node]
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                best = k + 1 - at, node
        return best and (best[0], self._replacement(best[1]))

    def entries(self) -> Iterator[tuple[str, str]]:
        """All (source string, replacement)."""
        todo = [(self._jump(self.units[0]), b"")] if self.units else []
        while todo:
            node, key = todo.pop()
            for byte in range(1, 256):
                to = node ^ byte
                if to < len(self.units) and self.units[to] & 0x800000FF == byte:
                    further = to ^ self._jump(self.units[to])
                    if self.units[to] >> 8 & 1:
                        yield (key + bytes([byte])).decode("utf-8"), self._replacement(further).decode("utf-8")
                    todo.append((further, key + bytes([byte])))


class PieceModel:
    """All that the model file says, and the pieces of the words met so far, bounded in bytes."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normal: dict = {}
        for field, value in message(raw):
            if field == 1:
                p = dict(message(value))
                self.pieces.append(p[1].decode("utf-8"))
                scores.append(struct.unpack("<f", p.get(2, bytes(4)))[0])
                self.kinds.append(p.get(3, NORMAL))
            elif field == 2:
                trainer = dict(message(value))
            elif field == 3:
                normal = dict(message(value))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only merge models without symbols of the user's, with blanks before words")
        self.unknown_text = trainer.get(44, UNKNOWN_TEXT.encode()).decode("utf-8")
        self.falls_back = bool(trainer.get(35, 0))
        self.map = CharMap(normal.get(2) or bytes(4))
        self.dummy, self.squeeze, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        self.unknown = self.kinds.index(UNKNOWN)
        singles = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.bytes = np.array([singles.get(b, self.unknown) for b in range(256)], dtype=np.int64)
        best = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        #: piece -> (rank, id); equal scores have equal ranks
        self.rank = {p: (best[s], i) for i, (p, s, k) in enumerate(zip(self.pieces, scores, self.kinds, strict=True)) if k == NORMAL}
        self._pair_table()
        self.split = self._splitter(list(self.map.entries()))
        self._forget()

    def _pair_table(self) -> None:
        """Merges as sorted numbers of (left symbol, right symbol): a symbol is a piece's id, or a character beyond all ids."""
        n = len(self.pieces)
        self.wide = n + POINTS
        self.symbol = np.arange(n, n + POINTS, dtype=np.int64)
        for p, (_, i) in self.rank.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        made: dict[int, tuple[int, int]] = {}
        self.neighbours: set[str] = set()
        for p, (rank, i) in self.rank.items():
            self.neighbours.update(p[k : k + 2] for k in range(len(p) - 1))
            for k in range(1, len(p)):
                sides = [self.rank[x][1] if x in self.rank else n + ord(x) if len(x) == 1 else None for x in (p[:k], p[k:])]
                if None not in sides:
                    made[sides[0] * self.wide + sides[1]] = rank, i
        self.pairs = np.array(sorted(made), dtype=np.int64)
        self.merge = np.array([made[k] for k in self.pairs.tolist()], dtype=np.int64).reshape(-1, 2)
        self.near = np.array(sorted(ord(x[0]) * POINTS + ord(x[1]) for x in self.neighbours), dtype=np.int64)

    def _forget(self) -> None:
        """Drop the words met so far."""
        self.number: dict[str, int] = _Numbers()
        self.ids = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(0, dtype=np.int32)
        self.counts = np.zeros(0, dtype=np.int64)
        self.widths = np.zeros(0, dtype=np.int64)

    @property
    def kept(self) -> int:
        return ENTRY_BYTES * len(self.number) + 8 * len(self.ids)

    def _splitter(self, entries: list[tuple[str, str]]) -> Callable[[str], list[str]]:
        """Cuts texts into words before blanks, where neither the map nor a piece can reach across.

        A *blank* is a character that always turns into a blank; before it
        must stand one that cannot end in a blank or vanish (*soft* ones can).
        """
        blanks = {" ", BLANK} | {source for source, to in entries if len(source) == 1 and to == " "}
        blanks -= {source[0] for source, to in entries if to != " " or len(source) > 1}
        soft = {c for source, to in entries if not to or " " in to or BLANK in to for c in source} - blanks

        def kind(chars: set[str], no: str = "") -> str:
            return f"[{no}{re.escape(''.join(sorted(chars)))}]"

        if not blanks or any(n[0] != BLANK and n[1] == BLANK for n in self.neighbours):
            return re.compile(r"[\s\S]+").findall
        cut = re.compile(f"(?<={kind(blanks | soft, '^')})(?={kind(blanks)})")
        if any(cut.search(source) for source, _ in entries):
            return re.compile(r"[\s\S]+").findall
        if not soft:
            return re.compile(f"{kind(blanks)}+{kind(blanks, '^')}*|{kind(blanks, '^')}+").findall
        return lambda text: cut.split(text) if text else []

    def normalised(self, raw: bytes, first: bool = True, last: bool = True) -> tuple[str, list[int]]:
        """(text, alignment): the source byte each of its bytes comes from, and one more for the end.

        ``first`` and ``last`` say whether the bytes begin and end a text.
        """
        blank = BLANK.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            head = bool(first and self.dummy and raw)
            wide = [[i] * (len(blank) if byte == 0x20 else 1) for i, byte in enumerate(raw)]
            return (b" " * head + raw).replace(b" ", blank).decode("utf-8"), [*([0] * len(blank) * head), *chain.from_iterable(wide), len(raw)]
        out, source, at, n = bytearray(), [], 0, len(raw)

        def step() -> tuple[int, bytes]:
            found = self.map.longest(raw, at)
            if found:
                return found
            lead = raw[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return size, raw[at : at + size]

        if first and self.squeeze:
            while at < n and step()[1] == b" ":
                at += step()[0]
        if first and self.dummy and at < n:
            out += blank
            source += [at] * len(blank)
        after_blank = self.squeeze and first
        while at < n:
            size, to = step()
            if after_blank:
                to = to.lstrip(b" ")
            if to:
                made = to.replace(b" ", blank)
                out += made
                source += [at] * len(made)
                after_blank = to.endswith(b" ") and self.squeeze
            elif not self.squeeze:
                after_blank = False
            at += size
        if last and self.squeeze:
            while out.endswith(blank):
                del out[-len(blank) :]
                at = source[len(out)]
                del source[len(out) :]
        return out.decode("utf-8"), [*source, at]

    def _by_heap(self, symbols: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
        """(symbols, ends) after all merges of one part: always the pair of the best rank, leftmost first."""
        n = len(symbols)
        parts: list[int] = list(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                at = int(np.searchsorted(self.pairs, parts[a] * self.wide + parts[b]))
                if at < len(self.pairs) and self.pairs[at] == parts[a] * self.wide + parts[b]:
                    heapq.heappush(heap, (int(self.merge[at, 0]), a, parts[a], parts[b], int(self.merge[at, 1])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, left, right, to = heapq.heappop(heap)
            b = after[a]
            if parts[a] != left or b >= n or parts[b] != right:
                continue
            parts[a], parts[b] = to, -1
            ends[a] = ends[b]
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        stay = [i for i in range(n) if parts[i] >= 0]
        return [parts[i] for i in stay], [ends[i] for i in stay]

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; ``NEVER`` for those that do not merge."""
        wanted = left * self.wide + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        found = self.pairs[at] == wanted
        return np.where(found, self.merge[at, 0], NEVER), self.merge[at, 1]

    def _merged(self, symbols: np.ndarray, ends: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, ends, part) after all merges; ``part`` numbers the parts of words and goes up."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.bincount(part) if len(part) else part
        long = sizes[part] > LONG_PART if len(part) else np.zeros(0, dtype=bool)
        for which in np.unique(part[long]):
            mine = part == which
            s, e = self._by_heap(symbols[mine].tolist(), ends[mine].tolist())
            done.append((np.array(s, dtype=np.int64), np.array(e, dtype=np.int64), np.full(len(s), which)))
        symbols, ends, part = symbols[~long], ends[~long], part[~long]
        rank, to = np.full(len(part), NEVER), np.zeros(len(part), dtype=np.int64)
        pair = np.flatnonzero(part[:-1] == part[1:])
        rank[pair], to[pair] = self._ranked(symbols[pair], symbols[pair + 1])
        while len(part):
            heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(part))))
            open_ = best < NEVER
            if 2 * np.count_nonzero(open_) < len(part):
                done.append((symbols[~open_], ends[~open_], part[~open_]))
                symbols, ends, part, rank, to, best = (x[open_] for x in (symbols, ends, part, rank, to, best))
                if not len(part):
                    break
                open_ = np.ones(len(part), dtype=bool)
            at = np.flatnonzero((rank == best) & open_)
            at = at[np.concatenate(([True], part[at[1:]] != part[at[:-1]]))]
            symbols[at], ends[at] = to[at], ends[at + 1]
            follows = (at + 2 < len(part)) & (part[np.minimum(at + 2, len(part) - 1)] == part[at])
            stay = np.ones(len(part), dtype=bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, ends, part, rank, to = (x[stay] for x in (symbols, ends, part, rank, to))
            rank[moved] = NEVER
            right = moved[follows]
            rank[right], to[right] = self._ranked(symbols[right], symbols[right + 1])
            left = moved[(moved > 0) & (part[moved - 1] == part[moved])] - 1
            rank[left], to[left] = self._ranked(symbols[left], symbols[left + 1])
        if not done:
            return symbols, ends, part
        symbols, ends, part = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        return symbols[order], ends[order], part[order]

    def _characters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(normalised characters, end in the word's source bytes, word number, bytes of each word)."""
        if not self.map.units and not self.squeeze:
            flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
            word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
            first = flat == ord(FIRST)
            wide = np.where(first, 0, 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000))
            sums = np.cumsum(wide)
            widths = np.bincount(word, weights=wide, minlength=len(words)).astype(np.int64)
            ends = sums - (np.cumsum(widths) - widths)[word]
            return np.where(first | ((flat == 0x20) & self.escape), ord(BLANK if self.escape else " "), flat), ends, word, widths
        points, ends, per, widths = [], [], [], []
        for w in words:
            raw = w.strip(FIRST + FINAL).encode("utf-8")
            text, source = self.normalised(raw, w.startswith(FIRST), w.endswith(FINAL))
            points += map(ord, text)
            stops = np.cumsum([len(c.encode("utf-8")) for c in text])
            ends += [source[k] for k in stops]
            per.append(len(text))
            widths.append(len(raw))
        return np.array(points, dtype=np.int64), np.array(ends, dtype=np.int64), np.repeat(np.arange(len(words)), per), np.array(widths, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        """Keep the pieces of words not met before, in order."""
        points, ends, word, widths = self._characters(words)
        if len(points):
            both = points[:-1] * POINTS + points[1:]
            at = np.minimum(np.searchsorted(self.near, both), len(self.near) - 1)
            part = np.cumsum(np.concatenate(([0], (self.near[at] != both) | (word[1:] != word[:-1]))))
            of_part = word[np.concatenate(([True], part[1:] != part[:-1]))]
            symbols, ends, part = self._merged(self.symbol[points], ends, part)
            word = of_part[part]
        else:
            symbols = points
        counts = np.bincount(word, minlength=len(words))
        odd = symbols >= len(self.pieces)
        if odd.any():
            chars = symbols[odd] - len(self.pieces)
            if self.falls_back:
                size = np.ones(len(symbols), dtype=np.int64)
                size[odd] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
                begins = np.concatenate(([0], ends[:-1]))
                begins[np.concatenate(([True], word[1:] != word[:-1]))] = 0
                final = np.cumsum(size) - 1
                spread = np.repeat(begins, size)
                spread[final] = ends
                counts = np.bincount(np.repeat(word, size), minlength=len(words))
                wide = np.repeat(odd, size)
                symbols, ends = np.repeat(symbols, size), spread
                raw = np.frombuffer("".join(map(chr, chars.tolist())).encode("utf-8", "surrogatepass"), dtype=np.uint8)
                symbols[wide] = self.bytes[raw]
            else:
                symbols = np.where(odd, self.unknown, symbols)
        self.ids = np.concatenate([self.ids, symbols.astype(np.int32)])
        self.ends = np.concatenate([self.ends, ends.astype(np.int32)])
        self.counts = np.concatenate([self.counts, counts])
        self.widths = np.concatenate([self.widths, widths])

    def lead(self, text: str) -> int:
        """Bytes before the first piece's span: what a map or a squeezing model leaves out there."""
        plain = not self.map.units and not self.squeeze
        return 0 if plain else self.normalised(self.split(text)[0].encode("utf-8"), True, False)[1][0]

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends, offsets): all texts' pieces with their spans of source bytes; text d has those from offsets[d] on."""
        if self.kept >= CACHE_BYTES:
            self._forget()
        per, numbers = [], []
        for t in texts:
            words = self.split(t)
            if words and (self.dummy or self.squeeze):
                words[0] = FIRST + words[0]
            if words and self.squeeze:
                words[-1] += FINAL
            per.append(len(words))
            numbers.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words)))
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        word = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(self.counts)))[word]
        counts = self.counts[word]
        before = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(before[-1]) + np.repeat(starts - before[:-1], counts)
        ids = self.ids[at]
        # where each word begins in its text
        sums = np.concatenate(([0], np.cumsum(self.widths[word])))
        bounds = np.concatenate(([0], np.cumsum(per))).astype(np.int64)
        base = sums[:-1] - np.repeat(sums[bounds[:-1]], per)
        ends = self.ends[at] + np.repeat(base, counts)
        offsets = before[bounds]
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        some = np.flatnonzero(np.diff(offsets))
        begins[offsets[:-1][some]] = [self.lead(texts[d]) for d in some]
        if not self.falls_back and len(ids):
            # unknown neighbours in a text are one piece
            text = np.repeat(np.arange(len(texts)), np.diff(offsets))
            again = np.concatenate(([False], (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (text[1:] == text[:-1])))
            stop = np.append(~again[1:], True)
            offsets = np.concatenate(([0], np.cumsum(~again)))[offsets]
            ids, begins, ends = ids[~again], begins[~again], ends[stop]
        return ids, begins, ends, offsets


class _Numbers(dict):
    """Word -> number in order of first use; ``new`` lists the words met since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Decoder:
    """Ids back to text by the vocabulary's binary pieces."""

    def __init__(self, model: PieceModel):
        told = {UNKNOWN: model.unknown_text, CONTROL: ""}
        table = [bytes([int(p[3:5], 16)]) if k == BYTE else told.get(k, p).replace(BLANK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.table = pa.array(table, pa.binary())
        self.quiet = np.array([k == CONTROL for k in model.kinds])
        self.single = np.array([k == BYTE for k in model.kinds])
        self.blank = np.array([k == NORMAL and p.startswith(BLANK) for p, k in zip(model.pieces, model.kinds, strict=True)])
        self.drops = model.dummy or model.squeeze
        # after one of these a squeezing model drops the next one's blank as well
        self.alone = np.array([model.squeeze and p == BLANK for p in model.pieces])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """One text for each stretch of ids between offsets, in UTF-8."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.table.take(pa.array(ids))), b"").to_pylist()
        out = []
        for d, raw in enumerate(joined):
            mine = ids[offsets[d] : offsets[d + 1]]
            quiet = self.quiet[mine].any()
            gone = 0
            if self.drops:
                for i in mine[~self.quiet[mine]] if quiet else mine:
                    gone += int(self.blank[i])
                    if not (self.blank[i] and self.alone[i]):
                        break
            try:
                if quiet:
                    raise ValueError  # a control piece parts a run of byte pieces
                raw.decode("utf-8")
            except ValueError:
                raw = self._mended(mine)
            raw = raw[gone:]
            out.append(raw)
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        """Each byte of a run of byte pieces that belongs to no character becomes U+FFFD."""
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.single[i]:
                run += self.table[i].as_py()
                continue
            while run:
                size = next((k for k in (1, 2, 3, 4) if k <= len(run) and _whole(run[:k])), 0)
                out.append(run[:size] or "�".encode())
                run = run[size or 1 :]
            if i is not None:
                out.append(self.table[i].as_py())
        return b"".join(out)


def _whole(raw: bytes) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def _tools(path: str) -> tuple[PieceModel, Decoder]:
    def load() -> tuple[PieceModel, Decoder]:
        with open(path, "rb") as f:
            model = PieceModel(f.read())
        return model, Decoder(model)

    return held(f"pieces {path}", load)


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, ids, begins, ends) per row: the ids of a text's pieces and their spans of source bytes, end exclusive.

    Spans follow each other without gaps; of a character in byte pieces the
    last one has its span and the others are empty.  No begin or end ids.  A
    null or empty text has none.  Texts are taken whole and each by itself:
    repeated rows give repeated rows.
    """
    path = tokenizer_path(model)

    def work(texts: list[str | None]) -> dict:
        ids, begins, ends, offsets = _tools(path)[0].spans([t or "" for t in texts])
        return {"ids": _lists(ids, offsets), "begins": _lists(begins, offsets), "ends": _lists(ends, offsets)}

    return map_texts(df, [key], text, "ids array<int>, begins array<int>, ends array<int>", work)


def decode_pieces(df: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text) of (key, ids).  Null or empty ids give the empty text; an id outside the vocabulary is an error."""
    path = tokenizer_path(model)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            made = _tools(path)[1].decode(flat, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.binary()).cast(pa.string())], names=["key", "text"])

    small_batches(df.sparkSession)
    return rows.mapInArrow(lean(run), f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def piece_digests(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, spans_sha256) per row: digests of ``encode_pieces`` and ``decode_pieces``.

    ``ids_sha256`` is of the ids in decimal with commas, ``decoded_sha256`` of
    the decoded text in UTF-8, ``spans_sha256`` of begin and end of every piece
    as little-endian unsigned 32-bit integers.  The three steps run in one
    worker, so that ids and spans need not travel.
    """
    path = tokenizer_path(model)

    def work(texts: list[str | None]) -> dict:
        pieces, decoder = _tools(path)
        ids, begins, ends, offsets = pieces.spans([t or "" for t in texts])
        told = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids).cast(pa.string())), ",").to_pylist()
        both = np.stack([begins, ends], axis=1).astype("<u4")
        return {
            "n_tokens": np.diff(offsets),
            "ids_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in told],
            "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in decoder.decode(ids, offsets)],
            "spans_sha256": [hashlib.sha256(both[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
        }

    return map_texts(df, [key], text, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", work)
