"""SentencePiece encoding and decoding as shortest paths of weighted transducers.

A model file is compiled once into arc tables:

* the normaliser: from its start state the longest arc of the character map is taken, every other character
  is its own; a blank's arc writes the mark U+2581, and one is written before the text;
* the pieces: a tree of arcs by character, whose final states write a piece;
* byte fallback: an arc for each character without a piece, which writes the pieces of its bytes.

Composed with a normalised text they give a lattice. Its states are pairs of a position and the piece that
ends there, and the tropical semiring (min, +) weighs its paths: each state's arcs are walked through the
tables and relax the states that they reach.

* Unigram models: an arc weighs minus its piece's score.
* BPE models: an arc weighs 0 where its piece may follow the state's piece and infinity otherwise.
  Two pieces may follow each other when merging their joined characters by rising rank gives those two. A
  segmentation whose neighbours all may follow each other is the one that merging the whole text
  gives, and each prefix has exactly one, so one state per position is ever finite.

Texts are cut where no piece reaches across, and paths of the parts are kept in a bounded table, from
which a full one keeps what was used most. Parts that aren't there wait and are composed and relaxed together
(``paths``): one position of all of them at a time, in arrays. Long parts go one by one (``lattice``).
"""

from __future__ import annotations

import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleanwork.llm import textbytes as tb
from gleanwork.llm.shared import without

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Parts and pairs of pieces that a process remembers. When full, the table of parts keeps at most AGAIN of those that were
#: used more than once, the most used first, and that of pairs is emptied. Memory only: ids don't depend on them.
KEPT_PARTS, AGAIN, KEPT_PAIRS = 200_000, 60_000, 400_000
#: Parts relaxed together, and the characters of the longest of them.
TOGETHER, LONG = 4096, 64
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Weight of a character without a piece, beyond the worst piece (of a unigram model).
UNKNOWN_WEIGHT = 10.0
INFINITY = float("inf")


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
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
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """The normaliser's replacements. The blob is a double array of units (after its size in bytes) over the UTF-8
    of what is replaced, whose values are places of zero-ended replacements behind it."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts, out = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size]), blob[4 + size :], {}
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    todo = [(offset(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        for byte in range(1, 256):
            to = at ^ byte
            if to < len(units) and units[to] & 0x800000FF == byte:
                below = to ^ offset(units[to])
                if units[to] >> 8 & 1:
                    place = units[below] & 0x7FFFFFFF
                    out[key + bytes([byte])] = texts[place : texts.index(b"\0", place)]
                todo.append((below, key + bytes([byte])))
    return out


#: Where no arc leads: no arcs, no piece.
NOWHERE: tuple[dict, int] = ({}, -1)


def _tree(ids: dict[str, int]) -> dict[str, tuple[dict, int]]:
    """Arcs of the start state by character: each leads to a state's arcs and the piece that it writes, or -1."""
    start: dict = {}
    for piece in sorted(ids, key=len):  # a state is made before those behind it
        arcs = start
        for char in piece[:-1]:
            arcs = arcs.setdefault(char, ({}, -1))[0]
        arcs[piece[-1]] = (arcs.get(piece[-1], NOWHERE)[0] or {}, ids[piece])
    return start


class Table:
    """Numbers from 0 by keys from 0: open addressing in arrays of ``1 << bits`` slots, never to be full."""

    def __init__(self, bits: int):
        self.keys, self.values = np.full(1 << bits, -1), np.zeros(1 << bits, np.int32)
        self.shift, self.n = np.uint64(64 - bits), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; -1 where there is none."""
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        at, keys = at[todo], keys[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            here = found == keys
            out[todo[here]] = self.values[at[here]]
            more = ~here & (found >= 0)
            todo, at, keys = todo[more], at[more], keys[more]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys that aren't there."""
        self.n += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            at, keys, values = (at[~here] + 1) & (len(self.keys) - 1), keys[~here], values[~here]

    def clear(self) -> None:
        self.keys.fill(-1)
        self.n = 0


class Places(dict):
    """Places of parts in the table of paths. One that isn't there gets the next place, and what ``spell`` makes of
    it waits for its path."""

    def __init__(self, machine: Transducer, spell, items=()):
        super().__init__(items)
        self.machine, self.spell = machine, spell

    def __missing__(self, part: str) -> int:
        m = self.machine
        self[part] = at = len(m.ends_of_paths) + len(m.ends_of_waiting)
        m.waiting += self.spell(part)
        m.ends_of_waiting.append(len(m.waiting))
        return at


def _as_word(word: str) -> tuple[str, ...]:
    """Normalised parts of a word as it stands in a text, a line's first one with the line end."""
    return ("\n", word[1:]) if word[:1] == "\n" else (MARK + word,)


def _as_part(part: str) -> tuple[str, ...]:
    return (part,)


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes, kind: int | None = None):
        self.pieces, self.scores, self.kinds, self.map = [], [], [], {}
        self.type, self.prefix, self.trim = UNIGRAM, True, True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                self.map = character_map(f.get(2, b""))
                self.prefix, self.trim = bool(f.get(3, 1)), bool(f.get(4, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.rank = {p: self.scores[i] for p, i in self.ids.items()}
        self.own = {p: p for p in self.ids}
        self.type = kind or self.type
        self.arcs = _tree(self.ids)
        self.gains = self.type == UNIGRAM and any(s > 0 for s in self.scores)
        self.longest_mapped = max(map(len, self.map), default=0)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.worst = min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0)
        self.cuts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)
        self.after: dict[str, dict[str, bool]] = {}  # whether a piece may follow another
        self.n_pairs = 0
        raw = [self._bytes(i) for i in range(len(self.pieces))]
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self._number()
        self._empty()

    def _empty(self) -> None:
        self.known = Places(self, _as_word)  # by words as they stand in a text
        self.known_parts = Places(self, _as_part)
        self.waiting, self.ends_of_waiting = [], []  # normalised parts whose paths are not known yet
        self.ids_of_paths, self.ends_of_paths = array("i"), array("q")
        self.uses = np.zeros(0, np.int64)

    def _number(self) -> None:
        """The tree in arrays: states from 1 on (0 is the start) by state and class of character. What an arc writes has
        a symbol: 0 nothing yet, then the pieces, then characters without a piece."""
        chars = sorted({c for p in self.ids for c in p})
        self.classes = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_classes = len(chars) + 1
        cls = {c: k for k, c in enumerate(chars, 1)}
        trees, writes, keys = [self.arcs], [-1], []
        for state, arcs in enumerate(trees):  # grows
            for char, (below, piece_id) in arcs.items():
                keys.append(state * self.n_classes + cls[char])
                trees.append(below)
                writes.append(piece_id)
        self.steps = Table(max(4, (4 * len(keys)).bit_length()))
        self.steps.put(np.array(keys, np.int64), np.arange(1, len(trees)))
        self.writes, self.inner = np.array(writes, np.int64), np.array([bool(t) for t in trees])
        self.first = self.steps.get(np.arange(self.n_classes))
        self.n_symbols = 1 + len(self.pieces) + 0x110000
        self.pairs = Table(20)  # whether a symbol may follow another
        self.costs = np.array([UNKNOWN_WEIGHT - self.worst, *(-s for s in self.scores)])  # by symbol, 0 for those without a piece

    def _bytes(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        return b"" if kind == CONTROL else bytes([int(piece[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def _forget(self) -> None:
        """Keep the parts that were used most; what they were used before counts half from now on."""
        uses = self.uses
        keep = np.flatnonzero(uses > 1)
        keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[:AGAIN]])
        ids, n = self._gather(keep, np.arange(len(keep) + 1))
        at = np.full(len(uses), -1)
        at[keep] = np.arange(len(keep))
        new = at.tolist()
        self.known, self.known_parts = (Places(self, t.spell, ((part, new[i]) for part, i in t.items() if new[i] >= 0)) for t in (self.known, self.known_parts))
        self.ids_of_paths, self.ends_of_paths, self.uses = array("i", ids.tobytes()), array("q", np.cumsum(n).tobytes()), uses[keep] // 2

    def normalise(self, text: str) -> str:
        if self.map:
            raw, out, at = text.encode(), [], 0
            while at < len(raw):
                for size in range(min(self.longest_mapped, len(raw) - at), 0, -1):
                    new = self.map.get(raw[at : at + size])
                    if new is not None:
                        break
                else:
                    size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                    new = raw[at : at + size]
                out.append(new)
                at += size
            text = b"".join(out).decode("utf-8", "replace")
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging a short text's characters gives: best score first, then leftmost."""
        parts, rank = list(text), self.rank.get
        joined = [rank(a + b) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while True:
            best, at = None, -1
            for i, score in enumerate(joined):
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at])
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1])

    def follows(self, one: str, two: str) -> bool:
        if self.n_pairs >= KEPT_PAIRS:
            self.after.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        two = self.own.get(two, two)  # no copy of a piece for each before it
        found = self.after.setdefault(one, {})[two] = self.merged(one + two) == ([one, two] if one else [two])
        return found

    def lattice(self, part: str) -> list[str]:
        """Pieces of the shortest path through the composition with a normalised part.

        Of equal paths the one whose last piece is longest stands, at every position."""
        after, n, bpe, gains = self.after, len(part), self.type == BPE, self.gains
        weight, back = [0.0] + [INFINITY] * n, [0] * (n + 1)
        last, nothing = [""] * (n + 1), {}
        for at in range(n):
            here = weight[at]
            if here == INFINITY:
                continue
            one = last[at]
            known = after.get(one, nothing) if bpe else nothing
            arcs, end = self.arcs, at
            for char in part[at:]:
                end += 1
                arcs, piece_id = arcs.get(char, NOWHERE)
                if (piece_id >= 0 or end == at + 1) and (gains or here < weight[end]):  # else no arc weighs less than 0
                    piece = part[at:end]
                    if bpe:
                        ok = known.get(piece)
                        if ok is None:
                            ok = self.follows(one, piece)
                            known = after[one]
                        w = here if ok else INFINITY
                    else:
                        w = here + (-self.scores[piece_id] if piece_id >= 0 else UNKNOWN_WEIGHT - self.worst)
                    if w < weight[end]:
                        weight[end], last[end], back[end] = w, piece, at
                if not arcs:
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def path(self, part: str) -> list[int]:
        """Ids of the shortest path of a normalised part."""
        ids = self.ids
        return [i for piece in self.lattice(part) for i in ([ids[piece]] if piece in ids else self._fallback(piece))]

    def _symbol(self, symbol: int) -> str:
        return "" if not symbol else self.pieces[symbol - 1] if symbol <= len(self.pieces) else chr(symbol - 1 - len(self.pieces))

    def _may_follow(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """``follows`` of symbols."""
        keys = one * self.n_symbols + two
        out = self.pairs.get(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            asked, which = np.unique(keys[new], return_inverse=True)
            found = []
            for a, b in zip(*(x.tolist() for x in np.divmod(asked, self.n_symbols)), strict=True):
                a, b = self._symbol(a), self._symbol(b)
                found.append(self.merged(a + b) == ([a, b] if a else [b]))
            if self.pairs.n + len(asked) > KEPT_PAIRS:
                self.pairs.clear()
            self.pairs.put(asked, np.array(found, np.int32))
            out[new] = np.array(found, np.int32)[which]
        return out > 0

    def paths(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the shortest paths of normalised parts one after another, and their number for each part.

        The same paths as ``path`` gives. A state's number is its character's place plus its part's."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        if (size > LONG).any():
            short = size <= LONG
            some, n_short = self.paths([p for p in parts if len(p) <= LONG])
            long = [self.path(p) for p in parts if len(p) > LONG]
            n = np.empty(len(parts), np.int64)
            n[short], n[~short] = n_short, [len(ids) for ids in long]
            out, which = np.empty(n.sum(), np.int32), np.repeat(short, n)
            out[which], out[~which] = some, [i for ids in long for i in ids]
            return out, n
        code = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        char, count, own = self.classes[code], len(code), np.arange(len(parts))
        ends = np.cumsum(size)
        starts = ends - size
        part, end = np.repeat(own, size), np.repeat(ends, size)
        # composition: the arcs of all states, walked through the tree by one more character at a time
        at, state = np.arange(count), self.first[char]
        piece = np.where(state < 0, -1, self.writes[state])
        arcs = [(at, at + 1, np.where(piece < 0, len(self.pieces) + code, piece) + 1)]
        for depth in range(1, LONG):
            more = (state >= 0) & self.inner[state] & (at + depth < end[at])
            at, state = at[more], state[more].astype(np.int64)
            if not len(at):
                break
            state = self.steps.get(state * self.n_classes + char[at + depth])
            piece = np.where(state < 0, -1, self.writes[state])
            full = piece >= 0
            arcs.append((at[full], at[full] + depth + 1, piece[full] + 1))
        before, behind, symbol = (np.concatenate(x) for x in zip(*arcs, strict=True))
        step = (before - starts[part[before]]).astype(np.uint8)
        order = np.argsort(step, kind="stable")
        before, behind, symbol = before[order], behind[order], symbol[order]
        behind += part[before]
        before += part[before]
        # relaxation: the arcs that leave the parts' states at one position, together
        starts, ends = starts + own, ends + own
        last, back = np.full(count + len(parts), -1), np.repeat(starts, size + 1)
        last[starts] = 0
        weight = np.where(last < 0, INFINITY, 0.0)
        upto = np.cumsum(np.bincount(step)).tolist()
        for lo, hi in zip([0, *upto], upto):  # noqa: B905
            a, b, s = before[lo:hi], behind[lo:hi], symbol[lo:hi]
            if self.type == BPE:
                open_ = (last[b] < 0) & (last[a] >= 0)
                a, b, s = a[open_], b[open_], s[open_]
                better = self._may_follow(last[a], s)
                a, b, s = a[better], b[better], s[better]
            else:
                w = weight[a] + self.costs[np.where(s > len(self.pieces), 0, s)]
                better = w < weight[b]
                a, b, s = a[better], b[better], s[better]
                weight[b] = w[better]
            last[b], back[b] = s, a
        on, at, first = np.zeros(len(last), bool), ends, starts
        while len(at):
            on[at] = True
            more = at != first
            at, first = back[at[more]], first[more]
        at = np.flatnonzero(on & (last > 0))
        return self._spelled(last[at] - 1, np.repeat(own, size + 1)[at], len(parts))

    def _spelled(self, ids: np.ndarray, part: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the bytes of characters without a piece, and their number for each part."""
        bare = ids >= len(self.pieces)
        if bare.any():
            codes, which = np.unique(ids[bare] - len(self.pieces), return_inverse=True)
            spelled = [self._fallback(chr(c)) for c in codes.tolist()]
            n = np.ones(len(ids), np.int64)
            n[bare] = np.array([len(x) for x in spelled])[which]
            ids, part, bare = np.repeat(ids, n), np.repeat(part, n), np.repeat(bare, n)
            ids[bare] = [i for k in which.tolist() for i in spelled[k]]
        return ids.astype(np.int32), np.bincount(part, minlength=n_parts)

    def _fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def _parts(self, text: str) -> list[str]:
        """The normalised text's parts, between which no piece reaches."""
        import re

        text = self.normalise(text)
        return re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n", text) if self.cuts else [text] * bool(text)

    def indexes(self, text: str) -> list[int]:
        """Positions in ``paths`` of the text's parts."""
        if self.cuts and self.prefix and not self.trim and not self.map:
            # a word stands for itself with a mark before it, a line's first word for itself with the line end
            flat = text.replace("\n", " \n")
            if flat and flat[0] != " " and flat[-1] != " " and "  " not in flat and MARK not in flat:
                return list(map(self.known.__getitem__, flat.split(" ")))
        return list(map(self.known_parts.__getitem__, self._parts(text)))

    def _learn(self) -> None:
        """Paths of the parts that wait."""
        for lo in range(0, len(self.ends_of_waiting), TOGETHER):
            ends = [lo and self.ends_of_waiting[lo - 1], *self.ends_of_waiting[lo : lo + TOGETHER]]
            ids, n = self.paths(self.waiting[ends[0] : ends[-1]])
            upto = len(self.ids_of_paths) + np.cumsum(n)
            self.ids_of_paths.frombytes(ids.tobytes())
            self.ends_of_paths.frombytes(upto[np.array(ends[1:]) - ends[0] - 1].tobytes())
        self.waiting, self.ends_of_waiting = [], []

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and their offsets."""
        out, sizes, at, bounds = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [], [0]

        def settle() -> None:
            self._learn()
            used = np.array(at, np.int64)
            ids, n = self._gather(used, np.array(bounds))
            uses = np.bincount(used, minlength=len(self.ends_of_paths))
            uses[: len(self.uses)] += self.uses
            self.uses = uses
            out.append(ids)
            sizes.append(n)
            at.clear()
            bounds[:] = [0]

        try:
            for text in texts:
                if len(self.ends_of_paths) + len(self.ends_of_waiting) >= KEPT_PARTS:
                    settle()
                    self._forget()
                at += self.indexes(text)
                bounds.append(len(at))
            settle()
        except BaseException:
            self._empty()  # places without paths
            raise
        return np.concatenate(out), np.cumsum(np.concatenate(sizes))

    def _gather(self, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the paths ``at``, and their number between each two bounds."""
        # views of the tables; they are gone before the tables grow again
        ends, flat = np.frombuffer(self.ends_of_paths or array("q", [0]), np.int64), np.frombuffer(self.ids_of_paths or array("i", [0]), np.int32)
        starts = np.where(at > 0, ends[at - 1], 0)
        n = ends[at] - starts
        upto = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(starts - upto[:-1], n) + np.arange(upto[-1])
        return flat[where], np.diff(upto[bounds])

    def decode_all(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the decoded texts one after another, and their offsets. The blank that the
        normaliser puts before a text is taken away again."""
        sizes = self.lengths[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        at = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        out, bounds = self.flat[at], ends[offs]
        if self.prefix:
            full = bounds[:-1] < bounds[1:]
            first = bounds[:-1][full]
            drop = first[out[first] == 32]
            keep = np.ones(len(out), bool)
            keep[drop] = False
            bounds = bounds - np.searchsorted(drop, bounds)
            out = out[keep]
        return out, bounds

    def decode(self, ids: list[int]) -> str:
        out, _ = self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))
        return out.tobytes().decode("utf-8", "replace")


_COMPILED: dict[tuple, Transducer] = {}


def compiled(model: bytes, kind: int | None = None) -> Transducer:
    """One transducer of a model in each process."""
    key = (hash(model), kind)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(model, kind)
    return _COMPILED[key]


def tokenize(docs: DataFrame, model_path: str = MODEL, kind: int | None = None) -> DataFrame:
    """Every row of ``docs`` (with text) with ids, n_ids and round_trip (whether the ids decode to
    the text), which replace columns of these names. A null text is empty and has no ids. A text with the mark U+2581 itself, or blanks
    that a trimming normaliser drops, does not come back. ``kind`` reads the pieces as UNIGRAM or BPE instead of
    what the file says. The model goes to executors by value."""
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = without(docs, "ids", "n_ids", "round_trip")
    names = [*docs.columns, "ids", "n_ids", "round_trip"]

    def run(batches):
        machine = compiled(sent.value, kind)
        for batch in batches:
            buf, offs = tb.column(batch.column("text"))
            for lo, hi, b, o in tb.pieces(buf, offs):
                raw = b.tobytes()
                ids, bounds = machine.encode_all([raw[s:e].decode() for s, e in zip(o[:-1], o[1:], strict=True)])
                back, ends = machine.decode_all(ids, bounds)
                same = np.diff(ends) == np.diff(o)
                if len(back) == len(b) and same.all():
                    wrong = np.flatnonzero(back != b)
                    same[np.searchsorted(o, wrong, "right") - 1] = False
                else:
                    same = np.array([back[ends[i] : ends[i + 1]].tobytes() == raw[o[i] : o[i + 1]] for i in range(hi - lo)], bool)
                made = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(np.diff(bounds)), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *made], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, ids array<int>, n_ids long, round_trip boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces as a unigram model: the path of the least sum of ranks."""
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), kind=UNIGRAM).drop("text")
