"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary file is a BPE model with byte fallback; its path is a parameter. A text is cut before every run of blanks
(no piece holds a blank after another character, which is checked), and each part is merged from an agenda ordered by
piece score, then position. With dropout each candidate merge, when it is taken from the agenda, is skipped if the keyed
hash of (seed, draw, piece, position) falls below the rate. The draw is a 64-bit hash of the document's id and the part's
number in it, so every occurrence of a word is skipped on its own, and every rerun gives the same ids.

Many parts are merged at once, step by step, on arrays: each step takes every part's best candidate. What a part becomes
depends only on which of its candidates are skipped. So parts of usual length are kept as trees: a node holds the
candidates that come up, and the ids, if no more are skipped; its child k those after its candidate k is skipped, too. An
occurrence walks down by its own hashes, and only nodes not seen before are merged.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import ship
from .common import U64, mix64, table
from .repeats import pieces

BLANK = "▁"
#: Stands for a blank sign of the text itself, which becomes bytes; no valid text holds a lone surrogate.
LITERAL = "\ud800"
#: Fills rows of ids up.
NONE = np.iinfo(np.int64).min
PART = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: The merge-dropout of the query.
RATE, SEED = 0.1, 13
#: Parts of more characters are merged each time: hardly any comes up twice with the same skips.
LONG = 24
#: Characters that are encoded at once, but for the last text of them.
CHARS = 3_200_000
#: Nodes that trees hold in a worker, some 200 bytes each.
CACHED = 900_000


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        if not any(sp.is_byte(i) for i in range(self.size)):
            raise ValueError("this vocabulary has no bytes to fall back on, so texts would not decode")
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.pieces if len(p) > 1):
            raise ValueError("a piece of this vocabulary holds a blank after another character")
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(self.size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.scores = np.array([sp.get_score(i) for i in range(self.size)])
        #: Places of the pieces by falling score: a smaller place is merged first.
        self.place = np.empty(self.size, np.int64)
        self.place[np.lexsort((np.arange(self.size), -self.scores))] = np.arange(self.size)
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if not plain[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        # every pair of pieces that merges: the ways to cut a piece into two pieces. A cut into characters outside the
        # vocabulary cannot arise, as such characters stay bytes
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        # a hash table with open addressing, at most a quarter full; each round places those that find their slot free
        self.shift = U64(64 - max(10, (4 * len(pairs)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.merged = np.full(len(self.keys), -1, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        ids, slot = np.fromiter(pairs.values(), np.int64, len(pairs)), self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            here = self.keys[slot] == keys
            self.merged[slot[here]] = ids[here]
            keys, ids, slot = keys[~here], ids[~here], (slot[~here] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two pieces merge to, or -1; negative operands never merge."""
        if a.ndim > 1:
            return self.join(a.ravel(), b.ravel()).reshape(a.shape)
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.merged[slot], -1)
        more = np.flatnonzero((there != key) & (there != -1) & (key != -1))
        while len(more):
            at = slot[more] = (slot[more] + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == key[more]
            out[more[hit]] = self.merged[at[hit]]
            more = more[~hit & (there != -1)]
        return np.where(key == -1, -1, out)


class Rows:
    """Rows of numbers of unequal length, one after the other in one array that grows."""

    def __init__(self, dtype: type):
        self.flat, self.at, self.n = np.empty(1024, dtype), np.zeros(1025, np.int64), 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        n, end = self.n + len(lengths), int(self.at[self.n])
        if end + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:end], np.empty(end + 2 * len(flat), self.flat.dtype)])
        if n >= len(self.at):
            self.at = np.concatenate([self.at[: self.n + 1], np.empty(self.n + 2 * len(lengths), np.int64)])
        self.flat[end : end + len(flat)] = flat
        self.at[self.n + 1 : n + 1] = end + np.cumsum(lengths)
        self.n = n

    def take(self, rows: np.ndarray, skip: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of rows, without the first so many of each, and how many each has."""
        first = self.at[rows] + skip
        n = self.at[rows + 1] - first
        ends = np.cumsum(n)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + n, n)], n


class Grown:
    """Rows of equal shape in one array that grows."""

    def __init__(self, dtype: type, width: int | None = None):
        self.room, self.n = np.empty((1024,) if width is None else (1024, width), dtype), 0

    def add(self, rows: np.ndarray) -> None:
        n = self.n + len(rows)
        if n > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty((self.n + 2 * len(rows), *self.room.shape[1:]), self.room.dtype)])
        self.room[self.n : n] = rows
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Encoder:
    def __init__(self, path: str, rate: float = RATE, seed: int = SEED, draws: int | None = None, cached: int = CACHED):
        """draws: None for a draw of its own for each part of each document, or how many draws there are."""
        self.v, self.rate, self.seed, self.draws, self.cached = Vocabulary(path), rate, seed, draws, cached
        self.memo: dict[int, dict[str, bytes]] = defaultdict(dict)
        #: Of each code point: the id of the character, or -1 - code point: it merges with nothing and becomes bytes.
        self.first = -1 - np.arange(0x110000, dtype=np.int64)
        for piece, i in self.v.ids.items():
            if len(piece) == 1:
                self.first[ord(piece)] = i
        self.first[ord(LITERAL)] = -1 - ord(BLANK)
        self.limit = U64(min(int(rate * 2.0**64), 2**64 - 1))
        self.salt = mix64(np.array([seed], U64))
        self.clear()

    def clear(self) -> None:
        """Empties the trees."""
        self.roots: dict[str, int] = {}
        #: Ids of the characters of each part.
        self.starts = Rows(np.int32)
        #: Of each node: its part, which candidates it skips (128 bits), what its candidates add to the key, its ids.
        self.part, self.skips, self.taken, self.ids = Grown(np.int64), Grown(U64, 2), Rows(U64), Rows(np.int32)
        #: Beside each number of taken: the node where that candidate is skipped, or -1.
        self.child = np.full(0, -1, np.int32)
        #: Of each node: the one it was reached from, and how often occurrences ended there.
        self.parent, self.hits = Grown(np.int32), Grown(np.int64)

    def forget(self) -> None:
        """Leaves out the nodes where fewest occurrences ended, so that at most half are left, with all on the way to them.
        What is left out is merged again when it comes up, to the same ids."""
        hits, parent = self.hits.all, self.parent.all
        least = 2
        while True:
            keep = hits >= least
            while True:  # parents come before their children
                up = parent[keep]
                up = up[up >= 0]
                if keep[up].all():
                    break
                keep[up] = True
            if 2 * keep.sum() <= self.cached:
                break
            least *= 2
        kept = np.flatnonzero(keep)
        new = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
        parts, part = np.unique(self.part.all[kept], return_inverse=True)
        roots, skips = {p: int(new[n]) for p, n in self.roots.items() if keep[n]}, self.skips.all[kept]
        taken, ids, starts = self.taken.take(kept), self.ids.take(kept), self.starts.take(parts)
        child = self.child[pieces(self.taken.at[kept], taken[1])]
        child = np.where(child >= 0, new[child], -1)
        parent, hits = np.where(parent[kept] >= 0, new[parent[kept]], -1), hits[kept] // 2
        self.clear()
        self.roots = roots
        for rows, got in ((self.taken, taken), (self.ids, ids), (self.starts, starts)):
            rows.add(*got)
        for grown, got in ((self.part, part), (self.skips, skips), (self.parent, parent), (self.hits, hits)):
            grown.add(got)
        self.child = np.concatenate([child, np.full(len(self.taken.flat) - len(child), -1)]).astype(np.int32)

    def firsts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the characters of parts, one part after the other, and their lengths."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.first[codes], np.fromiter(map(len, parts), np.int64, len(parts))

    def start(self, parts: list[str]) -> np.ndarray:
        """Ids of the characters of parts, a part a row, filled up with the least long."""
        flat, n = self.firsts(parts)
        out = np.full((len(parts), int(n.max()) + 1), NONE, np.int64)
        out[np.arange(out.shape[1]) < n[:, None]] = flat
        return out

    def merge(self, ids: np.ndarray, draw: np.ndarray | None, given: np.ndarray | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Agenda merging of the rows of ids, all at once: the ids left, and where they stand. Skips follow the draws, or
        are given: for each row, by the number of the candidate. seen gets the candidates: rows, what they add to keys."""
        v, n, width = self.v, len(ids), ids.shape[1] - 1
        far = np.iinfo(np.int64).max
        nxt = np.tile(np.arange(1, width + 2), (n, 1))
        prv = np.tile(np.arange(-1, width), (n, 1))
        alive = np.ones((n, width + 1), bool)
        cand = np.full((n, width + 1), -1, np.int64)  # what the symbol here and the next one merge to
        cand[:, :-1] = v.join(ids[:, :-1], ids[:, 1:])
        # the agenda's order: place of the merged piece, then position
        order = np.where(cand >= 0, v.place[cand] * (width + 1) + np.arange(width + 1), far)
        rows = np.arange(n)
        step = -1
        while len(rows):
            step += 1
            sub = order[rows] if len(rows) < n else order
            at = sub.argmin(1)
            live = sub[np.arange(len(rows)), at] != far
            if not live.all():
                rows, at = rows[live], at[live]
                if not len(rows):
                    break
            piece = cand[rows, at]
            if self.rate > 0:
                own = piece.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + at.astype(U64) * U64(0x165667B19E3779F9)
                if seen is not None:
                    seen.append((rows, own))
                if given is not None:
                    skip = given[rows, step] if step < given.shape[1] else np.zeros(len(rows), bool)
                else:
                    skip = mix64(draw[rows].astype(U64) * U64(0x9E3779B97F4A7C15) + own + self.salt) < self.limit
                if skip.any():
                    order[rows[skip], at[skip]] = far
                    go, pos, piece = rows[~skip], at[~skip], piece[~skip]
                else:
                    go, pos = rows, at
            else:
                go, pos = rows, at
            if not len(go):
                continue
            right = nxt[go, pos]
            after = nxt[go, right]
            ids[go, pos] = piece
            alive[go, right] = False
            order[go, right] = far
            nxt[go, pos] = after
            # the two merges that the new symbol may enter: with the one after it and the one before it
            inside = after <= width
            prv[go[inside], after[inside]] = pos[inside]
            before = prv[go, pos]
            has = before >= 0
            k = int(inside.sum())
            left = np.concatenate([piece[inside], ids[go[has], before[has]]])
            next_ = np.concatenate([ids[go[inside], after[inside]], piece[has]])
            both = v.join(left, next_)
            new = np.full(len(go), -1, np.int64)
            new[inside] = both[:k]
            cand[go, pos] = new
            order[go, pos] = np.where(new >= 0, v.place[new] * (width + 1) + pos, far)
            g, b, new = go[has], before[has], both[k:]
            cand[g, b] = new
            order[g, b] = np.where(new >= 0, v.place[new] * (width + 1) + b, far)
        return ids, alive & (ids != NONE)

    def flat(self, ids: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of all rows and how many each has; characters outside the vocabulary become their byte pieces."""
        flat, n = ids[there], there.sum(1)
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            spelt = [[self.v.byte[x] for x in chr(-1 - i).encode("utf-8", "surrogatepass")] for i in flat[odd].tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = [len(x) for x in spelt]
            row = np.repeat(np.arange(len(n)), n)
            n = np.bincount(row, times, len(n)).astype(np.int64)
            at = (np.cumsum(times) - times)[odd]
            flat = np.repeat(flat, times)
            for a, x in zip(at.tolist(), spelt, strict=True):
                flat[a : a + len(x)] = x
        return flat.astype(np.int32), n

    def finish(self, ids: np.ndarray, there: np.ndarray) -> list[bytes]:
        """int32 ids of each row as bytes."""
        flat, n = self.flat(ids, there)
        data, ends = flat.tobytes(), np.concatenate([[0], 4 * np.cumsum(n)]).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, wanted: set[tuple[int, str]]) -> None:
        """Puts the segmentations of (draw, part) into the memo, parts of like length together."""
        by: dict[int, list[tuple[int, str]]] = {}
        for d, p in wanted:
            by.setdefault(len(p) if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append((d, p))
        for width, some in by.items():
            step = max(1, 400_000 // width)
            some.sort()
            for k in range(0, len(some), step):
                chunk = some[k : k + step]
                got = self.finish(*self.merge(self.start([p for _, p in chunk]), np.array([d for d, _ in chunk], U64)))
                for (d, p), ids in zip(chunk, got, strict=True):
                    self.memo[d][p] = ids

    def grow(self, part: np.ndarray, skips: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """New nodes for parts (by number), their skipped candidates (bits) and parents (-1: none), in the order given."""
        made = np.zeros(len(part), np.int64)
        lengths = self.starts.at[part + 1] - self.starts.at[part]
        for width in np.unique(lengths).tolist():
            every = np.flatnonzero(lengths == width)
            for k in range(0, len(every), max(1, 400_000 // width)):
                some = every[k : k + max(1, 400_000 // width)]
                ids = np.full((len(some), width + 1), NONE, np.int64)
                ids[:, :-1] = self.starts.take(part[some])[0].reshape(len(some), width)
                bits = np.unpackbits(skips[some].astype("<u8").view(np.uint8), axis=1, bitorder="little").view(bool)
                upto = np.flatnonzero(bits.any(0))
                seen: list[tuple[np.ndarray, np.ndarray]] = []
                flat, n = self.flat(*self.merge(ids, None, bits[:, : upto[-1] + 1 if len(upto) else 0], seen))
                of = np.concatenate([r for r, _ in seen]) if seen else np.zeros(0, np.int64)
                own = np.concatenate([o for _, o in seen])[np.argsort(of, kind="stable")] if seen else np.zeros(0, U64)
                made[some] = self.ids.n + np.arange(len(some))
                self.part.add(part[some])
                self.skips.add(skips[some])
                self.parent.add(parent[some])
                self.hits.add(np.zeros(len(some), np.int64))
                self.taken.add(own, np.bincount(of, minlength=len(some)))
                self.ids.add(flat, n)
                if len(self.child) < len(self.taken.flat):
                    self.child = np.concatenate([self.child, np.full(len(self.taken.flat) - len(self.child), -1, np.int32)])
        return made

    def skipped(self, node: np.ndarray, begin: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the occurrences skip a candidate from begin on, and the first that each skips. Some thousand occurrences
        at once, as the numbers of all their candidates stand in memory."""
        rows, places = [], []
        for k in range(0, len(node), 40_000):
            some = slice(k, k + 40_000)
            own, n = self.taken.take(node[some], begin[some])
            own += np.repeat(key[some], n)
            hit = np.flatnonzero(mix64(own) < self.limit)
            ends = np.cumsum(n)
            row = np.searchsorted(ends, hit, "right")
            first = np.flatnonzero(np.diff(row, prepend=-1))
            row = row[first]
            rows.append(row + k)
            places.append(hit[first] - (ends - n)[row] + begin[some][row])
        return np.concatenate(rows), np.concatenate(places)

    def walk(self, node: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The nodes where occurrences with these draws end that start at these."""
        node, at = node.copy(), np.arange(len(node))
        begin = np.zeros(len(node), np.int64)  # candidates that were looked at in the parent
        key = draw * U64(0x9E3779B97F4A7C15) + self.salt
        while len(at):
            row, place = self.skipped(node[at], begin[at], key[at])
            at = at[row]
            slot = self.taken.at[node[at]] + place
            found = self.child[slot].astype(np.int64)
            lacking = np.flatnonzero(found < 0)
            if len(lacking):
                new, one, which = np.unique(slot[lacking], return_index=True, return_inverse=True)
                parent, skipped = node[at[lacking[one]]], place[lacking[one]]
                skips = self.skips.all[parent]  # a part of LONG characters has fewer than 128 candidates in turn
                np.bitwise_or.at(skips, (np.arange(len(new)), skipped >> 6), U64(1) << (skipped & 63).astype(U64))
                made = self.grow(self.part.all[parent], skips, parent)
                self.child[new] = made
                found[lacking] = made[which]
            node[at] = found
            begin[at] = place + 1
        return node

    def encode(self, texts: list[str | None], keys: list[int]) -> list[bytes]:
        """int32 ids of each text as bytes; the draw of a part is the hash of its text's key and its number. Null and empty
        texts give none."""
        if self.part.n > self.cached:
            self.forget()
        parts: list[str] = []
        ends = [0]
        for text in texts:
            parts += PART.findall(BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK)) if text else []
            ends.append(len(parts))
        n = np.diff(ends)
        number = np.arange(len(parts)) - np.repeat(np.array(ends[:-1], np.int64), n)
        draw = mix64(number.astype(U64) + np.repeat(mix64(np.array([k & (2**64 - 1) for k in keys], U64)), n))
        if self.draws is not None:
            draw %= U64(self.draws)
        get = self.roots.get
        node = np.fromiter(map(get, parts, repeat(-1)), np.int64, len(parts))
        lacking = [(i, parts[i]) for i in np.flatnonzero(node < 0).tolist() if len(parts[i]) <= LONG]
        if lacking:
            new = list(dict.fromkeys([p for _, p in lacking]))
            at = self.starts.n + np.arange(len(new))
            self.starts.add(*self.firsts(new))
            self.roots.update(zip(new, self.grow(at, np.zeros((len(new), 2), U64), np.full(len(new), -1)).tolist(), strict=True))
            node[[i for i, _ in lacking]] = [get(p, -1) for _, p in lacking]
        short = np.flatnonzero(node >= 0)
        last = self.walk(node[short], draw[short]) if self.rate > 0 else node[short]
        self.hits.all[:] += np.bincount(last, minlength=self.hits.n)
        flat, lengths = self.ids.take(last)
        data = flat.tobytes()
        upto = np.zeros(len(parts) + 1, np.int64)
        upto[short + 1] = 4 * lengths
        upto = np.cumsum(upto)
        long = deque(np.flatnonzero(node < 0).tolist())
        self.learn({(int(draw[i]), parts[i]) for i in long})
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            piece, at = [], a
            while long and long[0] < b:
                i = long.popleft()
                piece += [data[upto[at] : upto[i]], self.memo[int(draw[i])][parts[i]]]
                at = i + 1
            out.append(b"".join([*piece, data[upto[at] : upto[b]]]))
        self.memo.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the leading blank that encoding adds goes."""
        table = self.v.bytes
        text = b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")
        return (text[1:] if text[:1] == " " else text)


_ENCODERS: dict[tuple, Encoder] = {}


def encode_documents(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED, draws: int | None = None, chars: int = CHARS, cached: int = CACHED) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, token_ids and round_trip: whether decoding the ids gives the text again (a null
    text counts as empty). Repeated rows get the same ids: the key is doc_id (null: 2**63). Whole texts of any
    length; no rows are added or lost; an empty table gives an empty one; other columns are left out. In memory are chars
    characters of texts (at least one text) with some 100 bytes for each, as a run of LONG characters and more without a
    blank is merged as one row of arrays, and cached nodes; neither number changes a result."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, rate, seed, draws, cached)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(path, rate, seed, draws, cached)
        enc = _ENCODERS[key]
        for whole in batches:
            # as many texts at once as give the arrays a good length
            size = pc.utf8_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False).cumsum() // chars
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), whole.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(at, end - at)
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                got = enc.encode(texts, [1 << 63 if i is None else i for i in ids])
                flat = np.frombuffer(b"".join(got), np.int32)
                n = np.array([len(g) // 4 for g in got], np.int64)
                ends = np.concatenate([[0], n.cumsum()])
                listed = flat.tolist()
                ok = [enc.decode(listed[ends[i] : ends[i + 1]]) == (t or "") for i, t in enumerate(texts)]
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), tokens, pa.array(ok)], names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids of every row of documents; nulls, ties and empty tables as encode_documents() states."""
    return encode_documents(table(spark, sf_dir, "documents"), path or default_path())
