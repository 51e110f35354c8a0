"""Byte-level BPE as an automaton over token arcs.

Merges are compiled by one gadget after the other. Reading a token leads to a state that depends on that token alone; the
automaton of no merges has one arc for each byte from every state. The gadget of a merge (u, v) -> uv

* takes the arc v from the state that u leads to, so that u v is no longer a path, and
* adds an arc uv wherever u has an arc, leading to a copy of the state that v led to.

The paths of the final automaton are exactly the token sequences that BPE can give, one for each byte string. `written_out`
is that construction as it stands; for 50,000 merges it would have billions of arcs. Each arc that a gadget makes copies an
arc that was there before, so `Automaton.compile` gets any set of entries of the finished transition table by taking them
back through the gadgets, and writes them to the table: (state, token) -> next state, or no arc. The table holds all arcs
met so far, up to MAX_ARCS.

Encoding takes steps of the table over the byte positions of a pre-split word: a position that is reached holds one state,
and each token whose label fits the next bytes is a step to a later position, if the table has one. Every prefix has
exactly one path, so each position is reached once. Decoding emits the labels of the arcs.

Words are pre-split by the usual pattern of byte-level BPE with array operations over code points. Words are encoded once
for each task and kept, by their bytes, in a bounded table that goes with the task.

Defined results: null texts are empty and give no tokens; `<|endoftext|>` in a text is its special token, as in the library
(added tokens are matched before splitting); equal texts give equal ids, repeated rows a row each; long texts are taken
whole, in a slice of their own; an empty table gives an empty result; other columns are not read, but for `encode_column`
and `decode_column`, which return them and replace a column of the name they write.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import column_bytes, ragged, run_hashes, slices, tidy

MAX_WORDS = 200_000
MAX_ARCS = 1 << 18
#: Longer words are encoded one by one.
WIDE = 48
SLICE = 1 << 20
TOKEN_BITS, TOKEN = 20, (1 << 20) - 1
NO_ARC, UNKNOWN = -1, -2
LETTER, NUMBER, SPACE = 1, 2, 3


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def written_out(n_bytes: int, merges: list[tuple[int, int, int]]) -> dict[int, dict[int, int]]:
    """The whole automaton of a small merge list, gadget by gadget: state -> token -> next state. A token's state has the
    token's number; merges are (u, v, uv) in order."""
    arcs = {x: {b: b for b in range(n_bytes)} for x in range(n_bytes)}
    for u, v, uv in merges:
        copy = dict(arcs[v])
        if u in copy:
            copy[uv] = uv
        arcs[u].pop(v, None)
        for out in arcs.values():
            if u in out:
                out[uv] = uv
        arcs[uv] = copy
    return arcs


class Gadgets:
    """A merge list in the order of its gadgets, and the table of transitions compiled from it."""

    def __init__(self, tokens: int, merges: list[tuple[int, int, int]]):
        #: Of a merged token its parts and its time; bytes are there at time 0.
        self.parts = np.zeros((3, tokens), np.int64)
        pairs = np.array(merges, np.int64).reshape(-1, 3)
        self.parts[:, pairs[:, 2]] = np.stack((pairs[:, 0], pairs[:, 1], np.arange(1, len(pairs) + 1)))
        #: The time at which a pair's arc goes.
        self.gone = Table(len(pairs))
        self.gone.add(pairs[:, 0] << TOKEN_BITS | pairs[:, 1], np.arange(1, len(pairs) + 1))
        self.transitions = Table(MAX_ARCS)

    def compile(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The finished table's entries for the states that the tokens x lead to and the tokens y: the next state or NO_ARC."""
        out, live = y.copy(), np.arange(len(x))
        until = np.full(len(x), 1 << 40)  # gadgets with a time below `until` count
        left, right, time = self.parts
        while len(live):
            gone = self.gone.get(x << TOKEN_BITS | y, 1 << 41) < until
            out[live[gone]] = NO_ARC
            tx, ty = time[x], time[y]
            go = ~gone & ((tx > 0) | (ty > 0))
            live, x, y, tx, ty = live[go], x[go], y[go], tx[go], ty[go]
            # the later gadget made its part as a copy: x's state that of its right part before the gadget, the arc y that
            # of its left part after the removal; where both are of one gadget, both are taken back
            later = tx >= ty
            x, y, until = np.where(later, right[x], x), np.where(tx > ty, y, left[y]), np.where(later, tx, ty + 1)
        return out

    def steps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Next states by the table; entries met for the first time are compiled into it."""
        key = x << TOKEN_BITS | y
        out = self.transitions.get(key, UNKNOWN)
        missing = out == UNKNOWN
        if missing.any():
            new, back = np.unique(key[missing], return_inverse=True)
            made = self.compile(new >> TOKEN_BITS, new & TOKEN)
            if self.transitions.used + len(new) > MAX_ARCS:
                self.transitions = Table(MAX_ARCS)
            self.transitions.add(new[:MAX_ARCS], made[:MAX_ARCS])
            out[missing] = made[back]
        return out

    def step(self, x: int, y: int) -> int:
        return int(self.steps(np.array([x]), np.array([y]))[0])


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = {s: i for s, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for s, i in vocab.items():
            labels[i] = bytes(alphabet[c] for c in s)
        self.special = {s.encode(): i for s, i in special.items()}
        for s, i in self.special.items():
            labels[i] = s
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        self.arcs = Gadgets(len(labels), [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        # arc labels as a tree: (node << 8 | byte) -> node, and the token that ends at a node
        child: dict[int, int] = {}
        ends = [-1]
        ordinary = set(range(len(labels))) - set(self.special.values())
        for t in sorted(ordinary):
            node = 0
            for c in labels[t]:
                nxt = child.get(node << 8 | c)
                if nxt is None:
                    nxt = child[node << 8 | c] = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = t
        self.tree, self.token_at = Table(len(child)), np.array(ends, np.int64)
        self.tree.add(np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)))
        lens = np.array([len(x) for x in labels])
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        self.label_lens, self.label_starts = lens, np.cumsum(lens) - lens
        self.longest = int(lens[sorted(ordinary)].max(initial=1))
        texts = [b"%d," % i for i in range(len(labels))]
        self.digit_lens = np.array([len(x) for x in texts])
        self.digit_starts, self.digit_bytes = np.cumsum(self.digit_lens) - self.digit_lens, np.frombuffer(b"".join(texts), np.uint8)

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word of any length. Its fitting labels are found for a stretch of positions at once."""
        n, buf = len(word), np.frombuffer(word, np.uint8)
        state, back = [-1] * (n + 1), [0] * (n + 1)
        known: dict[int, int] = {}
        for begin in range(0, n, 1 << 14):
            end = min(n, begin + (1 << 14))
            fits = self.labels_at(buf, begin, end)
            for i, j, y in zip(*(a.tolist() for a in fits), strict=True):
                x = state[i]
                if (x < 0 and i) or state[j] >= 0:
                    continue
                if i:
                    key = x << TOKEN_BITS | y
                    to = known.get(key)
                    if to is None:
                        if len(known) >= MAX_ARCS:
                            known.clear()
                        to = known[key] = self.arcs.step(x, y)
                    if to < 0:
                        continue
                state[j], back[j] = y, i
        out, i = [], n
        while i > 0:
            if state[i] < 0:
                raise ValueError("a byte without a token")
            out.append(state[i])
            i = back[i]
        out.reverse()
        return out

    def labels_at(self, buf: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, end, token) of all labels that fit from the positions begin to end, by position and length."""
        live, node = np.arange(begin, end), np.zeros(end - begin, np.int64)
        found = []
        for k in range(self.longest):
            inside = live + k < len(buf)
            live, node = live[inside], node[inside]
            node = self.tree.get(node << 8 | buf[live + k], -1)
            live, node = live[node >= 0], node[node >= 0]
            if not len(live):
                break
            y = self.token_at[node]
            found.append((live[y >= 0], np.full(int((y >= 0).sum()), k + 1), y[y >= 0]))
        at, size, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((size, at))
        return at[order], (at + size)[order], y[order]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.label_bytes[ragged(self.label_starts[ids], self.label_lens[ids])]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")

    def encode_many(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words of up to WIDE bytes, one after the other, and the number of each word's ids."""
        order = np.argsort(-lens, kind="stable")
        starts, size = starts[order], lens[order]
        n, width = len(starts), int(size[0]) if len(size) else 0
        state = np.full((width + 1, n), -1, np.int64)
        back = np.zeros((width + 1, n), np.int16)
        shorter = np.searchsorted(-size, -np.arange(width + 1), "left")  # words longer than i come first
        for i in range(width):
            live = np.arange(shorter[i])
            if i:
                live = live[state[i, : shorter[i]] >= 0]
            node = np.zeros(len(live), np.int64)
            who, goal, token = [], [], []
            for j in range(i, width):
                if j > i:
                    keep = size[live] > j
                    live, node = live[keep], node[keep]
                if not len(live):
                    break
                node = self.tree.get(node << 8 | buf[starts[live] + j], -1)
                keep = node >= 0
                live, node = live[keep], node[keep]
                y = self.token_at[node]
                hit = (y >= 0) & (state[j + 1, live] < 0)
                if hit.any():
                    who.append(live[hit])
                    token.append(y[hit])
                    goal.append(np.full(int(hit.sum()), j + 1))
            if who:
                w, y, g = np.concatenate(who), np.concatenate(token), np.concatenate(goal)
                if i:
                    ok = self.arcs.steps(state[i, w], y) != NO_ARC
                    w, y, g = w[ok], y[ok], g[ok]
                state[g, w], back[g, w] = y, i
        at = size.copy()
        found, k = [], np.arange(n)
        while len(k):
            y = state[at[k], k]
            if (y < 0).any():
                raise ValueError("a byte without a token")
            found.append((k, y))
            at[k] = back[at[k], k]
            k = k[at[k] > 0]
        counts = np.zeros(n, np.int64)
        for k, _ in found:
            counts[k] += 1
        ends = np.empty(n, np.int64)
        total = np.zeros(n, np.int64)
        total[order] = counts
        bound = np.cumsum(total)
        ends = bound[order]
        ids = np.empty(int(total.sum()), np.int32)
        for step, (k, y) in enumerate(found, 1):
            ids[ends[k] - step] = y
        return ids, total


class Table:
    """An open-addressing map of integers for up to `room` keys, read and filled by arrays."""

    def __init__(self, room: int):
        bits = max(4, int(2 * room).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.used = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys."""
        place, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] < 0]
            self.keys[place[free]] = keys[free]
            left = left[self.keys[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & self.mask
        self.values[place] = values
        self.used += len(keys)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        place = self.place(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.values[place].astype(np.int64), missing)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            held = self.keys[place[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[place[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


_automata: dict[str, Automaton] = {}
_classes: list[np.ndarray] = []


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton(path)
    return _automata[path]


def classes() -> np.ndarray:
    """Class of each code point."""
    if not _classes:
        a = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                a[c] = LETTER
            elif k == "N":
                a[c] = NUMBER
        for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            a[c] = SPACE
        _classes.append(a)
    return _classes[0]


def pre_split(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Start positions of the words of a text of code points; `first` marks where segments begin.

    The pattern: contractions, then an optional space before a run of letters, numbers or other signs; of white space
    before a word all but the last character is one word.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[0] = True
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], n)
    space = kind[starts] == SPACE
    mark = np.zeros(n + 1, bool)
    mark[starts] = True
    inner = np.zeros(len(starts), bool)  # space runs that a word of the same segment follows
    inner[:-1] = space[:-1] & ~first[starts[1:]]
    last = ends[inner] - 1
    mark[last] = True
    joined = points[last] == 32
    mark[last[joined] + 1] = False
    quote = starts[(points[starts] == 39) & mark[starts]]
    if len(quote):
        segment_end = np.append(np.flatnonzero(first)[1:], n)
        bound = segment_end[np.searchsorted(segment_end, quote, "right")]
        at = lambda k: np.where(quote + k < bound, points[np.minimum(quote + k, n - 1)], 0)
        a, b = at(1), at(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        # a quote that follows another sign or a joined space is no start of a run, so all of these begin a word
        q, size = quote[size > 0], size[size > 0]
        mark[q + 1] = False
        mark[q + 1 + size] = True
    return np.flatnonzero(mark[:n])


class Encoder:
    """Encodes slices of text; keeps the ids of up to `max_words` distinct words, by their bytes."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.auto, self.max_words = automaton(path), max_words
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.lens = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.used = 0

    def add(self, words: list[bytes], ids: np.ndarray, lens: np.ndarray) -> int:
        """Keeps the ids of words; the first one's slot."""
        k, n = len(self.slot), len(words)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)))
        if k + n > len(self.starts):
            more = np.zeros(max(len(self.starts), n), np.int64)
            self.starts, self.lens = np.concatenate((self.starts, more)), np.concatenate((self.lens, more))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[k : k + n] = self.used + np.cumsum(lens) - lens
        self.lens[k : k + n] = lens
        self.used += len(ids)
        self.slot.update(zip(words, range(k, k + n), strict=True))
        return k

    def words(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the pre-split words, and for each document its range of them."""
        cuts, special = offs[:-1], {}
        raw = buf.tobytes()
        for s, i in self.auto.special.items():
            at = raw.find(s)
            while at >= 0:
                if np.searchsorted(offs, at, "right") == np.searchsorted(offs, at + len(s), "left"):  # within one document
                    special[at] = (at + len(s), i)
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        if special:
            cuts = np.unique(np.concatenate((cuts, [x for a, (b, _) in special.items() for x in (a, b)])))
        char = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(char), bool)
        first[np.searchsorted(char, cuts[cuts < len(buf)])] = True
        starts = char[pre_split(points, first)]
        if special:
            inside = np.zeros(len(buf) + 1, np.int8)
            for a, (b, _) in special.items():
                inside[a + 1] += 1
                inside[b] -= 1
            starts = starts[np.cumsum(inside)[starts] == 0]
        ends = np.append(starts[1:], len(buf))
        return starts, ends, np.searchsorted(starts, offs)

    def slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each word; words are grouped by hash and then held against their group's first by their bytes."""
        lens = ends - starts
        _, place, inverse = np.unique(run_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        same = lens == lens[place][inverse]
        differ = buf[ragged(starts[same], lens[same])] != buf[ragged(starts[place][inverse[same]], lens[same])]
        if differ.any():
            same[np.flatnonzero(same)[np.unique(np.repeat(np.arange(int(same.sum())), lens[same])[differ])]] = False
        if not same.all():
            other = np.flatnonzero(~same)
            inverse[other] = len(place) + np.arange(len(other))
            place = np.concatenate((place, other))
        raw = buf.tobytes()
        words = [raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
        if len(self.slot) + len(words) > self.max_words:
            self.clear()
        get = self.slot.get
        out = np.array([get(x, -1) for x in words], np.int64)
        new = {words[k]: k for k in np.flatnonzero(out < 0).tolist()}
        plain = [k for w, k in new.items() if len(w) <= WIDE and w not in self.auto.special]
        for w in new.keys() - {words[k] for k in plain}:
            ids = [self.auto.special[w]] if w in self.auto.special else self.auto.encode(w)
            self.add([w], np.array(ids, np.int32), np.array([len(ids)]))
        if plain:
            at = place[np.array(plain)]
            ids, counts = self.auto.encode_many(buf, starts[at], lens[at])
            self.add([words[k] for k in plain], ids, counts)
        if new:
            out = np.array([get(x, -1) for x in words], np.int64)
        return out[inverse]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents and each document's bounds in them."""
        buf, offs = column_bytes(col)
        starts, ends, at = self.words(buf, offs)
        slots = self.slots(buf, starts, ends)
        lens = self.lens[slots]
        return self.ids[ragged(self.starts[slots], lens)], np.append(0, np.cumsum(lens))[at]

    def digits(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, list[int]]:
        """The ids in decimal with a comma behind each, and the documents' bounds in that."""
        lens = self.auto.digit_lens[ids]
        return self.auto.digit_bytes[ragged(self.auto.digit_starts[ids], lens)].tobytes(), np.append(0, np.cumsum(lens))[at].tolist()


def encode_column(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of a text column as array<int>; a column of that name is replaced."""
    path = path or default_path()
    kept = [c for c in docs.columns if c != ids]

    def run(batches):
        enc = Encoder(path)
        for batch in batches:
            for x in slices(batch, text, SLICE):
                found, at = enc.encode(x.column(kept.index(text)))
                yield pa.RecordBatch.from_arrays([*x.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32()))], [*kept, ids])

    rows = docs.select(*kept)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode_column(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of token ids; null ids give null; a column of that name is replaced."""
    path = path or default_path()
    kept = [c for c in df.columns if c != text]

    def run(batches):
        auto = automaton(path)
        for batch in batches:
            lists = batch.column(kept.index(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([auto.decode(x) if x is not None else None for x in lists.to_pylist()], pa.string())], [*kept, text])

    rows = df.select(*kept)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts are encoded, and their ids decoded again."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = Encoder(path)
        for batch in batches:
            for x in slices(batch, limit=SLICE):
                ids, at = enc.encode(x.column(1))
                d, n = enc.digits(ids, at)
                text = enc.auto.decode_bytes(ids)
                in_text = np.append(0, np.cumsum(enc.auto.label_lens[ids]))[at].tolist()
                sha = [hashlib.sha256(d[a : max(a, b - 1)]).hexdigest() for a, b in zip(n[:-1], n[1:], strict=True)]
                t = text.tobytes()
                back = [hashlib.sha256(t[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(in_text[:-1], in_text[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(np.diff(at), pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return digests(table(spark, sf_dir, "documents"))
