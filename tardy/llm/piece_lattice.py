"""Piece lattices of texts and sampling of distinct segmentations.

A text is cut into units (spaces and what follows them up to the next space or
line end); pieces never cross units, so its lattice is the chain of its units'
lattices.  Lattices and backward masses are built once for each distinct unit
of a batch, in numpy, and those of the first units are remembered.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from tardy.llm.text import join_bytes, mix, range_hashes

_U = np.uint64
_SPACE = b"\xe2\x96\x81"                 # U+2581 stands for a space in pieces
#: a draw of an exponential variate is at least exp(-_REACH)
_REACH = 37.0
#: nodes of a path that are looked at first when it splits an entry
_LIMIT = 2048
#: edges that a process remembers (some 50 bytes each)
KEPT_EDGES = 3 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteTrie:
    """Trie over bytes, or other small numbers, in two flat arrays: a step by byte ``b`` from ``state``
    leads to the slot ``base[state] + b``, if that slot's owner is ``state``.
    A state is its slot; 0 is nowhere, 1 the root.  A few hundred kilobytes, so
    a lookup stays in the processor's cache.
    """

    def __init__(self, children: list[dict[int, int]], size: int = 256):
        """``children``: for each node (0: the root) its steps, byte -> node;
        bytes are below ``size``."""
        free = bytearray(2) + bytearray(b"\1") * (2 * len(children) + 4 * size)
        slot = [1] * len(children)
        base = [2] * len(children)
        low, width = size + 2, 0                               # from here on no base is below 2
        for node in sorted(range(len(children)), key=lambda i: -len(children[i])):
            steps = list(children[node])
            if not steps:
                break
            if len(steps) != width:                            # fewer steps fit into gaps left before
                low, width = size + 2, len(steps)
            low = at = free.find(1, low)
            tries = 0
            while True:
                if at < 0 or at + 2 * size > len(free):
                    free += bytearray(b"\1") * len(free)
                    at = max(at, low)
                begin = at - steps[0]
                if all([free[begin + b] for b in steps]):
                    break
                at = free.find(1, at + 1)
                tries += 1
            if tries > 16:                                     # crowded up to here
                low = at
            base[node] = begin
            for b in steps:
                free[begin + b] = 0
                slot[children[node][b]] = begin + b
        self.slot = np.array(slot, np.int64)
        self.base = np.full(max(max(slot), max(base)) + size + 1, 2, np.int64)
        self.base[self.slot] = base
        self.owner = np.full(len(self.base), -1, np.int64)
        for node, steps in enumerate(children):
            for child in steps.values():
                self.owner[slot[child]] = slot[node]

    def __getitem__(self, key):
        """States after a byte from a state (numbers or arrays), 0 where there is no step."""
        state, byte = key
        to = self.base[state] + byte
        return np.where(self.owner[to] == state, to, 0)


class Pieces:
    """Pieces of a SentencePiece model with byte fallback.

    A BPE model ranks its pieces; the lattice takes log p = -log(rank + 10)
    up to a constant.  Longer pieces whose score rules them out are left out.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path = path
        self.bytes: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        words: dict[bytes, tuple[int, float]] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                raw = piece.replace("▁", " ").encode()
                self.bytes.append(raw)
                if sp.get_score(i) > -1e8 or len(piece) == 1:    # a lone space is ranked last
                    words[raw] = (i, -float(np.log(10 - max(sp.get_score(i), -sp.get_piece_size()))))
        nodes, children = {b"": 0}, [{}]
        for raw in sorted(words):
            for n in range(1, len(raw) + 1):
                if raw[:n] not in nodes:
                    nodes[raw[:n]] = len(children)
                    children[nodes[raw[:n - 1]]][raw[n - 1]] = len(children)
                    children.append({})
        self.next = ByteTrie(children)
        self.final, self.logp = np.full(len(self.next.base), -1, np.int32), np.zeros(len(self.next.base))
        ends = self.next.slot[[nodes[raw] for raw in words]]
        self.final[ends], self.logp[ends] = np.array(list(words.values())).T
        self.longest = max(map(len, words))
        self.memory = LatticeMemory()
        self.nul = any(b"\0" in raw for raw in words)
        self.single = {raw for raw in words if len(raw.decode()) == 1}

        self.table = pa.array(self.bytes, pa.large_binary())

    def decode_many(self, ids: np.ndarray, cut: np.ndarray) -> list[str]:
        """Texts of the sequences ids[cut[i]:cut[i + 1]]."""
        spelt = self.table.take(pa.array(ids))
        raw, bound = spelt.buffers()[2], np.frombuffer(spelt.buffers()[1], np.int64)[spelt.offset:][cut].tolist()
        raw = raw.to_pybytes() if raw else b""
        parts = [raw[a:b] for a, b in zip(bound, bound[1:])]
        return [(b[1:] if b[:1] == b" " else b).decode("utf-8", "surrogatepass") for b in parts]

    def decode(self, ids) -> str:
        """Text of a sequence of ids; the space set before the text goes."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _char_starts(buf: np.ndarray) -> np.ndarray:
    return (buf & 0xC0) != 0x80


def units(pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes (a space before each text) and the units: start, end, text
    index and whether a unit is a character without a piece."""
    buf, starts = join_bytes([" " + t for t in texts])
    n = len(buf)
    text_of_end = np.zeros(n + 1, bool)
    text_of_end[starts[1:] - 1] = True                        # the separators
    char = np.flatnonzero(_char_starts(buf) & ~text_of_end[:n])
    size = np.diff(np.concatenate((char, [n])))
    # characters without a piece of their own (a separator cannot be inside one)
    ascii_known = np.zeros(256, bool)
    for b in range(128):
        ascii_known[b] = bytes([b]) in pieces.single
    lone = np.zeros(len(char), bool)
    low = buf[char] < 128
    lone[low] = ~ascii_known[buf[char[low]]]
    wide = np.flatnonzero(~low)
    if len(wide):
        stop = np.minimum(np.searchsorted(starts, char[wide], "right"), len(starts) - 1)
        end = np.where(wide + 1 < len(char), char[np.minimum(wide + 1, len(char) - 1)], n)
        end = np.minimum(end, starts[stop] - 1)
        code = np.zeros(len(wide), np.int64)
        for k in range(4):
            code = np.where(char[wide] + k < end, code << 8 | buf[np.minimum(char[wide] + k, n - 1)], code)
        known = np.array(sorted(int.from_bytes(s, "big") for s in pieces.single), np.int64)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        lone[wide] = known[at] != code
        lone[wide] |= code == int.from_bytes(_SPACE, "big")  # a literal U+2581 is spelt in bytes
    space = buf[char] == 32
    new = np.zeros(len(char), bool)
    new[np.searchsorted(char, starts[:-1])] = True
    new[1:] |= space[1:] & ~space[:-1]                        # a run of spaces begins a unit
    new |= lone
    new[1:] |= lone[:-1]
    begin = np.flatnonzero(new)
    s = char[begin]
    doc = np.searchsorted(starts, s, "right") - 1
    e = np.minimum(np.concatenate((s[1:], [n])), starts[doc + 1] - 1)
    del size
    return buf, s, e, doc, lone[begin]


class Lattices:
    """Lattices of distinct units, however long: nodes are byte positions, edges are pieces.

    ``first[node]`` .. ``first[node + 1]`` are the node's edges; ``p`` is the
    probability of an edge among all ways on from its node (weight times
    backward mass), ``cum`` its running sum, ``to`` the node reached.
    """

    def __init__(self, pieces: Pieces, buf: np.ndarray, s: np.ndarray, e: np.ndarray):
        length = e - s
        self.root = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
        total = int((length + 1).sum())
        data = np.zeros(total, np.uint8)
        src = np.arange(int(length.sum())) - np.repeat(np.concatenate(([0], np.cumsum(length)[:-1])), length)
        data[np.repeat(self.root, length) + src] = buf[np.repeat(s, length) + src]
        inner = _char_starts(data)
        inner[self.root + length] = False                      # the final node of each unit
        starts, width = np.flatnonzero(inner), 0
        states = np.ones(len(starts), np.int64)
        base, owner = pieces.next.base, pieces.next.owner
        count = np.zeros(total, np.int64)                      # edges found so far of each node, the shorter first
        found = []
        last = np.repeat(self.root + length, length + 1) if pieces.nul else None
        while len(starts) and width < pieces.longest:
            # the byte at a unit's final node is 0: no step leads across it
            at = base.take(states) + data.take(starts + width)
            ok = np.flatnonzero(owner.take(at) == states)
            starts, states = starts.take(ok), at.take(ok)
            width += 1
            if pieces.nul:
                ok = np.flatnonzero(starts + width <= last.take(starts))
                starts, states = starts.take(ok), states.take(ok)
            hit = np.flatnonzero(pieces.final.take(states) >= 0)
            node = starts.take(hit)
            rank = count.take(node)
            count[node] = rank + 1
            found.append((node, rank, states.take(hit), width))
        self.first = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
        # edges by their node, of a node by width
        state, wide = np.zeros(self.first[-1], np.int64), np.zeros(self.first[-1], np.int64)
        for node, rank, to, width in found:
            rank += self.first.take(node)
            state[rank], wide[rank] = to, width
        del found
        frm = np.repeat(np.arange(total), count)
        self.to, self.piece, w = frm + wide, pieces.final.take(state), pieces.logp.take(state)
        beta = np.full(total, -np.inf)                         # log backward mass: a long unit's is far below any double
        beta[self.root + length] = 0.0
        place = np.arange(total) - np.repeat(self.root, length + 1)
        weight = np.zeros(len(frm))
        begins = place[frm]
        deepest = int(begins.max()) if len(frm) else -1
        # edges by where in the unit they start; short numbers are sorted by digits
        by_place = np.argsort(begins.astype(np.uint16) if deepest < 1 << 16 else begins, kind="stable")
        bound = np.concatenate(([0], np.cumsum(np.bincount(begins, minlength=deepest + 1))))
        for k in range(deepest, -1, -1):                       # from the units' ends backward
            at = by_place[bound[k]:bound[k + 1]]
            if len(at):
                x = w.take(at) + beta.take(self.to.take(at))
                weight[at] = x
                f = frm.take(at)
                cut = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
                most = np.maximum.reduceat(x, cut)
                x -= np.repeat(most, np.diff(np.concatenate((cut, [len(at)]))))
                beta[f.take(cut)] = most + np.log(np.add.reduceat(np.exp(x), cut))
        self.logp = weight - beta.take(frm)
        self.p = np.exp(self.logp)
        running = np.cumsum(self.p)
        opens = self.first.take(frm)
        self.cum = running - (running.take(opens) - self.p.take(opens))
        self.inner = count > 0                                 # whether a node has edges
        self.rest = 1 - self.p
        # where little is left, the other edges are added up: no mass is lost to the difference
        near = np.flatnonzero(self.rest < 1e-4)
        lo, hi = self.first[frm[near]], self.first[frm[near] + 1]
        n = hi - lo
        if len(near):
            every = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            other = np.where(every == np.repeat(near, n), 0.0, self.p[every])
            self.rest[near] = np.add.reduceat(other, np.cumsum(n) - n)
        with np.errstate(divide="ignore"):
            self.log_rest = np.log(self.rest)


class LatticeMemory:
    """Lattices of units met before, by the units' hashes.

    New units' lattices are appended to the remembered ones for their batch;
    they stay up to ``KEPT_EDGES`` edges in all.  When most units of a batch are
    new to a full memory, it starts again.
    """

    def __init__(self):
        self.hash, self.root = np.zeros(0, _U), np.zeros(0, np.int64)
        self.nodes = self.edges = 0
        self.full = False
        self.held: dict[str, np.ndarray] = {}
        self.view: Lattices | None = None                      # what was last returned

    def lattices(self, pieces: Pieces, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """Lattices that hold the units ``buf[s:e]`` of distinct, rising hashes
        ``h`` (among others, valid up to the next call), and their roots."""
        place, new = self._find(h)
        if self.full and 2 * int(new.sum()) > len(h):
            self.__init__()
            place, new = self._find(h)
        if len(h) and not new.any():
            return self.view, self.root[place]
        fresh = Lattices(pieces, buf, s[new], e[new])
        nodes, edges = self.nodes + len(fresh.inner), self.edges + len(fresh.to)
        self.view = both = Lattices.__new__(Lattices)
        both.first = self._append("first", self.nodes, fresh.first + self.edges)
        both.inner = self._append("inner", self.nodes, fresh.inner)
        both.to = self._append("to", self.edges, fresh.to + self.nodes)
        for name in ("piece", "logp", "p", "cum", "log_rest"):
            setattr(both, name, self._append(name, self.edges, getattr(fresh, name)))
        root = np.empty(len(h), np.int64)
        root[new] = both.root = fresh.root + self.nodes
        root[~new] = self.root[place[~new]]
        if edges > KEPT_EDGES:
            self.full = True
        elif not self.full:
            self.hash, self.root = np.insert(self.hash, place[new], h[new]), np.insert(self.root, place[new], both.root)
            self.nodes, self.edges = nodes, edges
        return both, root

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.hash, h)
        new = np.ones(len(h), bool)
        inside = place < len(self.hash)
        new[inside] = self.hash[place[inside]] != h[inside]
        return place, new

    def _append(self, name: str, at: int, values: np.ndarray) -> np.ndarray:
        """The remembered values, up to ``at``, and ``values`` after them."""
        end = at + len(values)
        held = self.held.get(name)
        if held is None or len(held) < end:
            grown = np.empty(end + end // 4, values.dtype)
            if held is not None:
                grown[:at] = held[:at]
            held = self.held[name] = grown
        held[at:end] = values
        return held[:end]


def _uniform(seed: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) by a counter."""
    return _of_bits(mix(seed + _counter(count)))


def _counter(count: np.ndarray) -> np.ndarray:
    return mix(count.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1))


def _of_bits(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def walk(lat: Lattices, node: np.ndarray, seed: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ancestral samples: from each node an edge at a time to its unit's end.
    Returns (walker, edge), ordered by walker and step.  ``seed`` and ``unit``
    name the random stream of each walker."""
    who, edges, step = [], [], 0
    live = np.flatnonzero(lat.inner.take(node))
    at, seeds, units_ = node.take(live), seed.take(live), unit.take(live) << 32
    while len(live):
        u = _uniform(seeds, units_ + step)
        lo, e = lat.first.take(at), lat.first.take(at + 1) - 1
        # the first edge whose running sum passes u, sought from the last one: long pieces take most of the mass
        open_ = np.flatnonzero(e > lo)
        open_ = open_.compress(u.take(open_) < lat.cum.take(e.take(open_) - 1))
        while len(open_):
            back = e.take(open_) - 1
            e[open_] = back
            more = np.flatnonzero(back > lo.take(open_))
            more = more.compress(u.take(open_.take(more)) < lat.cum.take(back.take(more) - 1))
            open_ = open_.take(more)
        who.append(live)
        edges.append(e)
        at = lat.to.take(e)
        more = np.flatnonzero(lat.inner.take(at))
        live, at, seeds, units_, step = live.take(more), at.take(more), seeds.take(more), units_.take(more), step + 1
    steps = np.zeros(len(node), np.int64)
    for w in who:
        steps[w] += 1
    offset = np.cumsum(steps) - steps
    out = np.zeros(int(steps.sum()), np.int64)
    for i, (w, e) in enumerate(zip(who, edges)):
        out[offset[w] + i] = e
    return np.repeat(np.arange(len(node)), steps), out


class _Path:
    """A sampled segmentation: edges, the unit of each edge, log p of each."""

    __slots__ = ("edge", "unit", "logp", "priority", "before")

    def __init__(self, edge, unit, logp, priority):
        self.edge, self.unit, self.logp, self.priority = edge, unit, logp, priority


def sample_segmentations(pieces: Pieces, texts: list[str], keys: np.ndarray, k: int, seed: int = 0):
    """For each text, up to ``k`` distinct segmentations drawn without
    replacement, as (ids, log probability, log inclusion) in order of priority.

    Perturbed best-first (A*) search: an agenda entry is the set of all paths
    that share a prefix and take none of certain edges next.  Its log mass is
    exact (prefix probability times the backward mass of what is left), and its
    priority is the greatest of its paths' Gumbel-perturbed log probabilities,
    drawn as a Gumbel variate at that mass cut off at its parent's priority.
    The entry with the highest priority is taken; a path drawn from it is the
    next sample, and what is left of the entry splits at every node of the new
    path.  Entries whose mass is so small that no draw could lift them to the
    agenda's top are not opened.  Texts with fewer segmentations give them all.

    With kappa the priority left on the agenda's top, a segmentation's
    inclusion score is 1 - exp(-exp(log p - kappa)).
    """
    buf, s, e, doc, lone = units(pieces, texts)
    h = range_hashes(buf, s, e)
    plain = np.flatnonzero(~lone)
    distinct, index, which = np.unique(h[plain], return_index=True, return_inverse=True)
    lat, roots = pieces.memory.lattices(pieces, buf, s[plain[index]], e[plain[index]], distinct)
    root = np.full(len(s), -1, np.int64)
    root[plain] = roots[which]
    bound = np.searchsorted(doc, np.arange(len(texts) + 1))
    place = np.arange(len(s)) - bound[doc]
    base = mix(keys.astype(_U) + _U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & ((1 << 64) - 1)))
    log_edge = lat.logp

    def fresh(walkers: np.ndarray, node: np.ndarray, round_: int):
        stream = mix(base[doc[walkers]] ^ _U(round_ * 0x51ED270B + 77))
        who, edge = walk(lat, node, stream, place[walkers])
        return walkers[who], edge

    counters = _counter(np.arange(_LIMIT))

    def exponentials(tag: int, steps: np.ndarray):
        """For each text, its function of how many exponential variates' logarithms
        to draw; those of the first ``_LIMIT`` of its ``steps`` are drawn at once."""
        streams = mix(base ^ _U(tag * 0x2545F491 + 991))
        size = np.minimum(steps, _LIMIT)
        end = np.cumsum(size)
        at = np.arange(int(end[-1])) - np.repeat(end - size, size)
        first = np.log(-np.log(_of_bits(mix(np.repeat(streams, size) + counters.take(at)))))

        def draw(d: int, n: int) -> np.ndarray:
            nonlocal counters
            if n <= size[d]:
                return first[end[d] - size[d]:end[d] - size[d] + n]
            if n > len(counters):
                counters = _counter(np.arange(n))
            return np.log(-np.log(_of_bits(mix(streams[d] + counters[:n]))))

        return draw

    unit, edge = fresh(plain, root[plain], 0)
    cut = np.searchsorted(doc[unit], np.arange(len(texts) + 1))
    paths: list[list[_Path]] = []
    agenda: list[list] = []
    draw = exponentials(1, np.diff(cut))
    tops = -np.log(-np.log(_uniform(base, np.zeros(len(texts), np.int64))))
    for d in range(len(texts)):
        a, b = cut[d], cut[d + 1]
        paths.append([_Path(edge[a:b], unit[a:b], log_edge[edge[a:b]], float(tops[d]))])
        agenda.append([])
        _open(lat, agenda[d], paths[d][0], 0, 0.0, (), lambda n, d=d: draw(d, n), k)
    for round_ in range(1, k):
        taken, walkers, nodes, heads = [], [], [], []
        for d in range(len(texts)):
            if not agenda[d]:
                continue
            best = max(range(len(agenda[d])), key=lambda i: agenda[d][i][0])
            priority, parent, t, without, before = agenda[d].pop(best)
            lo, p = _masses(lat, parent, t, without)
            u = _uniform(base[d:d + 1] ^ _U(round_ * 0x1F123BB5 + 5), np.array([t]))[0] * p.sum()
            pick = min(int(np.searchsorted(np.cumsum(p), u, "right")), len(p) - 1)
            pick = lo + (pick if p[pick] else int(p.argmax()))
            at = parent.unit[t]
            taken.append((d, parent, t, without, before, pick, priority))
            own = np.arange(at + 1, bound[d + 1])
            own = own[~lone[own]]
            heads.append((at, lat.to[pick]))
            walkers.append(np.concatenate(([at], own)))
            nodes.append(np.concatenate(([lat.to[pick]], root[own])))
        if not taken:
            break
        unit, edge = fresh(np.concatenate(walkers), np.concatenate(nodes), round_)
        cut = np.searchsorted(doc[unit], np.arange(len(texts) + 1))
        steps = np.diff(cut)
        steps[[x[0] for x in taken]] += 1                      # the picked edge
        draw = exponentials(round_ + 1, steps)
        for d, parent, t, without, before, pick, priority in taken:
            a, b = cut[d], cut[d + 1]
            new = _Path(np.concatenate((parent.edge[:t], [pick], edge[a:b])), np.concatenate((parent.unit[:t], [parent.unit[t]], unit[a:b])), None, priority)
            new.logp = np.concatenate((parent.logp[:t], [log_edge[pick]], log_edge[edge[a:b]]))
            paths[d].append(new)
            _open(lat, agenda[d], new, t, before, (*without, pick), lambda n, d=d: draw(d, n), k)
    odd = np.flatnonzero(lone)
    size = e[odd] - s[odd]
    cut = np.concatenate(([0], np.cumsum(size)))
    spelt = pieces.byte_id[buf[np.repeat(s[odd] - cut[:-1], size) + np.arange(int(cut[-1]))]].astype(np.int32)
    own = np.searchsorted(odd, bound)
    out = []
    for d in range(len(texts)):
        a, b = own[d], own[d + 1]
        kappa = max((x[0] for x in agenda[d]), default=-np.inf)
        found = []
        for path in paths[d]:
            lp = float(path.logp.sum())
            x = lp - kappa
            inclusion = 0.0 if x > 700 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x
            found.append((_ids(lat, path, odd[a:b], size[a:b], spelt[cut[a]:cut[b]]), lp, inclusion))
        out.append(found)
    return out


def _node(lat: Lattices, path: _Path, t: int) -> int:
    """Node where step ``t`` of a path starts."""
    return int(np.searchsorted(lat.first, path.edge[t], "right") - 1)


def _masses(lat: Lattices, path: _Path, t: int, without: tuple) -> tuple[int, np.ndarray]:
    """The first edge of the node where step ``t`` of a path starts, and the
    probabilities of its edges, zero for those in ``without``."""
    node = _node(lat, path, t)
    lo = int(lat.first[node])
    p = lat.p[lo:int(lat.first[node + 1])].copy()
    p[[int(e) - lo for e in without]] = 0.0
    return lo, p


def _open(lat: Lattices, agenda: list, path: _Path, t: int, before: float, without: tuple, draws, k: int) -> None:
    """Split what is left of the entry that ``path`` was drawn from (it left
    the prefix at step ``t``, where ``without`` are the edges it may not take,
    its own included) into one entry for each node from ``t`` on."""
    n = len(path.edge) - t
    if n <= 0:
        return
    limit = _LIMIT
    while True:
        m = min(limit, n)
        logp = path.logp[t:t + m]
        mass = np.zeros(m + 1)
        np.cumsum(logp, out=mass[1:])
        mass += before
        log_rest = lat.log_rest.take(path.edge[t:t + m])
        if without:
            least = _masses(lat, path, t, without)[1].sum()
            log_rest[0] = np.log(least) if least > 0 else -np.inf
        low = draws(m) - (mass[:-1] + log_rest)                # an entry's priority falls as this rises
        least = np.partition(low, k)[k] if len(low) > k else np.inf
        # an unopened entry's priority cannot exceed its mass by more than _REACH
        if m == n or (len(low) > k and -np.logaddexp(-path.priority, least) > mass[m] + _REACH):
            break
        limit *= 4
    # draws far above the parent's priority are cut off to that very number: all are kept, the first ones win
    keep = np.flatnonzero(low <= max(least, -path.priority - 30))
    keep = keep[low[keep] < np.inf]                            # no other edge to take
    g = -np.logaddexp(-path.priority, low[keep])
    for i in np.argsort(-g, kind="stable")[:k + 1]:
        at = int(keep[i])
        step = t + at
        agenda.append((float(g[i]), path, step, without if step == t and without else (int(path.edge[step]),), float(mass[at])))


def _ids(lat: Lattices, path: _Path, odd: np.ndarray, size: np.ndarray, spelt: np.ndarray) -> np.ndarray:
    """Ids of a path, with the bytes ``spelt`` of the characters ``odd`` that
    have no piece, ``size`` for each."""
    ids = lat.piece[path.edge].astype(np.int32)
    if not len(odd):
        return ids
    at = np.repeat(np.searchsorted(path.unit, odd), size) + np.arange(len(spelt))     # a path's units rise
    out = np.empty(len(ids) + len(spelt), np.int32)
    own = np.ones(len(out), bool)
    own[at] = False
    out[at], out[own] = spelt, ids
    return out
