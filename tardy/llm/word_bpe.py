"""BPE encoding over a trie of distinct words, and decoding.

The encoding of a string by ranked merges has a local test: a sequence of
tokens is the encoding exactly if each token is what its own symbols merge to
and no merge would have joined two neighbours before their own merges were
done.  So every prefix of a word has one last token: the one that ends there
and fits the last token of the prefix before it.  The distinct words of a batch
make a trie in which the last tokens of all prefixes are handed down, so a
prefix that many words share is encoded once, and a word's tokens are read off
by walking back from its end.  Words of ordinary length take a level of the trie
at a time, in numpy; longer ones go depth-first through a trie whose edges carry
strings.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.llm.piece_lattice import ByteTrie
from tardy.llm.text import batches, mix

#: characters of text that are encoded at once
BATCH_CHARS = 1 << 20
#: bytes that a Python worker spends about on remembered encodings
MEMORY = 256 << 20
#: symbols of words that take a level of the trie at a time
LEVELS = 32
_PAIRS = 1 << 19                # pairs of neighbours whose test is remembered in arrays
_END = 256                      # symbols: bytes, and bytes that end a word


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: printable
    Latin-1 signs stand for themselves, the others follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def token_names(kind: dict) -> list[str]:
    """Each id's token, empty for ids that are none."""
    named = [*kind["model"]["vocab"].items(), *((t["content"], t["id"]) for t in kind["added_tokens"])]
    out = [""] * (max((i for _, i in named), default=-1) + 1)
    for name, i in named:
        out[i] = name
    return out


class WordTrie:
    """Trie of strings; an edge holds a string, a node a word number or -1."""

    def __init__(self):
        self.root: list = [{}, -1]              # [first character -> (edge, node), word number]

    def insert(self, word: str, number: int) -> None:
        node = self.root
        while word:
            held = node[0].get(word[0])
            if held is None:
                node[0][word[0]] = (word, [{}, number])
                return
            edge, child = held
            if word.startswith(edge):
                node, word = child, word[len(edge):]
                continue
            k = 1
            top = min(len(edge), len(word))
            while k < top and edge[k] == word[k]:
                k += 1
            middle: list = [{edge[k]: (edge[k:], child)}, -1]
            node[0][word[0]] = (edge[:k], middle)
            node, word = middle, word[k:]
        node[1] = number


class WordBPE:
    """Encoder of a word-level BPE tokenizer (``tokenizers`` JSON with a byte
    alphabet and a word-end suffix)."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        kind = json.loads(spec)
        model = kind["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a plain BPE model with a word-end suffix is needed")
        for t in kind["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("added tokens must match as they stand")
        self.tool = Tokenizer.from_str(spec)
        self.added = {t["content"]: t["id"] for t in kind["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        n = len(token_names(kind))
        signs = _byte_signs()
        self.byte_of = {ord(s): chr(b) for b, s in enumerate(signs)}
        # every token's symbols, the rank of the merge that makes it, and its halves
        self.symbols: dict[str, int] = {}
        for b, s in enumerate(signs):
            self.symbols[chr(b)] = vocab[s]
            self.symbols[chr(b + _END)] = vocab[s + suffix]
        self.rank = [-1] * n
        self.left, self.right = [-1] * n, [-1] * n
        self.merge: dict[int, int] = {}
        spelt = {i: s for s, i in self.symbols.items()}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if k in spelt or i not in spelt or j not in spelt:
                raise ValueError(f"token {a + b!r} is made by two merges or before its parts")
            self.rank[k], self.left[k], self.right[k] = r, i, j
            self.merge[i << 32 | j] = r
            spelt[k] = spelt[i] + spelt[j]
            self.symbols[spelt[k]] = k
        self.length = [0] * n
        # tokens by their symbols read backwards: for each state, symbol -> state; state -> token
        self.back: list[dict[str, int]] = [{}]
        self.token: list[int] = [-1]
        valid = {i: self.rank[i] < 0 or self.compatible(self.left[i], self.right[i], self.rank[i]) for i in spelt}
        for i in sorted(spelt, key=lambda i: self.rank[i]):
            self.length[i] = len(spelt[i])
            if self.rank[i] >= 0:                                    # halves that never arise make no token
                valid[i] = valid[i] and valid[self.left[i]] and valid[self.right[i]]
            if not valid[i]:
                continue
            state = 0
            for c in reversed(spelt[i]):
                after = self.back[state].get(c)
                if after is None:
                    after = self.back[state][c] = len(self.token)
                    self.back.append({})
                    self.token.append(-1)
                state = after
            self.token[state] = i
        self.steps = ByteTrie([{ord(c): to for c, to in d.items()} for d in self.back], 2 * _END)
        self.token_at = np.full(len(self.steps.base), -1, np.int64)
        self.token_at[self.steps.slot] = self.token
        self.ranks, self.lefts, self.rights = (np.array(x, np.int64) for x in (self.rank, self.left, self.right))
        self.pairs = np.array(sorted(self.merge), np.int64)
        self.pair_ranks = np.array([self.merge[x] for x in self.pairs.tolist()], np.int64)
        self.plain = _plain_rule(kind)
        self.marks = re.compile("|".join(map(re.escape, filter(None, self.added))) or r"(?!)")
        self.forget()

    def compatible(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether tokens ``a``, ``b`` stay neighbours: undoing the latest merge
        of either side step by step, no merge of the two that touch comes before
        the merge that was undone.  With ``until``, they stay apart up to that
        merge, their own."""
        rank, merge = self.rank, self.merge
        first = until is not None
        limit, leftmost = (until, False) if first else (len(merge), False)
        while True:
            m = None if first else merge.get(a << 32 | b)
            # of equal merges the left one comes first
            if m is not None and (m < limit or (m == limit and leftmost)):
                return False
            first = False
            if rank[b] >= rank[a]:
                if rank[b] < 0:
                    return True
                limit, leftmost, b = rank[b], True, self.left[b]
            else:
                limit, leftmost, a = rank[a], False, self.right[a]

    def _compatible_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`compatible` of arrays of tokens."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        limit, leftmost = np.full(len(a), len(self.pairs)), np.zeros(len(a), bool)
        while len(live) and len(self.pairs):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            m = self.pair_ranks[at]
            bad = (self.pairs[at] == key) & ((m < limit) | ((m == limit) & leftmost))
            out[live[bad]] = False
            right, left = self.ranks[b], self.ranks[a]
            go = np.flatnonzero(~bad & (np.maximum(left, right) >= 0))
            live, a, b, left, right = live[go], a[go], b[go], left[go], right[go]
            leftmost = right >= left
            limit = np.where(leftmost, right, left)
            a, b = np.where(leftmost, a, self.rights[a]), np.where(leftmost, self.lefts[b], b)
        return out

    def _fit_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_compatible_many`, remembered; of pairs that share a place the last one."""
        key = a << 32 | b
        place = (mix(key.view(np.uint64)) & np.uint64(_PAIRS - 1)).view(np.int64)
        out = self.pair_fits.take(place)
        miss = np.flatnonzero(self.pair_keys.take(place) != key)
        if len(miss):
            new, which = np.unique(key[miss], return_inverse=True)
            fits = self._compatible_many(new >> 32, new & 0xFFFFFFFF)[which]
            out[miss] = fits
            last = np.unique(place[miss][::-1], return_index=True)[1]
            miss, fits = miss[::-1][last], fits[::-1][last]
            self.pair_keys[place[miss]], self.pair_fits[place[miss]] = key[miss], fits
        return out

    def encode_levels(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of sorted distinct words, a byte a character, one word
        after the other, and each word's number of them."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols[np.cumsum(length) - 1] += _END
        start = np.cumsum(length) - length
        total = len(symbols) + 1                     # nodes at most; 0 is the root
        symbol, parent = np.zeros(total, np.int64), np.zeros(total, np.int64)
        # of each prefix: its last token, the prefix before that, the number of tokens
        last, prev, count = np.full(total, -1), np.zeros(total, np.int64), np.zeros(total, np.int64)
        at, made = np.zeros(len(words), np.int64), 1
        live, depth = np.arange(len(words)), 0
        while len(live):
            c, up = symbols.take(start.take(live) + depth), at.take(live)
            new = np.ones(len(live), bool)
            new[1:] = (c[1:] != c[:-1]) | (up[1:] != up[:-1])
            at[live] = made - 1 + np.cumsum(new)
            new = np.flatnonzero(new)
            node = np.arange(made, made + len(new))
            made += len(new)
            symbol[node], parent[node] = c.take(new), up.take(new)
            self._last_tokens(node, symbol, parent, last, prev)
            count[node] = count.take(prev.take(node)) + 1
            depth += 1
            live = live.compress(length.take(live) > depth)
        n = count.take(at)
        end = np.cumsum(n)
        ids = np.empty(int(end[-1]) if len(end) else 0, np.int32)
        live = np.flatnonzero(at)
        while len(live):
            here = at.take(live)
            end[live] -= 1
            ids[end.take(live)] = last.take(here)
            at[live] = prev.take(here)
            live = live.compress(at.take(live) > 0)
        return ids, n

    def _last_tokens(self, node: np.ndarray, symbol: np.ndarray, parent: np.ndarray, last: np.ndarray, prev: np.ndarray) -> None:
        """Sets the last tokens of a level's nodes: of the tokens that end
        there, the one that fits the last token of the prefix before it."""
        base, owner = self.steps.base, self.steps.owner
        up, state = node, np.ones(len(node), np.int64)
        while len(node):
            to = base.take(state) + symbol.take(up)
            go = np.flatnonzero(owner.take(to) == state)
            node, state, up = node.take(go), to.take(go), parent.take(up.take(go))
            token = self.token_at.take(state)
            ends = np.flatnonzero(token >= 0)
            t, before, mine, here = token.take(ends), last.take(up.take(ends)), node.take(ends), up.take(ends)
            fits = here == 0
            check = np.flatnonzero(before >= 0)
            fits[check] = self._fit_many(before.take(check), t.take(check))
            last[mine[fits]], prev[mine[fits]] = t[fits], here[fits]
            done = up == 0
            done[ends[fits]] = True
            go = np.flatnonzero(~done)
            node, state, up = node.take(go), state.take(go), up.take(go)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of words given as symbols, depth-first."""
        trie = WordTrie()
        for i, w in enumerate(words):
            trie.insert(w, i)
        out: list[list[int]] = [[]] * len(words)
        back, token, length, fits = self.back, self.token, self.length, self.fits
        symbol: list[str] = []                       # symbols of the prefix, and the last token of each prefix of it
        last: list[int] = [-1]
        stack = [(edge, node, 0) for edge, node in trie.root[0].values()]
        while stack:
            edge, node, depth = stack.pop()
            del symbol[depth:], last[depth + 1:]
            symbol += edge
            for depth in range(depth + 1, depth + len(edge) + 1):
                state, at, best = 0, depth, -1
                while at:
                    at -= 1
                    state = back[state].get(symbol[at])
                    if state is None:
                        break
                    t = token[state]
                    if t >= 0:
                        before = last[at]
                        if before < 0:
                            if at == 0:
                                best = t
                        else:
                            key = before << 32 | t
                            ok = fits.get(key)
                            if ok is None:
                                ok = fits[key] = self.compatible(before, t)
                            if ok:
                                best = t
                                break
                last.append(best)
            if node[1] >= 0:
                ids, at = [], depth
                while at:
                    ids.append(last[at])
                    at -= length[last[at]]
                out[node[1]] = ids[::-1]
            stack += [(e, child, depth) for e, child in node[0].values()]
        return out

    def forget(self) -> None:
        """Drop what is remembered (memory only)."""
        self.fits: dict[int, bool] = {}              # neighbours -> whether they stay apart
        self.pair_keys, self.pair_fits = np.full(_PAIRS, -1), np.zeros(_PAIRS, bool)
        self.known: dict[str, int] = {"": 0}         # stretch -> number
        self.ids, self.first = array("i"), array("q", [0, 0])
        # word -> number, and the words' ids; a line end closes a stretch
        self.word = {"\n": 0, **{w: i + 1 for i, w in enumerate(self.added)}}
        self.word_ids, self.word_first = array("i", self.added.values()), array("q", [0, *range(len(self.added) + 1)])
        self.kept = 0

    def learn(self, stretches: set[str]) -> None:
        """Encode stretches without spaces: normalised and cut into words by
        the tokenizer's own rules, the distinct words in one trie."""
        self._make_room()
        collecting = gc.isenabled()
        gc.disable()                                 # many small lists and no cycles: nothing to be found among them
        try:
            self._learn(stretches)
        finally:
            if collecting:
                gc.enable()

    def _make_room(self) -> None:
        if self.kept + 150 * len(self.fits) > MEMORY:
            self.forget()

    def _learn(self, stretches: set[str]) -> None:
        known, word = self.known, self.word
        new, words = self._cut(list(stretches.difference(known)))
        fresh = sorted(set(words).difference(word))
        short = [w for w in fresh if len(w) <= LEVELS]
        self._keep(short, *self.encode_levels(short))
        long = [w for w in fresh if len(w) > LEVELS]
        if long:
            ids = self.encode_words([w[:-1] + chr(ord(w[-1]) + _END) for w in long])
            self._keep(long, np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64))
        known.update(zip(new, range(len(known), len(known) + len(new))))
        number = np.fromiter(map(word.__getitem__, words), np.int64, len(words))
        ids, n = _ranges(self.word_ids, self.word_first, number)
        self.ids.frombytes(ids.tobytes())
        self.first.frombytes((self.first[-1] + np.cumsum(n)[number == 0]).tobytes())
        self.kept += sum(map(len, new)) + 250 * len(new) + 400 * len(fresh)

    def _keep(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        """Remember the ids of words."""
        self.word.update(zip(words, range(len(self.word), len(self.word) + len(words))))
        self.word_first.frombytes((self.word_first[-1] + np.cumsum(n)).tobytes())
        self.word_ids.frombytes(ids.tobytes())

    def _cut(self, stretches: list[str]) -> tuple[list[str], list[str]]:
        """The stretches in another order, and the words of all of them, a line
        end after each stretch's."""
        plain, other, single = [], [], []
        for s in stretches:
            (plain if s.isascii() else other).append(s)
        if self.plain is None or self.marks.search("\n".join(stretches)) or any("\n" in s for s in plain):
            single = [s for s in stretches if self.plain is None or self.marks.search(s) or "\n" in s]
            odd = set(single)
            plain, other = [s for s in plain if s not in odd], [s for s in other if s not in odd]
        if _SPACES.search("".join(other)):
            single += filter(_SPACES.search, other)
            other = [s for s in other if not _SPACES.search(s)]
        words = re.compile(self.plain.pattern + "|\n", re.ASCII).findall("\n".join([*plain, ""]).lower()) if plain else []
        if other:
            # no rule looks across a space, and the stretches hold none
            text = self.tool.normalizer.normalize_str(" ".join(other))
            ends = np.cumsum([len(p) + 1 for p in text.split(" ")])
            if len(ends) == len(other):
                pieces = self.tool.pre_tokenizer.pre_tokenize_str(text)
                bound = np.searchsorted(np.fromiter((at for _, (at, _) in pieces), np.int64, len(pieces)), ends).tolist()
                cut = "\n".join([w for w, _ in pieces]).translate(self.byte_of).split("\n") if pieces else []
                for a, b in zip([0, *bound], bound):
                    words += cut[a:b]
                    words.append("\n")
            else:
                other, single = [], single + other
        for s in single:
            words += self._words(s)
            words.append("\n")
        return plain + other + single, words

    def _words(self, stretch: str) -> list[str]:
        """Words of a stretch, a byte a character, and added tokens as they stand."""
        if stretch.isascii() and self.plain and not self.marks.search(stretch):
            return self.plain.findall(stretch.lower())
        out = []
        for added, part in self._split_added(stretch):
            if added:
                out.append(part)
            else:
                pieces = self.tool.pre_tokenizer.pre_tokenize_str(self.tool.normalizer.normalize_str(part))
                out += [w.translate(self.byte_of) for w, _ in pieces]
        return out

    def _split_added(self, text: str) -> list[tuple[bool, str]]:
        """(is an added token, part): text cut at added tokens, the leftmost
        first, of several the longest."""
        out: list[tuple[bool, str]] = []
        while text:
            found = [(text.find(t), -len(t), t) for t in self.added if t and t in text]
            if not found:
                return out + [(False, text)]
            at, _, t = min(found)
            if at:
                out.append((False, text[:at]))
            out.append((True, t))
            text = text[at + len(t):]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin).  No rule looks
        across a space or line end, so stretches between them are encoded."""
        lines = pa.array([(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts], pa.string())
        parts = pc.split_pattern(lines, " ")
        coded = parts.flatten().dictionary_encode()
        # no stretch holds a line end
        stretches = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\n")[0].as_py().split("\n")
        self._make_room()
        number = np.fromiter(map(self.known.get, stretches, repeat(-1)), np.int64, len(coded.dictionary))
        missing = np.flatnonzero(number < 0)
        new = [stretches[i] for i in missing.tolist()]
        if new:
            self.learn(set(new))
            number[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        ids, n = _ranges(self.ids, self.first, number.take(coded.indices.to_numpy()))
        cut = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))
        return ids, np.concatenate(([0], np.cumsum(n)))[cut]


#: what may count as white space, in any Unicode version
_SPACES = re.compile("[\\s\u180e\u200b-\u200f\u2060\ufeff]")


def _ranges(values: array, first: array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the numbered ranges, one after the other, and the ranges' sizes."""
    flat, first = np.frombuffer(values, np.int32) if len(values) else np.zeros(0, np.int32), np.frombuffer(first, np.int64)
    begin = first.take(number)
    n = first.take(number + 1) - begin
    begin -= np.cumsum(n) - n
    at = np.repeat(begin, n)
    at += np.arange(len(at))
    return flat.take(at), n


def _plain_rule(kind: dict) -> re.Pattern | None:
    """The tokenizer's word pattern for ASCII stretches without spaces, where
    normalising is lower-casing; null if its rules are of another kind."""
    steps = [n["type"] for n in (kind.get("normalizer") or {}).get("normalizers", [])]
    cuts = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    split, signs = cuts
    if (split["behavior"], split["invert"], signs["add_prefix_space"], signs["use_regex"]) != ("Removed", True, False, False):
        return None
    pattern = split["pattern"].get("Regex", "").replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
    return None if r"\p" in pattern or "(" in pattern else re.compile(pattern, re.ASCII)


_LOADED: dict[int, WordBPE] = {}


def _load(spec: str) -> WordBPE:
    """The encoder of a tokenizer, made once for each Python worker."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBPE(spec)
    return _LOADED[key]


def _tokenizer(docs: DataFrame, path: str | None):
    """The tokenizer's JSON (a few MB) for the tasks, as a broadcast."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _columns(df: DataFrame, outs: list[str], last: str) -> tuple[list[str], DataFrame]:
    keep = [c for c in df.columns if c not in outs]
    return keep, df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{last}`").alias("_in"))


class Decoder:
    """Strings of token ids: the tokens joined by one space, as the library
    does for a tokenizer without a decoder."""

    def __init__(self, kind: dict):
        if kind.get("decoder"):
            raise ValueError("tokens are decoded by joining them with a space; the tokenizer asks for another decoder")
        names = token_names(kind)
        self.table = pa.array(names, pa.string())
        self.known = np.array([n != "" for n in names], bool)

    def decode(self, flat: np.ndarray, cut: np.ndarray) -> pa.Array:
        """One string for each range of ``flat`` between neighbours in ``cut``;
        ids that are no token are left out."""
        ok = (flat >= 0) & (flat < len(self.known))
        ok[ok] = self.known[flat[ok]]
        kept = np.concatenate(([0], np.cumsum(ok)))[cut]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), self.table.take(pa.array(flat[ok]))), " ")


def encode_texts(docs: DataFrame, text_col: str = "text", out: str = "ids", tokenizer: str | None = None, decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of every whole text in ``out`` (array of
    ints), as the ``tokenizers`` library encodes it without special tokens
    added; special tokens' strings inside a text are those tokens.  With
    ``decoded``, a column of that name holds what the ids decode to
    (:func:`decode_ids`), made in the same pass.

    A null or empty text has no ids.  A very long word takes time in proportion
    to its length.  Texts are encoded about a million characters at a time;
    repeated rows give equal ids; an empty table gives an empty result; columns
    named ``out`` or ``decoded`` are replaced, all others stay.
    """
    spec = _tokenizer(docs, tokenizer)
    outs = [out] + ([decoded] if decoded else [])
    keep, inner = _columns(docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")), outs, text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(spec.value)
        back = Decoder(json.loads(spec.value)) if decoded else None
        for batch in it:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in batches(texts, BATCH_CHARS):
                ids, cut = bpe.encode(texts[lo:hi])
                made = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids, pa.int32()))]
                if back:
                    made.append(back.decode(ids, cut))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *made],
                                                 names=[*batch.schema.names[:-1], *(f"_out{i}" for i in range(len(made)))])

    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(inner.dtypes[:-1])] + ["_out0 array<int>", "_out1 string"][:len(outs)])
    return inner.mapInArrow(run, schema).toDF(*keep, *outs)


def decode_ids(rows: DataFrame, ids_col: str = "ids", out: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """``rows`` with the string that the ids of ``ids_col`` decode to, special
    tokens included: the tokens joined by one space.

    Null or no ids give an empty string; a null or unknown id is left out.  A
    column named ``out`` is replaced, all others stay; an empty table gives an
    empty result.
    """
    spec = _tokenizer(rows, tokenizer)
    keep, inner = _columns(rows, [out], ids_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(json.loads(spec.value))
        for batch in it:
            lists = batch.column(batch.num_columns - 1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            text = back.decode(flat, np.concatenate(([0], np.cumsum(n))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*batch.schema.names[:-1], "_out"])

    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(inner.dtypes[:-1])] + ["_out string"])
    return inner.mapInArrow(run, schema).toDF(*keep, out)
