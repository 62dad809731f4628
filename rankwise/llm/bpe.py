"""BPE encoding and decoding as streams.

Encoding is a transducer with bounded lookahead.  A token of the merge list is
at most ``horizon`` bytes long, so whatever follows can only change tokens
that reach into the last ``horizon`` bytes read: for every position there the
transducer keeps the one token that would end there (a prefix's encoding is
decided by its last token, and two tokens may stand side by side exactly if
merging their bytes gives them back).  Where the chains of all those
positions run together, everything before is stable and is emitted.  Between
pretokens the state is empty.  Every pretoken goes through the transducer;
most are shorter than the horizon and reach their end first, and the ids of
those are remembered.  Merging by rank only answers, once for each token and
each pair of neighbours, whether they stay as they are.

Decoding turns ids to bytes, and bytes to text by an incremental UTF-8 state
machine that holds at most an unfinished character.

Texts are read in slices that end between pretokens, ids are hashed or
written as they come: memory doesn't grow with a text, but for its ids where
they are asked for.

Defined results: a null or empty text has no tokens; repeated rows are encoded
one by one; the special token's string in a text is that token.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankwise.llm.common import text_slices

#: How a byte-level vocabulary cuts text before merging (a fixed value of the file format).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds of what is remembered, in entries.
WORDS, PAIRS = 100_000, 200_000
#: First bytes of a pretoken after which the state is remembered.
HEAD = 5
#: Characters cut into pretokens at once.
SLICE = 1 << 18


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Letters by which the file format writes bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Coder:
    """Encoder and decoder of one merge list (``file``: the tokenizer's JSON)."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        in_bytes = {t: bytes(letters[c] for c in t) for t in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = in_bytes[t]
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.sizes = list(map(len, self.bytes_of))
        self.id_of = {b: vocab[t] for t, b in in_bytes.items()}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        self.none = len(self.merged)
        self.made, self.parts = [-1] * size, [(0, 0)] * size
        for pair, rank in self.ranks.items():
            self.made[self.merged[rank]], self.parts[self.merged[rank]] = rank, pair
        if len(set(self.merged)) < self.none or any(self.made[p] >= r for r, m in enumerate(self.merged) for p in self.parts[m]):
            raise ValueError("a token with two merges, or made before its parts")
        #: Longest token that merging can make: what is read later can't reach back further.
        self.horizon = max(len(self.bytes_of[i]) for i in self.merged)
        self.cut = regex.compile(PRETOKENS).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.decimal = list(map(str, range(size)))
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.begun: dict[bytes, tuple[int, list[int]]] = {}
        #: Tree of the tokens' bytes: node << 8 | byte -> node; each node's parent and byte, and its token or -1.
        self.tree: dict[int, int] = {}
        self.above: list[tuple[int, int]] = [(0, 0)]
        self.token_at = [-1]
        for data, i in self.id_of.items():
            node = 0
            for byte in data:
                step = node << 8 | byte
                if step not in self.tree:
                    self.tree[step] = len(self.above)
                    self.above.append((node, byte))
                    self.token_at.append(-1)
                node = self.tree[step]
            self.token_at[node] = i
        self.shorter = [-1] * len(self.above)
        self.endings: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.above)
        self.jumps: dict[int, int] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merges by rank, the leftmost first: the definition, for short strings."""
        ids = [self.single[b] for b in data]
        get, none = self.ranks.get, self.none
        ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [self.merged[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives both; remembered.

        Their last merges are taken back one by one, the later first: nothing
        may have joined the two sides before it.  (Of two equal merges the left
        one is made first.)"""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        key, ok = a << 20 | b, True
        made, parts, none = self.made, self.parts, self.none
        before = none  # the rank of the merge taken back last
        while ok := self.ranks.get((a, b), none) >= before:
            if made[a] > made[b]:
                before, a = made[a], parts[a][1]
            elif made[b] >= 0:
                before, b = made[b] + 1, parts[b][0]
            else:
                break
        self.pairs[key] = ok
        return ok

    def jump(self, node: int, byte: int) -> int:
        """The longest end of the bytes read, ``byte`` included, that begins a token."""
        key = node << 8 | byte
        to = self.tree.get(key)
        if to is None:
            to = self.jumps.get(key)
        if to is None:
            to = self.jump(self.shorter_of(node), byte) if node else 0
            if len(self.jumps) >= PAIRS:
                self.jumps.clear()
            self.jumps[key] = to
        return to

    def shorter_of(self, node: int) -> int:
        """The longest proper end of a node's bytes that begins a token."""
        if self.shorter[node] < 0:
            parent, byte = self.above[node]
            self.shorter[node] = self.jump(self.shorter_of(parent), byte) if parent else 0
        return self.shorter[node]

    def ending(self, node: int) -> tuple[tuple[int, int], ...]:
        """Tokens (with their sizes) that a node's bytes end with, the longest first."""
        out = self.endings[node]
        if out is None:
            out = self.ending(self.shorter_of(node)) if node else ()
            token = self.token_at[node]
            if token >= 0:
                out = ((token, len(self.bytes_of[token])), *out)
            self.endings[node] = out
        return out

    def stands_alone(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        ok = self.alone.get(token)
        if ok is None:
            ok = self.alone[token] = self.merge(self.bytes_of[token]) == [token]
        return ok

    def read(self, data: Iterable[int], last: list[int], node: int) -> int:
        """Reads bytes from the state ``(last, node)``: ``last`` grows by the token that ends after each byte, the node
        (the longest end of the bytes read that begins a token) is returned."""
        edge, jumped, endings, known, alone = self.tree.get, self.jumps.get, self.endings, self.pairs.get, self.alone.get
        n = len(last)
        for byte in data:
            key = node << 8 | byte
            # every byte begins a token, so no step leads to the root (0)
            node = edge(key) or jumped(key) or self.jump(node, byte)
            n += 1
            for token, size in endings[node] or self.ending(node):
                if size < n:
                    left = last[-size]
                    ok = known(left << 20 | token)
                    if ok or ok is None and self.side_by_side(left, token):
                        break
                elif size == n:
                    ok = alone(token)
                    if ok or ok is None and self.stands_alone(token):
                        break
            last.append(token)
        return node

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one pretoken's bytes, each as soon as it is stable."""
        last: list[int] = []  # last[i]: the token that ends after byte i of those that are not emitted
        node = 0
        for part in batched(data, self.horizon):
            node = self.read(part, last, node)
            if len(last) >= 4 * self.horizon:
                stable = self._common(last)
                if stable:
                    done = self._chain(last, stable)
                    yield from done[:-1]
                    # the last stable token stays, as the left neighbour of what comes
                    keep = self.sizes[done[-1]]
                    last = [-1] * (keep - 1) + [done[-1]] + last[stable:]
        yield from self._chain(last, len(last))

    def begin(self, head: bytes) -> tuple[int, list[int]]:
        """The state after a pretoken's first bytes; remembered, as many pretokens begin alike."""
        state = self.begun.get(head)
        if state is None:
            last: list[int] = []
            state = self.read(head, last, 0), last
            if len(self.begun) >= PAIRS:
                self.begun.clear()
            self.begun[head] = state
        return state

    def _chain(self, last: list[int], end: int) -> list[int]:
        out, sizes = [], self.sizes
        while end > 0:
            token = last[end - 1]
            out.append(token)
            end -= sizes[token]
        return out[::-1]

    def _common(self, last: list[int]) -> int:
        """The latest position through which the chains from all positions of the horizon go."""
        ends = set(range(len(last) - self.horizon, len(last) + 1))
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(top - self.sizes[last[top - 1]])
        return max(0, ends.pop())

    def word(self, w: str) -> tuple[int, ...]:
        """Ids of a pretoken.  When the memory is full it becomes the older one, from which words in use come back."""
        ids = self.older.get(w)
        if ids is None:
            data = w.encode()
            if len(data) > 4 * self.horizon:
                return tuple(self.stream(data))
            # its end comes before anything would be emitted: one reading, then the chain back from the end
            node, last = self.begin(data[:HEAD])
            last = last.copy()
            self.read(data[HEAD:], last, node)
            ids = tuple(self._chain(last, len(last)))
        if len(self.words) >= WORDS:
            self.words, self.older = {}, self.words
        self.words[w] = ids
        return ids

    def slices(self, text: str) -> Iterator[str]:
        """Slices that end where a pretoken surely ends: before a space that follows something else."""
        at = 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
                end += 1
            yield text[at:end]
            at = end

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text, slice by slice."""
        word = self.word
        for part in self.split.split(text) if self.split else (text,):
            if part in self.special:
                yield [self.special[part]]
                continue
            for piece in self.slices(part):
                known = self.words.get
                yield list(chain.from_iterable([known(w) or word(w) for w in self.cut(piece)]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decoder(self) -> Callable[[Iterable[int], bool], str]:
        """A function that turns the next ids into the text that is complete by then."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        at = self.bytes_of.__getitem__
        return lambda ids, final=False: machine.decode(b"".join(map(at, ids)), final)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder()(ids, True)


_CODERS: dict[int, Coder] = {}


def _coder(file: bytes) -> Coder:
    """One coder per worker process; it is kept from task to task."""
    key = hash(file)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(file)
    return _CODERS[key]


def _shared_file(df: DataFrame, path: str | None):
    """The tokenizer's file, a few MB whatever the input, sent to every worker."""
    with open(path or default_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _map(docs: DataFrame, path: str | None, one, schema: str, names: list[str], carry: list[str]) -> DataFrame:
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"), *carry)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    file = _shared_file(rows, path)

    def apply(batches):
        coder = _coder(file.value)
        for b in text_slices(batches, 1):
            out = [one(coder, x or "") for x in b.column(1).to_pylist()]
            cols = [pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in _TYPES[schema]]
            cols = [c.cast(t) for c, t in zip(cols, _TYPES[schema], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *cols], names=["doc_id", *carry, *names])

    full = ", ".join([f"doc_id {kinds['doc_id']}", *[f"`{c}` {kinds[c]}" for c in carry], schema])
    return rows.mapInArrow(apply, full)


_IDS = "n_tokens bigint, ids array<int>"
_DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_TYPES = {_IDS: [pa.int64(), pa.list_(pa.int32())], _DIGEST: [pa.int64(), pa.string(), pa.string()]}


def encode(docs: DataFrame, *, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, carry..., n_tokens, ids``."""
    def one(coder: Coder, text: str):
        ids = coder.encode(text)
        return len(ids), ids
    return _map(docs, path, one, _IDS, ["n_tokens", "ids"], carry or [])


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, text``."""
    file = _shared_file(encoded, path)
    kind = dict(encoded.dtypes)["doc_id"]

    def apply(batches):
        coder = _coder(file.value)
        for b in batches:
            text = [coder.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(apply, f"doc_id {kind}, text string")


def _digest(coder: Coder, text: str) -> tuple[int, str, str]:
    """Hashes of the ids and of the decoded text, both taken as they come."""
    n, written, read, decoder = 0, hashlib.sha256(), hashlib.sha256(), coder.decoder()
    decimal = coder.decimal.__getitem__
    for ids in coder.blocks(text):
        if n and ids:
            written.update(b",")
        written.update(",".join(map(decimal, ids)).encode())
        read.update(decoder(ids).encode())
        n += len(ids)
    read.update(decoder((), True).encode())
    return n, written.hexdigest(), read.hexdigest()


def digest(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """The contract's columns."""
    return _map(docs, path, _digest, _DIGEST, ["n_tokens", "ids_sha256", "decoded_sha256"], [])
