"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

Method.  A sequence of tokens is what BPE gives for their bytes exactly if each
neighbouring pair is (a property of merge-ranked vocabularies).  So the last
token of each prefix of a pre-token, and with it the number of tokens, follows
from the last tokens of shorter prefixes.  That recurrence looks back no further
than the longest suffix that begins some token; the suffix together with the
last tokens and relative counts at its positions is what a state keeps of a
pre-token.  The split pattern is part of the same ``Machine``, which looks ahead
by what its states hold back (white space, apostrophes).  States are
determinised on demand; each transition, by one character, is annotated with the
number of tokens that the count changes by.  No token is ever built.

Every text is cut into chunks at any place.  A chunk's state map takes the state
before it to a count and the state after it.  Past its first synchronising place
(before a blank that follows something else) nothing depends on the state before
it, so a map is kept as (open head, tokens after it, state at the end); a chunk
without such a place is all head.  Maps compose associatively: the head of the
second is run from the end state of the first.  ``scan`` combines them pairwise,
level by level, as a parallel prefix scan does.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quernstone.llm.units import _CUT, SPECIAL, Units

#: What the vocabulary's split pattern cuts off after an apostrophe at the beginning of a pre-token.
SHORT_FORMS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Characters in a chunk.
CHUNK = 1 << 12
#: Determinised states, and counts of words, kept per process.
MAX_STATES, MAX_WORDS = 400_000, 800_000


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    """Token bytes -> rank, from a file of the public tokenizers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """What follows from the ranks alone: the BPE of a few bytes, which tokens may be neighbours, one byte more."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.single = [bytes((b,)) for b in range(256)]

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain BPE of a few bytes, by merging the lowest rank first."""
        parts, get = [self.single[b] for b in piece], self.ranks.get
        ranks = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < _NEVER:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], _NEVER)
        return parts

    def valid(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        out = self.pairs.get(key)
        if out is None:
            out = self.pairs[key] = self.merge(left + right) == [left, right]
        return out

    def extend(self, inner: tuple, byte: int) -> tuple[tuple, int]:
        """(suffix, last token at each of its positions, counts relative to the end) after one byte more, and what the count changes by."""
        suffix, last, rel = inner
        seen = suffix + self.single[byte]
        ranks, pairs = self.ranks, self.pairs
        for k, before in enumerate(last):  # longest candidate first; exactly one is valid
            token = seen[k:]
            if token in ranks and (before is None or (pairs[before, token] if (before, token) in pairs else self.valid(before, token))):
                break
        else:
            raise ValueError("a byte is missing from the vocabulary")
        delta = rel[k] + 1  # counts are kept relative to the end of the prefix
        keep, prefixes = 0, self.prefixes
        while keep < len(seen) and seen[keep:] not in prefixes:
            keep += 1
        return (seen[keep:], (*last[keep:], token), (*[r - delta for r in rel[keep:]], 0)), delta

    def run(self, inner: tuple, piece: bytes) -> tuple[tuple, int]:
        total = 0
        for byte in piece:
            inner, delta = self.extend(inner, byte)
            total += delta
        return inner, total

    def count(self, piece: bytes) -> int:
        return self.run(_EMPTY, piece)[1]


_EMPTY = (b"", (None,), (0,))
_NEVER = 1 << 60


class State(dict):
    """A state of the machine, as the table of its transitions: character -> (next state, tokens that the count changes by).

    ``kind`` is the kind of run it is in, ``inner`` what the vocabulary knows of the
    run, ``held`` are characters held back.
    """

    __slots__ = ("machine", "kind", "inner", "held")

    def __init__(self, machine: Machine, kind: str, inner: tuple, held: str):
        self.machine, self.kind, self.inner, self.held = machine, kind, inner, held

    def __missing__(self, c: str) -> tuple[State, int]:
        out = self[c] = self.machine.step(self, c)
        return out


class Machine:
    """The split pattern and the vocabulary as one transducer over characters."""

    def __init__(self, ranks: dict[bytes, int]):
        self.inner = Vocabulary(ranks)
        self.kinds: dict[str, str] = {}
        self.known: dict[tuple, State] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets all states; those that are still held elsewhere build their transitions anew."""
        for state in self.known.values():
            state.clear()  # they refer to each other
        self.known.clear()
        self.inner.pairs.clear()
        self.start = self.state("start", _EMPTY, "")

    def state(self, kind: str, inner: tuple, held: str) -> State:
        key = (kind, inner, held)
        out = self.known.get(key)
        if out is None:
            out = self.known[key] = State(self, kind, inner, held)
        return out

    def kind(self, c: str) -> str:
        out = self.kinds.get(c)
        if out is None:
            out = self.kinds[c] = "space" if c in _SPACES else "letter" if _LETTER(c) else "number" if _NUMBER(c) else "other"
        return out

    def begin(self, kind: str, piece: str) -> tuple[State, int]:
        """A run of a kind that begins with the characters."""
        inner, delta = self.inner.run(_EMPTY, _bytes(piece))
        return self.state(kind, inner, ""), delta

    def fresh(self, c: str) -> tuple[State, int]:
        """The first character of a pre-token."""
        kind = self.kind(c)
        if kind == "space":
            return self.state("space", _EMPTY, c), 0
        if c == "'":
            return self.state("short", _EMPTY, c), 0
        return self.begin(kind, c)

    def grow(self, state: State, c: str) -> tuple[State, int]:
        """One more character of a run of letters, numbers or others; another kind of character begins a pre-token."""
        if self.kind(c) != state.kind:
            return self.fresh(c)
        inner, delta = self.inner.run(state.inner, _bytes(c))
        return self.state(state.kind, inner, ""), delta

    def step(self, state: State, c: str) -> tuple[State, int]:
        """(next state, tokens that the count changes by), built once per state and character."""
        kind = self.kind(c)
        if state.kind == "start":
            return self.fresh(c)
        if state.kind == "space":  # the last blank of a run goes with what follows, any other last one stands alone
            if kind == "space":
                inner, delta = self.inner.run(state.inner, _bytes(state.held))
                return self.state("space", inner, c), delta
            if state.held == " ":
                return self.begin(kind, " " + c)
            after, delta = self.fresh(c)
            return after, delta + self.inner.count(_bytes(state.held))
        if state.kind == "short":  # an apostrophe that may begin a short form
            seen = state.held + c
            if seen in SHORT_FORMS:
                return self.start, self.inner.count(_bytes(seen))
            if any(s.startswith(seen) for s in SHORT_FORMS):
                return self.state("short", _EMPTY, seen), 0
            if len(seen) == 2 and kind == "other":
                return self.begin("other", seen)
            first = self.inner.count(b"'")
            if len(seen) == 2:
                after, delta = self.fresh(c)
                return after, delta + first
            run, letters = self.begin("letter", state.held[1:])
            after, delta = self.grow(run, c)
            return after, delta + first + letters
        return self.grow(state, c)

    def run(self, state: State, text: str) -> tuple[State, int]:
        """(state after the text, tokens that the count changes by)."""
        total = 0
        for c in text:
            state, delta = state[c]
            total += delta
        return state, total

    def final(self, state: State) -> int:
        """Tokens that the end of the text, or of its last pre-token, adds."""
        if state.kind == "space":
            return self.inner.run(state.inner, _bytes(state.held))[1]
        if state.kind == "short":
            return self.inner.count(b"'") + self.inner.count(_bytes(state.held[1:]))
        return 0

    def count(self, text: str) -> int:
        """Tokens of a text between two synchronising places."""
        if len(self.known) > MAX_STATES:
            self.reset()
        state, total = self.run(self.start, text)
        return total + self.final(state)


_SPACES = frozenset(c for a, b in [*zip("\t\u2000", "\r\u200a", strict=True)] for c in map(chr, range(ord(a), ord(b) + 1))) | frozenset(" \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000")
_LETTER, _NUMBER = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Counter:
    """Token counts of whole texts."""

    def __init__(self, ranks: dict[bytes, int] | None = None):
        self.machine = Machine(ranks or vocabulary())
        self.units = Units(self.machine.count, MAX_WORDS)

    def chunk_map(self, chunk: str) -> tuple[str, int | None, State | None]:
        """State map of a chunk: (open head, tokens after it or None, state at the end)."""
        first = _CUT.search(chunk)
        if first is None:
            return chunk, None, None
        lo, hi = first.start(), chunk.rfind(" ")
        while chunk[hi - 1] in _SPACES:
            hi = chunk.rfind(" ", 0, hi)
        state, tail = self.machine.run(self.machine.start, chunk[hi:])
        return chunk[:lo], sum(self.units.of(chunk[lo:hi])) + tail, state

    def compose(self, a: tuple, b: tuple) -> tuple:
        """Map of two neighbouring chunks from their maps (associative)."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        state, tokens = self.machine.run(a[2], b[0])
        if b[1] is None:
            return a[0], a[1] + tokens, state
        return a[0], a[1] + tokens + self.machine.final(state) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> int:
        """Total of a text from its chunks' maps, combined pairwise, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, rest, end = maps[0]
        total = self.machine.count(head)
        return total if rest is None else total + rest + self.machine.final(end)

    def __call__(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(self.scan([self.chunk_map(part[i : i + chunk]) for i in range(0, len(part), chunk)]) for part in parts if part)


_counter: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _counter:
        _counter[name] = Counter(vocabulary(name))
        # hundreds of thousands of live states: what lasts isn't looked at by every collection
        gc.freeze()
        gc.set_threshold(100_000, 20, 100)
    return _counter[name]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens and whether they exceed ``limit``.

    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows
    pass through; an empty table gives no rows; other columns are not read, so
    clashing names cannot occur.  No shuffle: one narrow pass over the texts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocab)
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1):
                s = text.as_py()
                sizes.append(len(s.encode("utf-8", "surrogatepass")) if s else 0)
                tokens.append(count(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
