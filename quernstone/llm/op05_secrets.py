"""Secret scan: base patterns and probabilistic automata inferred from labelled credentials.

Method.  For each family of credentials a prefix tree is built from labelled
examples over character classes.  States whose outgoing and final frequencies
are statistically compatible (Hoeffding bound, checked recursively) are merged
in red-blue order, which leaves a small deterministic probabilistic automaton.
Each transition keeps the counts of the characters that took it.  A candidate
is any part of a maximal run of credential characters, so that one glued to a
name, an address or other text is seen; every automaton starts at every place
and scores what it reads as bits per character against a uniform background.
The longest part that beats the family's limit, which labelled examples held
out from the inference set, is a secret.

The labelled examples are made from the published formats of the families; no
real credential and nothing of the corpus is in them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Labelled examples for the inference and for the limit, per family.
EXAMPLES, HELD_OUT = 160, 80
#: Confidence of the compatibility test.
ALPHA = 0.01
MARGIN = 0.35

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # shorter runs can't hold a match; a run is matched whole
#: Runs longer than this are read once from the right, which finds the places worth a start in linear time.
LONG_RUN = 512
#: A part that starts inside of another of its family is followed so far; credentials of the published formats are shorter.
OVERLAP = 512
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM, _URL = _UPPER + _LOWER + _DIGIT, _UPPER + _LOWER + _DIGIT + "-_"
#: Published formats: literal parts and (alphabet, least, most) parts.
FORMATS: dict[str, list] = {
    "aws": ["AKIA", (_UPPER + "234567", 16, 16)],
    "github": [("pousr", "ghp_ gho_ ghu_ ghs_ ghr_"), (_ALNUM, 36, 36)],
    "gitlab": ["glpat-", (_URL, 20, 20)],
    "slack": [("", "xoxb- xoxp-"), (_DIGIT, 11, 13), "-", (_DIGIT, 11, 13), "-", (_ALNUM, 24, 32)],
    "google": ["AIza", (_URL, 35, 35)],
    "stripe": [("", "sk_live_ sk_test_ rk_live_"), (_ALNUM, 24, 34)],
    "sendgrid": ["SG.", (_URL, 22, 22), ".", (_URL, 43, 43)],
    "npm": ["npm_", (_ALNUM, 36, 36)],
    "jwt": ["eyJhbGciOi", (_URL, 14, 40), ".eyJ", (_URL, 30, 120), ".", (_URL, 43, 43)],
}


def labelled(family: str, n: int, seed: int) -> list[str]:
    """Examples of a family by its published format."""
    rng = random.Random(f"{family}:{seed}")
    out = []
    for _ in range(n):
        parts = []
        for part in FORMATS[family]:
            if isinstance(part, str):
                parts.append(part)
            elif isinstance(part[1], str):
                parts.append(rng.choice(part[1].split()))
            else:
                parts.append("".join(rng.choices(part[0], k=rng.randint(part[1], part[2]))))
        out.append("".join(parts))
    return out


def _class(c: str) -> str:
    if c.isdigit():
        return "9"
    if c.isalpha():
        return "a" if c.islower() else "A"
    return c


class Automaton:
    """Deterministic probabilistic automaton by state merging."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.moves: list[dict[str, int]] = [{}]
        self.passed, self.final = [0], [0]
        self.chars: list[dict[str, dict[str, int]]] = [{}]
        for s in examples:
            self._insert(s)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _insert(self, s: str) -> None:
        q = 0
        for c in s:
            self.passed[q] += 1
            k = _class(c)
            if k not in self.moves[q]:
                self.moves[q][k] = len(self.moves)
                self.moves.append({})
                self.passed.append(0)
                self.final.append(0)
                self.chars.append({})
            seen = self.chars[q].setdefault(k, {})
            seen[c] = seen.get(c, 0) + 1
            q = self.moves[q][k]
        self.passed[q] += 1
        self.final[q] += 1

    def _count(self, q: int, k: str) -> int:
        return sum(self.chars[q].get(k, {}).values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        seen = set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            na, nb = self.passed[a], self.passed[b]
            if self._differ(self.final[a], na, self.final[b], nb):
                return False
            for k in self.chars[a].keys() | self.chars[b].keys():
                if self._differ(self._count(a, k), na, self._count(b, k), nb):
                    return False
                # a class that only ever was one letter on one side is a literal, not a random part
                x, y = self.chars[a].get(k, {}), self.chars[b].get(k, {})
                for c in x.keys() | y.keys():
                    if self._differ(x.get(c, 0), na, y.get(c, 0), nb):
                        return False
                if k in self.moves[a] and k in self.moves[b]:
                    todo.append((self.moves[a][k], self.moves[b][k]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the counts of the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.final[a] += self.final[b]
            for k, seen in self.chars[b].items():
                own = self.chars[a].setdefault(k, {})
                for c, n in seen.items():
                    own[c] = own.get(c, 0) + n
            for k, q in self.moves[b].items():
                if k in self.moves[a]:
                    todo.append((self.moves[a][k], q))
                else:
                    self.moves[a][k] = q

    def _merge_states(self) -> None:
        red, blue = [0], sorted((q, 0, k) for k, q in self.moves[0].items())
        while blue:
            b, parent, k = blue.pop(0)
            if self.moves[parent].get(k) != b or b in red:
                continue
            for r in red:
                if self._compatible(r, b):
                    self.moves[parent][k] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            blue = sorted((q, r, x) for r in red for x, q in self.moves[r].items() if q not in red)
        keep = {q: i for i, q in enumerate(red)}
        self.passed, self.final = [self.passed[q] for q in red], [self.final[q] for q in red]
        self.chars = [self.chars[q] for q in red]
        self.moves = [{k: keep[x] for k, x in self.moves[q].items()} for q in red]
        self.table = []
        for q in range(len(red)):
            row = {}
            for k, x in self.moves[q].items():
                sizes = {"9": 10, "a": 26, "A": 26}.get(k, 1)
                for c in {"9": _DIGIT, "a": _LOWER, "A": _UPPER}.get(k, k):
                    n = self.chars[q].get(k, {}).get(c, 0)
                    row[c] = (math.log2((n + 0.05) / (self.passed[q] + 0.05 * sizes)) + 6, x)
            self.table.append((row, math.log2((self.final[q] + 0.02) / (self.passed[q] + 0.02))))

    def bits(self, s: str) -> float:
        """Bits per character above a uniform background; minus infinity if it doesn't parse."""
        q, total = 0, 0.0
        for c in s:
            move = self.table[q][0].get(c)
            if move is None:
                return -math.inf
            total += move[0]
            q = move[1]
        return (total + self.table[q][1]) / len(s)

    def longest(self, s: str, at: int, stop: int, limit: float, least: int) -> tuple[int, float] | None:
        """(end, bits) of the longest part from a place on that beats the limit; one that ends in punctuation only if no other does."""
        q, total, found, loose = 0, 0.0, None, None
        for i in range(at, stop):
            move = self.table[q][0].get(s[i])
            if move is None:
                break
            total += move[0]
            q = move[1]
            n = i + 1 - at
            if n >= least and (b := (total + self.table[q][1]) / n) >= limit:
                if s[i] in ".=-":
                    loose = (i + 1, b)
                else:
                    found = (i + 1, b)
        return found or loose

    def reach(self, s: str, limit: float) -> list[float]:
        """For every place: the most bits over the limit that any part from there has."""
        ahead = [final for _, final in self.table]
        out = []
        for c in reversed(s):
            now = []
            for row, final in self.table:
                move = row.get(c)
                now.append(final if move is None else max(final, move[0] - limit + ahead[move[1]]))
            ahead = now
            out.append(now[0])
        return out[::-1]


class Model:
    """The automata of all families and their limits."""

    def __init__(self, examples: dict[str, list[str]] | None = None):
        self.parts = {}
        for family in examples or FORMATS:
            known = (examples or {}).get(family) or labelled(family, EXAMPLES + HELD_OUT, 1)
            cut = max(1, len(known) * EXAMPLES // (EXAMPLES + HELD_OUT))
            a = Automaton(known[:cut])
            held = [a.bits(s) for s in known[cut:] or known[:cut]]
            limit = min((b for b in held if b > -math.inf), default=math.inf) - MARGIN
            self.parts[family] = (a, limit, min(map(len, known)))

    def score(self, s: str) -> tuple[float, str] | None:
        """(bits, family) of the best family that accepts the candidate."""
        found = [(b - limit, f) for f, (a, limit, least) in self.parts.items() if len(s) >= least and (b := a.bits(s)) >= limit]
        return max(found) if found else None

    def parts_of(self, s: str) -> list[tuple[int, int, str]]:
        """(start, end, family) of the parts of a run that beat a limit, without those inside of others."""
        found = []
        for family, (a, limit, least) in self.parts.items():
            ahead, covered = a.reach(s, limit) if len(s) > LONG_RUN else None, 0
            for at in range(len(s) - least + 1):
                if at + OVERLAP <= covered or (ahead and ahead[at] < -1e-6):
                    continue
                if hit := a.longest(s, at, min(len(s), at + OVERLAP) if at < covered else len(s), limit, least):
                    covered = max(covered, hit[0])
                    found.append((at, -hit[0], limit - hit[1], family))
        out, covered = [], 0
        for start, end, _, family in sorted(found):
            if -end > covered:
                out.append((start, -end, family))
                covered = -end
        return out


_model: list[Model] = []


def default_model() -> Model:
    if not _model:
        _model.append(Model())
    return _model[0]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def find_spans(text: str | None, model: Model | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """Base spans, and what the automata add outside of them."""
    if not text:
        return [], []
    model = model or default_model()
    base, more = base_spans(text), []
    starts, reach = [b for b, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in RUN.finditer(text):
        for start, end, family in model.parts_of(m.group()):
            start, end = m.start() + start, m.start() + end
            before = bisect_right(starts, start)  # base spans that begin no later
            if not before or reach[before - 1] < end:
                more.append((start, f"auto_{family}", end))
    return base, more


def render(base: list, more: list) -> tuple[str, str]:
    """kind:start:end of the base spans, and of all spans."""
    own = [(s, k, KINDS[k], e) for s, k, e in base]
    rest = [(s, len(KINDS), k, e) for s, k, e in more]
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
    return join(own), join(own + rest)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts by base kind, digest of the base spans and all spans.

    Positions are code points of the whole text.  Null and empty texts have no
    spans; null ids and repeated rows pass through; an empty table gives no
    rows; other columns are not read.  One narrow pass, no shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = default_model()
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column(1):
                base, more = find_spans(text.as_py(), model)
                for k in range(3):
                    counts[k].append(sum(b[1] == k for b in base))
                own, every = render(base, more)
                digests.append(hashlib.sha256(own.encode()).hexdigest())
                spans.append(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact_text(text: str | None, model: Model | None = None) -> str | None:
    """The text with every span (joined where they overlap) replaced by a placeholder."""
    base, more = find_spans(text, model)
    if not base and not more:
        return text
    merged: list[list[int]] = []
    for start, end in sorted([(s, e) for s, _, e in base] + [(s, e) for s, _, e in more]):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, at = [], 0
    for start, end in merged:
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns; secrets in the text replaced, its length column renewed.

    Null and empty texts, and the lengths of texts without a secret, stay as they
    are; ids are not read, repeated rows come back as often; an empty table gives
    no rows.
    """
    names = docs.columns
    at, size_at = names.index(text_col), names.index(size_col) if size_col in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = default_model()
        for batch in batches:
            columns = list(batch.columns)
            texts = [redact_text(t.as_py(), model) for t in columns[at]]
            if size_at is not None:
                sizes = [old.as_py() if new is None or new == was.as_py() else len(new) for old, was, new in zip(columns[size_at], columns[at], texts, strict=True)]
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
