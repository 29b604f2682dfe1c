"""Secret scans: base patterns, and probabilistic automata inferred from labelled credentials.

Labelled credentials are what the base patterns find in a bounded sample of documents, and specimens of published token
formats, drawn at random from the shapes in FORMATS. For each kind a prefix tree of them is turned into a probabilistic
automaton by merging states whose outgoing frequencies are statistically compatible (a Hoeffding bound, tested down the
whole subtrees). Every run of credential characters that is as long as the shortest credential of the contract and holds
a letter is then scored: bits a character by which the best automaton explains it better than a character model of
ordinary tokens does, between 16 bits in all for short runs and 32 for long ones.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import drop, materialize, table, tidy

#: Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: Tokens that are scored: runs of credential characters of the least length that the assign pattern takes, with a letter;
#: bare numbers are no credentials.
LEAST, FULL, LONG = 6, 16, 32
#: Bits at most that a character of ordinary tokens costs: capitals, digits and points may stand in them.
RARE = 8
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{6,}")
#: Every match of ASSIGN holds one of these in lower case.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ORDINARY = re.compile(r"[A-Za-z0-9+/_.=-]+")

Span = tuple[str, int, int]

_DIGITS, _HEX = string.digits, string.digits + "abcdef"
_ALNUM = string.ascii_letters + string.digits
_URL = _ALNUM + "-_"
#: Shapes of published token formats, as literal beginnings and (alphabet, length) in turn.
FORMATS: dict[str, list[tuple]] = {
    "github": ["ghp_", (_ALNUM, 36)],
    "gitlab": ["glpat-", (_URL, 20)],
    "google": ["AIza", (_URL, 35)],
    "huggingface": ["hf_", (string.ascii_letters, 34)],
    "npm": ["npm_", (_ALNUM, 36)],
    "sendgrid": ["SG.", (_URL, 22), ".", (_URL, 43)],
    "slack": ["xoxb-", (_DIGITS, 12), "-", (_DIGITS, 12), "-", (_ALNUM, 24)],
    "stripe": ["sk_live_", (_ALNUM, 24)],
    "twilio": ["SK", (_HEX, 32)],
    "jwt": ["eyJ", (_URL, 33), ".eyJ", (_URL, 60), ".", (_URL, 43)],
}


def specimens(kind: str, n: int, seed: int) -> list[str]:
    """n random tokens of a published format."""
    rng = random.Random(f"{kind} {seed}")
    return ["".join(x if isinstance(x, str) else "".join(rng.choices(x[0], k=x[1])) for x in FORMATS[kind]) for _ in range(n)]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind as listed; offsets in code points, ends exclusive. Maximal runs
    make the length limits of access and hex part of their patterns; a short assign match is dropped but used up."""
    low = text.lower()
    named = ASSIGN.finditer(text) if any(w in low for w in WORDS) else ()
    found = [("assign", m.start(), m.end()) for m in named if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def labelled(text: str) -> Iterator[tuple[str, str]]:
    """(kind, credential) of a text, and ("", token) for one in 32, by hash, of its other tokens of 6 or more characters."""
    spans = base_spans(text)
    for kind, start, end in spans:
        yield kind, ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end]
    taken = [(s, e) for _, s, e in spans]
    for m in ORDINARY.finditer(text):
        if m.end() - m.start() >= 6 and zlib.crc32(m[0].encode()) % 32 == 0 and not any(s < m.end() and m.start() < e for s, e in taken):
            yield "", m[0]


class Automaton:
    """A probabilistic automaton inferred from a multiset of strings by merging compatible prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.passed, self.ended = [0], [0]
        for s in sorted(strings):
            at = 0
            self.passed[0] += 1
            for c in s:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.passed.append(0)
                    self.ended.append(0)
                at = to
                self.passed[at] += 1
            self.ended[at] += 1
        self.arcs: list[Counter] = [Counter({c: self.passed[t] for c, t in arcs.items()}) for arcs in self.next]
        self.limit = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self.log: dict[int, dict[str, tuple[float, int]]] = {}
        self.end: dict[int, float] = {}
        for q in self.kept:
            n = self.passed[q] + 1.0
            self.end[q] = max(-10.0, math.log2((self.ended[q] + 0.01) / n))
            self.log[q] = {c: (math.log2(k / n), self.next[q][c]) for c, k in self.arcs[q].items()}

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > (n1**-0.5 + n2**-0.5) * self.limit

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]  # below b everything is still a tree, so this ends
        while stack:
            p, q = stack.pop()
            if p == q:
                continue
            n, m = self.passed[p], self.passed[q]
            if not n or not m:
                continue
            if self._differ(self.ended[p], n, self.ended[q], m):
                return False
            for c in self.arcs[p].keys() | self.arcs[q].keys():
                if self._differ(self.arcs[p][c], n, self.arcs[q][c], m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    stack.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree under b to the automaton at a."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            self.passed[p] += self.passed[q]
            self.ended[p] += self.ended[q]
            for c, to in self.next[q].items():
                self.arcs[p][c] += self.arcs[q][c]
                if c in self.next[p]:
                    stack.append((self.next[p][c], to))
                else:
                    self.next[p][c] = to

    def _infer(self) -> None:
        self.kept = [0]
        while True:
            kept = set(self.kept)
            border = [(-self.passed[t], p, c, t) for p in self.kept for c, t in sorted(self.next[p].items()) if t not in kept]
            if not border:
                return
            _, p, c, t = min(border)
            for r in self.kept:
                if self._compatible(r, t):
                    self.next[p][c] = r
                    self._fold(r, t)
                    break
            else:
                self.kept.append(t)

    def bits(self, s: str, least: float = -math.inf) -> float:
        """log2 likelihood of s, its end included; what a state has not seen costs 10 bits and stays there. -inf as soon as
        it falls below least."""
        at, total = 0, 0.0
        for c in s:
            step = self.log[at].get(c)
            if step:
                total += step[0]
                at = step[1]
            else:
                total -= 10
            if total < least:
                return -math.inf
        return total + self.end[at]


class Model:
    """Automata of the kinds and a character-pair model of ordinary tokens."""

    def __init__(self, rows: list[tuple[str, str]]):
        by = defaultdict(list)
        for kind, s in rows:
            by[kind].append(s)
        self.automata = {k: Automaton(by[k]) for k in sorted(by) if k}
        self.pairs: Counter = Counter()
        self.firsts: Counter = Counter()
        self.chars: Counter = Counter()
        for s in by[""]:
            for a, b in zip(" " + s, s, strict=False):
                self.pairs[a, b] += 1
                self.firsts[a] += 1
                self.chars[b] += 1
        self.costs: dict[tuple[str, str], float] = {}

    def plain(self, s: str) -> float:
        """Bits by which ordinary tokens explain s."""
        costs, total = self.costs, 0.0
        for pair in zip(" " + s, s, strict=False):
            cost = costs.get(pair)
            if cost is None:  # few pairs: credential characters only
                alone = (self.chars[pair[1]] + 0.05) / (self.chars.total() + 0.05 * 70)
                cost = costs[pair] = max(-RARE, math.log2((self.pairs[pair] + alone) / (self.firsts[pair[0]] + 1)))
            total += cost
        return total

    def gain(self, s: str, least: float = -math.inf) -> float:
        """Bits by which the best automaton beats the model of ordinary tokens; -inf if that is less than least."""
        plain = self.plain(s)
        return max((a.bits(s, plain + least) for a in self.automata.values()), default=-math.inf) - plain


def train(docs: DataFrame, sample_docs: int = 8_000, per_kind: int = 800, per_format: int = 300) -> Model:
    """A model from the credentials in about sample_docs documents, chosen by hash of doc_id, and of those the per_kind
    values of each kind that come first by hash, with per_format specimens of each published format: the bounds are
    parameters. Null and empty texts hold no credentials; without any the formats alone are learnt."""
    spark = docs.sparkSession
    ship(spark)
    share = max(1, math.ceil(docs.count() / sample_docs))
    some = docs.filter(F.pmod(F.xxhash64(F.lit("secrets"), F.col("doc_id")), F.lit(share)) == 0).select("text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[str, str]] = defaultdict(dict)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, s in labelled(text or ""):
                    best[kind][hashlib.md5(s.encode()).hexdigest()] = s
            for kind in best:
                if len(best[kind]) > 4 * per_kind:
                    best[kind] = dict(sorted(best[kind].items())[:per_kind])
        rows = [(k, h, s) for k in best for h, s in sorted(best[k].items())[:per_kind]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "h", "s"])

    found = materialize(some.mapInArrow(pick, "kind string, h string, s string").distinct(), "secrets-sample")
    rows = [tuple(r) for k in ("", *KINDS) for r in found.filter(F.col("kind") == k).orderBy("h", "s").limit(per_kind).collect()]
    drop(found)
    return Model([(k, s) for k, _, s in rows] + [(k, s) for k in FORMATS for s in specimens(k, per_format, 0)])


def likely(s: str, model: Model, least: float) -> bool:
    """Whether a token's core reaches least bits a character; short ones need as many in all as one of FULL characters, long
    ones no more than one of LONG: 2**32 to one is evidence enough."""
    core = s.strip(".=-_/+")
    need = least * min(max(len(core), FULL), LONG)
    return len(core) >= LEAST and model.gain(core, need) >= need


def all_spans(text: str, model: Model, least: float, memo: dict[str, bool]) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    if len(memo) > 100_000:
        memo.clear()
    good = set()
    for s in set(TOKEN.findall(text)):
        verdict = memo.get(s)
        if verdict is None:
            verdict = memo[s] = likely(s, model, least)
        if verdict:
            good.add(s)
    more = []
    for m in TOKEN.finditer(text) if good else ():
        start, end = m.span()
        if m[0] in good and not any(a < end and start < b for _, a, b in base):
            more.append(("format", start, end))
    order = (*KINDS, "format")
    return base, sorted(base + more, key=lambda x: (x[1], order.index(x[0])))


def say(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, model: Model, least: float = 1.0) -> DataFrame:
    """doc_id, text -> doc_id, counts of base kinds, base_sha256, spans; a row for each row, repeated rows alike.

    A null or empty text has no spans. Texts of any length are read whole. An empty table gives an empty one; other
    columns are left out. doc_id passes through unread, null or not."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text or "", model, least, memo)
                n = Counter(k for k, _, _ in base)
                out.append((*(n[k] for k in KINDS), hashlib.sha256(say(base).encode()).hexdigest(), say(every)))
            cols = [pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        memo.clear()
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """text with spans (by start) replaced by mark; spans that overlap are replaced as one."""
    out, done = [], 0
    for _, s, e in spans:
        if s >= done:
            out += [text[done:s], mark]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: Model, mark: str = "[SECRET]", least: float = 1.0) -> DataFrame:
    """docs with every found span of text replaced by mark; overlapping spans are replaced as one. Null texts stay null and
    empty ones empty; all other columns pass through unread."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        for batch in batches:
            clean = [t and redacted(t, all_spans(t, model, least, memo)[1], mark) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
        memo.clear()
        tidy()

    return docs.mapInArrow(work, docs.schema)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, ties and empty tables as scan() states."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))
