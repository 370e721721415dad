"""Secrets: fixed patterns, plus format likelihood under probabilistic automata inferred from labelled credentials.

For each format, the labelled credentials make a prefix tree with counts; states whose futures are statistically compatible (the
Hoeffding bound on every transition and end frequency) are merged, which gives a small probabilistic automaton. States of one depth
are merged first, so that there is evidence enough on where strings end when states of different depths are compared; otherwise a
format of fixed length would melt into a single state. Every candidate
string of a text is scored by its log-likelihood ratio per character, the best automaton against running prose; candidates of at
least `threshold` that no base span covers are added as kind `format`.

Candidates are all runs of `SHORTEST` and more characters of credentials, and within a run, if it is none as a whole, the pieces that
begin after = or / or with a format's common prefix and end before = or / or with the run; of pieces that overlap, the one with the larger likelihood ratio as a whole stays.
Pieces have at most `LONGEST` characters, so that time is linear. Runs without a digit are compared with paths and words in capitals as well.

Symbols are the characters themselves where, among the first `LITERAL`, all of a format's credentials agree, and character classes
elsewhere, so that prefixes are learnt literally and random parts as classes.

Defined results: null text counts as empty; rows without doc_id are left out; repeated rows give repeated results; positions are
code points, ends exclusive. Without labelled credentials nothing is added to the base spans.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernel
from .common import keyed_text

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "format")
LITERAL, ALPHA, THRESHOLD = 8, 0.05, 1.0
SHORTEST, LONGEST = 16, 256

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
_SUSPECT = rf"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{{24}}|[A-Za-z0-9+/_=-]{{{SHORTEST}}}"


def _class(c: str) -> str:
    """a for lower case, A for upper case, 9 for digits, other characters as they are."""
    return "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c


_SPREAD = {"a": math.log2(26), "A": math.log2(26), "9": math.log2(10)}


class Automaton:
    """A probabilistic automaton: per state, its count, how often strings end there, and per symbol a count and the next state."""

    def __init__(self, samples: Iterable[str], alpha: float = ALPHA):
        samples = list(samples)
        self.n, self.end, self.next = [0], [0], [{}]
        self.prefix = samples[0][:LITERAL] if samples else ""
        while not all(s.startswith(self.prefix) for s in samples):
            self.prefix = self.prefix[:-1]
        for s in samples:
            state = 0
            self.n[0] += 1
            for c in self.symbols(s):
                if c not in self.next[state]:
                    self.n.append(0)
                    self.end.append(0)
                    self.next.append({})
                    self.next[state][c] = [0, len(self.n) - 1]
                self.next[state][c][0] += 1
                state = self.next[state][c][1]
                self.n[state] += 1
            self.end[state] += 1
        self._infer(math.sqrt(0.5 * math.log(2 / alpha)))

    def symbols(self, s: str) -> list[str]:
        """Characters of the common prefix as "=x", classes after it."""
        return [f"={c}" if i < len(self.prefix) else _class(c) for i, c in enumerate(s)]

    def _differ(self, f1: int, n1: int, f2: int, n2: int, width: float) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _of(self, a: int) -> int:
        """The state that a was merged into."""
        while self.into[a] != a:
            self.into[a] = a = self.into[self.into[a]]
        return a

    def _compatible(self, a: int, b: int, width: float) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = sorted(map(self._of, todo.pop()))
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if self._differ(self.end[a], self.n[a], self.end[b], self.n[b], width):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[0] if x else 0, self.n[a], y[0] if y else 0, self.n[b], width):
                    return False
                if x and y:
                    todo.append((x[1], y[1]))
        return True

    def _merge(self, a: int, b: int) -> None:
        """Makes a and b one state, and with them whatever two states one symbol would then lead to."""
        todo = [(a, b)]
        while todo:
            a, b = sorted(map(self._of, todo.pop()))
            if a == b:
                continue
            self.into[b] = a
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for c, (count, child) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][0] += count
                    todo.append((self.next[a][c][1], child))
                else:
                    self.next[a][c] = [count, child]
            self.next[b] = {}

    def _infer(self, width: float) -> None:
        self.into = list(range(len(self.n)))
        level = [0]
        while level:  # one depth after another
            kept: list[int] = []
            for state in sorted({self._of(t[1]) for r in level for t in self.next[r].values()}):
                mate = next((r for r in kept if self._compatible(r, state, width)), None)
                if mate is None:
                    kept.append(state)
                else:
                    self._merge(mate, state)
            level = sorted({self._of(s) for s in kept})
        red, queue = [0], [0]
        while queue:  # then each state with those before it
            for state in sorted({self._of(t[1]) for t in self.next[queue.pop(0)].values()} - set(red)):
                mate = next((r for r in red if self._compatible(r, state, width)), None)
                if mate is None:
                    red.append(state)
                    queue.append(state)
                else:
                    self._merge(mate, state)
                    red = sorted({self._of(r) for r in red})
                    queue = sorted({self._of(q) for q in queue} | {self._of(mate)})
        for moves in self.next:
            for t in moves.values():
                t[1] = self._of(t[1])
        red = sorted({self._of(r) for r in red})
        self.states = len(red)
        alphabet = {c for r in red for c in self.next[r] if c[0] != "="}
        for moves in (self.next[r] for r in red):  # a class that came nowhere else in this place goes where all others go
            if moves.keys() <= alphabet and len({t[1] for t in moves.values()}) == 1:
                for c in alphabet - moves.keys():
                    moves[c] = [0.5, next(iter(moves.values()))[1]]

    def log2p(self, s: str) -> float:
        return self.log2p_of(s, [len(s)])[0]

    def log2p_of(self, s: str, ends: list[int]) -> list[float]:
        """Of s[:e] for each of the ascending ends."""
        out, k, state, total = [-math.inf] * len(ends), 0, 0, 0.0
        for i in range(len(s) + 1):
            while k < len(ends) and ends[k] == i:
                out[k], k = total + (math.log2(self.end[state] / self.n[state]) if self.end[state] else -math.inf), k + 1
            if k == len(ends):
                break
            c = f"={s[i]}" if i < len(self.prefix) else _class(s[i])
            step = self.next[state].get(c)
            if step is None:
                break
            total += math.log2(step[0] / self.n[state]) - _SPREAD.get(c, 0)
            state = step[1]
        return out


def labelled_credentials(each: int = 96, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential) pairs made up by rule after publicly documented formats; none is a real one."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = upper + lower + digit
    makers = {
        "access_key": lambda: "AKIA" + pick(upper + digit, 16),
        "forge_token": lambda: "ghp_" + pick(alnum, 36),
        "payment_key": lambda: "sk_live_" + pick(alnum, 24),
        "maps_key": lambda: "AIza" + pick(alnum + "_-", 35),
        "chat_token": lambda: "xoxb-" + "".join(pick(digit, rng.choice((10, 11, 12, 13))) + "-" for _ in range(rng.choice((1, 2)))) + pick(alnum, 24),
        "package_token": lambda: "npm_" + pick(alnum, 36),
        "hex_digest": lambda: pick(digit + "abcdef", rng.choice((32, 40, 64))),
        "base64_key": lambda: base64.b64encode(rng.randbytes(rng.randrange(24, 66, 3))).decode(),
    }
    return [(name, make()) for name, make in makers.items() for _ in range(each)]


@lru_cache(maxsize=4)
def _fitted(labelled: tuple[tuple[str, str], ...], alpha: float) -> dict[str, Automaton]:
    by: dict[str, list[str]] = {}
    for name, s in labelled:
        by.setdefault(name, []).append(s)
    return {name: Automaton(samples, alpha) for name, samples in by.items()}


def infer(labelled: Iterable[tuple[str, str]] | None = None, alpha: float = ALPHA) -> dict[str, Automaton]:
    return _fitted(tuple(labelled_credentials() if labelled is None else labelled), alpha)


#: Bits a character of running prose takes: mostly lower case, few digits.
_PROSE = {"a": math.log2(26 / 0.93), "A": math.log2(26 / 0.04), "9": math.log2(10 / 0.01)}
_CAPITALS = {"a": _PROSE["A"], "A": _PROSE["a"], "9": _PROSE["9"]}


def _plain(s: str) -> Callable[[int, int], float]:
    """log2-likelihood of s[a:z] as prose; what has no digit may also be words in capitals, and signs between words are no rarer than letters. What has no letter is a
    number, in which digits are as likely as in a credential."""
    classes = [_class(c) for c in s]
    upto = lambda cost: list(accumulate(map(cost, classes), initial=0))
    digits, mixed = upto(lambda c: c == "9"), upto(lambda c: _PROSE.get(c, _PROSE["9"]))
    words = [upto(lambda c, m=m: m.get(c, min(m.values()))) for m in (_PROSE, _CAPITALS)]
    letters, number = upto(lambda c: c in ("a", "A")), upto(lambda c: math.log2(10) if c == "9" else 1.0)

    def bits(a: int, z: int) -> float:
        if digits[z] == digits[a]:
            return min(w[z] - w[a] for w in words)
        return mixed[z] - mixed[a] if letters[z] > letters[a] else number[z] - number[a]

    return lambda a, z: -bits(a, z)


def likelihood(s: str, automata: dict[str, Automaton]) -> tuple[str, float]:
    """The best format, and its log2-likelihood ratio against prose, per character."""
    prose = _plain(s)(0, len(s))
    return max(((name, (a.log2p(s) - prose) / len(s)) for name, a in automata.items()), key=lambda x: x[1], default=("", -math.inf))


def pieces(run: str, automata: dict[str, Automaton], threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """Start, end and score of what is a credential in a run: the run itself, or pieces of it."""
    score = likelihood(run, automata)[1]
    if score >= threshold:
        return [(0, len(run), score)]
    cuts = [m.start() for m in re.finditer("[=/]", run)]
    starts = {c + 1 for c in cuts} | {m.start() for p in {a.prefix for a in automata.values()} if len(p) > 2 for m in re.finditer(re.escape(p), run)} | ({0} if cuts else set())
    if not starts:
        return []
    stops, plain, got = sorted({*cuts, len(run)}), _plain(run), []
    for a in sorted(starts):
        ends = [z - a for z in stops[bisect_left(stops, a + SHORTEST) : bisect_right(stops, a + LONGEST)]]
        part = run[a : a + LONGEST]
        for z, p in zip(ends, map(max, zip(*(m.log2p_of(part, ends) for m in automata.values()), strict=True)), strict=True):
            if p > -math.inf and (x := (p - plain(a, a + z)) / z) >= threshold:
                got.append((-x * z, a, a + z))
    out: list[tuple[int, int, float]] = []
    for x, a, z in sorted(got):
        k = bisect_left(out, (a,))
        if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or z <= out[k][0]):
            out.insert(k, (a, z, -x / (z - a)))
    return out


def spans(text: str, automata: dict[str, Automaton], threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    found = [("assign", m.start(), m.end(), 1.0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end(), 1.0) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), 1.0) for m in _HEX.finditer(text)]
    if automata:
        base, k, reach = sorted((a, z) for _, a, z, _ in found), 0, 0
        for m in _CANDIDATE.finditer(text):
            for a, z, score in pieces(m[0], automata, threshold):
                a, z = m.start() + a, m.start() + z
                while k < len(base) and base[k][0] < z:
                    reach, k = max(reach, base[k][1]), k + 1
                if reach <= a:
                    found.append(("format", a, z, score))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string"


def _find(automata: dict[str, Automaton], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda r: ",".join(f"{k}:{a}:{z}" for k, a, z, _ in r)
        for b in batches:
            at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(b.column(1), _SUSPECT), False))
            got = dict(zip(at.to_pylist(), (spans(t, automata, threshold) for t in b.column(1).take(at).to_pylist()), strict=True))
            rows = [got.get(i, []) for i in range(b.num_rows)]
            base = [[s for s in r if s[0] in BASE] for r in rows]
            cols = [b.column(0), *(pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE), pa.array([hashlib.sha256(join(r).encode()).hexdigest() for r in base]), pa.array([join(r) for r in rows], pa.string()), pa.array([",".join(f"{s[3]:.2f}" for s in r) for r in rows], pa.string())]
            yield pa.record_batch(cols, names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    return run


def find_secrets(docs: DataFrame, labelled: Iterable[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans and their scores; one row per document."""
    return keyed_text(docs).mapInArrow(kernel.tidy(_find(infer(labelled), threshold)), _SCHEMA)
