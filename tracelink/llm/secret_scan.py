"""Secret scan: all rules in one deterministic automaton, run over the bytes once.

Each rule is parsed into a non-deterministic automaton; subset construction and minimisation give one transition array for
all rules together, up to where their bodies have begun. The texts of a batch, in slices of bytes, are scanned in many lanes at a time. Lanes are cut only
after bytes that lead every state back to the start, so no match is ever cut. In a stretch between two such bytes where
a rule accepts, the rule's own two automata give the spans: one for the reversed rule, run backwards, marks every place
where a match begins, and an anchored one, run forwards from the leftmost of these, finds the longest match there; the
search goes on behind it. So spans are leftmost and do not overlap, and no stretch is read more than a few times.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tracelink.llm.common import add_columns, utf8

#: kind, head, body, least length of the body. A match is the head and the longest body; a shorter body is no secret, but
#: what it covers is not searched again. <word> is a word in either case.
RULES = (
    ("assign", r"""(<password>|<passwd>|<secret>|<token>|<api>_?<key>)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12),
    ("access", r"AKIA", r"[A-Z0-9]+", 14),
    ("hex", r"", r"[0-9a-f]+", 16),
    ("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    ("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    ("google", r"AIza", r"[A-Za-z0-9_-]+", 35),
    ("stripe", r"[rs]k_live_", r"[A-Za-z0-9]+", 16),
    ("jwt", r"", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    ("pem", r"", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
#: What the common automaton has of each rule: enough of the body to be no ordinary word. Whole bodies, which may all run at
#: once, would give 13,687 states instead of some hundreds.
SEEN_FROM = {"hex": r"[0-9a-f]{16}", "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ", "pem": r"-----BEGIN [A-Z ]"}
BODY_BEGINS = {"assign": r"[A-Za-z0-9+/_.=-]", "access": r"[A-Z0-9]", "github": r"[A-Za-z0-9]", "slack": r"[A-Za-z0-9-]", "google": r"[A-Za-z0-9_-]", "stripe": r"[A-Za-z0-9]"}
KINDS = tuple(r[0] for r in RULES)
BASE = 3
LANE, LANES, SLICE = 1024, 4096, 1 << 22
#: So few lanes are finished one by one.
FEW_LANES = 12


class _Nfa:
    """Thompson's construction for literals, classes, groups, | ? * + {m} {m,} {m,n}; <word> is a word in either case."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[list[tuple[frozenset, int]]] = []

    def turn(self, root: int) -> None:
        """Turns all arrows but the root's."""
        empty, step = [[] for _ in self.empty], [[] for _ in self.step]
        empty[root] = self.empty[root]
        for a in range(len(self.empty)):
            if a != root:
                for b in self.empty[a]:
                    empty[b].append(a)
                for among, b in self.step[a]:
                    step[b].append((among, a))
        self.empty, self.step = empty, step

    def state(self) -> int:
        self.empty.append([])
        self.step.append([])
        return len(self.empty) - 1

    def parse(self, text: str) -> tuple[int, int]:
        self.text, self.at = text, 0
        return self.choice()

    def choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.empty[start].append(a)
            self.empty[b].append(end)
            if self.text[self.at : self.at + 1] != "|":
                return start, end
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            began = self.at
            a, b = self.atom()
            done = self.at
            low, high = self.times()
            after = self.at
            parts = []
            for _ in range(max(low, 1) if high is None else high):
                self.at = began
                parts.append(self.atom() if parts else (a, b))
            self.at = after
            assert done <= after
            for i, (a, b) in enumerate(parts):
                if i >= low:
                    self.empty[a].append(b)
                if high is None and i == len(parts) - 1:
                    self.empty[b].append(a)
                self.empty[end].append(a)
                end = b
        return start, end

    def times(self) -> tuple[int, int | None]:
        c = self.text[self.at : self.at + 1]
        if c in ("?", "*", "+"):
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            stop = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : stop].partition(",")
            self.at = stop + 1
            return int(low), int(high or low) if not comma or high else None
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            made = self.choice()
            self.at += 1
            return made
        start = end = self.state()
        if c == "<":
            stop = self.text.index(">", self.at)
            for x in self.text[self.at + 1 : stop]:
                end = self.arrow(end, {ord(x.lower()), ord(x.upper())})
            self.at = stop + 1
            return start, end
        return start, self.arrow(start, self.bracket() if c == "[" else {self.char()})

    def arrow(self, a: int, among: set[int]) -> int:
        b = self.state()
        self.step[a].append((frozenset(among), b))
        return b

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def bracket(self) -> set[int]:
        self.at += 1
        among: set[int] = set()
        while self.text[self.at] != "]":
            low = high = self.char()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self.char()
            among.update(range(low, high + 1))
        self.at += 1
        return among


class Automaton:
    """table[state * classes + class_of[byte]] is the next state times classes; accepts[state] is a bit mask of expressions.

    If restarts, every state also starts all expressions anew, so a match may begin anywhere; else only at the first byte.
    """

    def __init__(self, expressions: list[str], restarts: bool = True, backwards: bool = False):
        nfa = _Nfa()
        root, finals = nfa.state(), {}
        for i, text in enumerate(expressions):
            a, b = nfa.parse(text)
            if backwards:
                a, b = b, a
            nfa.empty[root].append(a)
            finals[b] = i
        if backwards:
            nfa.turn(root)
        sets = sorted({s for arrows in nfa.step for s, _ in arrows}, key=sorted)
        signature = [tuple(b in s for s in sets) for b in range(256)]
        classes = {x: i for i, x in enumerate(dict.fromkeys(signature))}
        self.class_of = np.array([classes[x] for x in signature], np.uint8)
        members = {i: signature.index(x) for x, i in classes.items()}

        def closure(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(x for x in seen if nfa.step[x] or x in finals)

        begin = closure({root})
        index, rows, todo = {begin: 0}, [], [begin]
        while todo:  # subset construction
            now = todo.pop(0)
            row = []
            for c in range(len(classes)):
                byte = members[c]
                to = closure({t for s in now for among, t in nfa.step[s] if byte in among})
                if restarts:
                    to |= begin
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                row.append(index[to])
            rows.append(row)
        delta = np.array(rows)
        mask = np.array([sum(1 << finals[x] for x in s if x in finals) for s in index])
        dead = np.array([not s for s in index])
        block = np.unique(2 * mask + dead, return_inverse=True)[1]
        while True:  # minimisation: split blocks until states of a block agree on their next blocks
            new = np.unique(np.column_stack([block, block[delta]]), axis=0, return_inverse=True)[1].ravel()
            if new.max() == block.max():
                break
            block = new
        first = np.array([np.flatnonzero(block == b)[0] for b in range(block.max() + 1)])
        order = np.argsort(mask[first] > 0, kind="stable")  # accepting states come last
        place = np.argsort(order)
        self.subsets, self.classes = len(index), len(classes)
        self.start = int(place[block[0]]) * self.classes
        self.accepts = mask[first][order]
        self.first_accept = int((self.accepts == 0).sum()) * self.classes
        self.table = (place[block[delta[first[order]]]] * self.classes).astype(np.int32).ravel()
        self.dead = {int(place[block[i]]) * self.classes for i in np.flatnonzero(dead)}
        states = self.table.reshape(-1, self.classes)
        self.resets = (states == self.start).all(0)[self.class_of]
        self.steps, self.kinds = self.table.tolist(), self.class_of.tolist()

    def scan(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where expressions accept in text (which ends with a reset byte), their masks, and the places of all reset bytes."""
        breaks = np.flatnonzero(self.resets[text])
        wanted = np.searchsorted(breaks, np.arange(LANE, len(text), LANE))
        cuts = np.unique(breaks[wanted[wanted < len(breaks)]] + 1)
        starts = np.concatenate([[0], cuts[cuts < len(text)]])
        lengths = np.diff(np.append(starts, len(text)))
        order = np.argsort(-lengths, kind="stable")
        hits, states = [], []
        kind = self.class_of[text]
        for i in range(0, len(order), LANES):
            some = order[i : i + LANES]
            at, left = starts[some].copy(), lengths[some]
            state = np.full(len(some), self.start, np.int32)
            live = len(some)
            lanes_at = len(left) - np.searchsorted(left[::-1], np.arange(left[0] + 1), side="right")
            for j in range(left[0]):
                if lanes_at[j] != live:
                    live = lanes_at[j]
                    at, state = at[:live], state[:live]
                    if live <= FEW_LANES:
                        for k in range(live):
                            here, found = self.walk(kind[at[k] : starts[some[k]] + left[k]], int(state[k]))
                            hits.append(here + at[k])
                            states.append(found)
                        break
                state = self.table.take(state + kind.take(at))
                if (state >= self.first_accept).any():
                    hit = np.flatnonzero(state >= self.first_accept)
                    hits.append(at[hit].copy())
                    states.append(state[hit])
                at += 1
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), breaks
        return np.concatenate(hits), self.accepts[np.concatenate(states) // self.classes], breaks

    def walk(self, kinds: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
        """The accepting places of one lane and their states."""
        steps, least = self.steps, self.first_accept
        at, states = [], []
        for i, c in enumerate(kinds.tolist()):
            state = steps[state + c]
            if state >= least:
                at.append(i)
                states.append(state)
        return np.array(at, np.int64), np.array(states, np.int64)

    def begins(self, text: bytes) -> list[int]:
        """Of an automaton of a reversed expression: where matches begin, in order."""
        steps, kinds, least, state = self.steps, self.kinds, self.first_accept, self.start
        out = []
        for i in range(len(text) - 1, -1, -1):
            state = steps[state + kinds[text[i]]]
            if state >= least:
                out.append(i)
        return out[::-1]

    def longest(self, text: bytes, at: int) -> int:
        """Of an anchored automaton: the end of the longest match from a place, or the place itself."""
        steps, kinds, least, dead, state = self.steps, self.kinds, self.first_accept, self.dead, self.start
        end = at
        for i in range(at, len(text)):
            state = steps[state + kinds[text[i]]]
            if state >= least:
                end = i + 1
            elif state in dead:
                break
        return end


class Rule:
    """The automata of one rule."""

    def __init__(self, head: str, body: str, least: int):
        self.reverse, self.whole = Automaton([head + body], backwards=True), Automaton([head + body], restarts=False)
        self.head = Automaton([head], restarts=False) if head else None
        self.least = least

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Leftmost spans that do not overlap, without those whose body is too short."""
        out, done = [], 0
        for a in self.reverse.begins(text):
            if a >= done:
                done = self.whole.longest(text, a)
                body = self.head.longest(text, a) if self.head else a
                if done - body >= self.least:
                    out.append((a, done))
        return out


_BUILT: dict = {}


def automaton() -> Automaton:
    if "all" not in _BUILT:
        _BUILT["all"] = Automaton([SEEN_FROM.get(kind) or head + BODY_BEGINS[kind] for kind, head, _, _ in RULES])
        _BUILT["rules"] = [Rule(*r[1:]) for r in RULES]
    return _BUILT["all"]


def _find(texts: list[bytes], base: int, found: dict[int, list[tuple[int, int, int]]]) -> None:
    machine = automaton()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(lengths) - lengths
    joined = b"\n".join(texts) + b"\n"
    at, masks, breaks = machine.scan(np.frombuffer(joined, np.uint8))
    if not len(at):
        return
    part = np.searchsorted(breaks, at)
    for k, rule in enumerate(_BUILT["rules"]):
        for p in np.unique(part[(masks >> k & 1) == 1]).tolist():
            low, high = (int(breaks[p - 1]) + 1 if p else 0), int(breaks[p])
            text = int(np.searchsorted(begins, low, side="right")) - 1
            spans = [(low + a - int(begins[text]), k, low + b - int(begins[text])) for a, b in rule.spans(joined[low:high])]
            if spans:
                found.setdefault(base + text, []).extend(spans)


def find_spans(texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
    """By index of text: sorted (start, kind's number, end) in bytes. Texts without a secret are absent."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE or i == len(texts) - 1:
            _find(texts[begin : i + 1], begin, found)
            begin, held = i + 1, 0
    return {t: sorted(x) for t, x in found.items()}


def in_characters(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of code points: those are the bytes that do not continue a character."""
    if text.isascii():
        return spans
    places = np.array(sorted({x for a, _, b in spans for x in (a, b)}), np.int64)
    raw = np.frombuffer(text, np.uint8)
    counted = np.cumsum((raw & 0xC0) != 0x80)
    to = {x: int(counted[x - 1]) if x else 0 for x in places.tolist()}
    return [(to[a], k, to[b]) for a, k, b in spans]


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _columns(column) -> list:
    texts = utf8(column)
    nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    rows = [nothing] * len(texts)
    for i, spans in find_spans(texts).items():
        spans = in_characters(texts[i], spans)
        base = [x for x in spans if x[1] < BASE]
        n = [sum(x[1] == k for x in base) for k in range(BASE)]
        rows[i] = (*n, hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans))
    return list(zip(*rows)) if rows else [[]] * 5


def secret_scan(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the number of spans of each base kind, base_sha256 and all spans (kind:start:end in code points).

    Null texts count as empty; empty texts and texts without a secret have zeros and an empty list of spans.
    One row for each row of docs, whatever repeats. A match never crosses a line end.
    """
    return add_columns(docs, [text], _columns, COLUMNS, drop)


def _redacted(column) -> list:
    texts = column.to_pylist()
    raw = utf8(column)
    for i, spans in find_spans(raw).items():
        out, done = [], 0
        for a, k, b in spans:
            if b > done:
                out += [raw[i][done:a], f"[{KINDS[k]}]".encode()] if a >= done else []
                done = b
        texts[i] = b"".join([*out, raw[i][done:]]).decode("utf-8", "replace")
    return [texts]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by its kind in brackets; of overlapping spans the first names the place."""
    order = docs.columns
    return add_columns(docs, [text], _redacted, f"`{text}` string").select(*order)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return secret_scan(docs, drop=("text",))
