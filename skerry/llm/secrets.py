"""Secret scans: fixed patterns, and formats learnt by grammar inference.

For each known credential format a probabilistic automaton is inferred from labelled examples: their
prefix tree is folded state by state wherever two states' frequencies are compatible by the Hoeffding
bound. Every run of credential characters in a text, cut around the base patterns' spans, is then scored:
whole, by its parts between slashes, equals signs and dots, and from every place where a format's common
prefix stands. A candidate's score is its likelihood under a format's automaton against one inferred from
ordinary tokens; the threshold of a format lies above all held-out ordinary tokens. Of candidates that
overlap the one furthest above its threshold stays.
"""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.05
EXAMPLES = 240
HELD_OUT = 3000
RUN = 16
#: Ordinary tokens have more shapes than their examples.
SPREAD = 0.2
KINDS = ("assign", "access", "hex", "format")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "api")
_RUNS = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_EDGES = "._-/+="
_PATH_CUT, _ANY_CUT = re.compile(r"[/=]"), re.compile(r"[/=.]")

_LOWER, _DIGITS, _HEXA = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_ALL = _LOWER + _LOWER.upper() + _DIGITS

# Public credential formats as prefix, characters and length.
FORMATS = {
    "access": ("AKIA", _LOWER.upper() + _DIGITS, 16),
    "github": ("ghp_", _ALL, 36),
    "slack": ("xoxb-", _DIGITS, 24),
    "google": ("AIza", _ALL + "_-", 35),
    "stripe": ("sk_live_", _ALL, 24),
    "gitlab": ("glpat-", _ALL + "_-", 20),
    "jwt": ("eyJ", _ALL + "_-", 60),
    "npm": ("npm_", _ALL, 36),
    "huggingface": ("hf_", _ALL, 34),
    "docker": ("dckr_pat_", _ALL + "_-", 27),
    "sendgrid": ("SG.", _ALL + "_-", 64),
    "hex": ("", _HEXA, 40),
    "base64": ("", _ALL + "+/", 40),
}


def labelled(count: int, seed: int) -> dict[str, list[str]]:
    """Labelled credentials by format, and ``plain`` tokens; a seeded draw from the formats' rules."""
    draw = random.Random(seed)
    text = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    out = {kind: [prefix + text(letters, n) for _ in range(count)] for kind, (prefix, letters, n) in FORMATS.items()}
    word = lambda: "".join(draw.choice("bcdfghlmnprstvw") + draw.choice("aeiou") for _ in range(draw.randint(1, 5))) + draw.choice(("", "n", "s", "er", "ing"))
    shapes = (
        lambda: "".join(word() for _ in range(draw.randint(4, 8))),
        lambda: "_".join(word() for _ in range(draw.randint(3, 7))),
        lambda: "-".join(word() for _ in range(draw.randint(3, 7))),
        lambda: "".join(word().title() for _ in range(draw.randint(3, 7))),
        lambda: "/".join(word() for _ in range(draw.randint(3, 8))) + ".html",
        lambda: ".".join(word() for _ in range(draw.randint(3, 7))),
        lambda: text(_DIGITS, draw.randint(20, 30)),
        lambda: f"{draw.randint(1990, 2030)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}T{draw.randint(10, 23)}-{text(_DIGITS, 6)}",
        lambda: draw.choice("=-_.+/") * draw.randint(20, 60),
        lambda: f"{word()}.{text(_DIGITS, 2)}/{word()}_{text(_DIGITS, 4)}-{word()}",
        lambda: draw.choice(("x", "no", "ha", "1")) * draw.randint(20, 30),
        lambda: f"{word()}_{draw.randint(1990, 2030)}_{word()}_{word()}_v{draw.randint(1, 40)}.{draw.choice(('tar.gz', 'zip', 'docx', 'csv', 'pdf'))}",
        lambda: f"{word()}-{word()}-{draw.randint(0, 30)}.{draw.randint(0, 30)}.{draw.randint(0, 30)}-{draw.choice(('alpha', 'beta', 'rc', 'post'))}.{draw.randint(0, 9)}",
        lambda: f"{word().title()}{word().title()}{draw.randint(1, 99)}{word().title()}{draw.choice(('Test', 'Impl', 'V2', 'Factory'))}",
        lambda: f"{text(_LOWER.upper(), 3)}-{text(_DIGITS, 5)}-{text(_LOWER.upper(), 2)}{text(_DIGITS, 4)}-{word()}",
        lambda: f"{word()}_{word()}={word()}{draw.randint(1, 999)}",
        lambda: f"{draw.choice(('hf', 'npm', 'pat', 'sk', 'key'))}_{word()}_{word()}_{draw.randint(1, 99)}",
    )
    out["plain"] = [draw.choice(shapes)()[:80] for _ in range(count * 4)]
    return out


def symbols(token: str) -> list[str]:
    """The first characters as they are, later ones by class: formats differ by literal prefixes."""
    return [*token[:4], *(_class(c) for c in token[4:])]


@lru_cache(maxsize=256)
def _class(c: str) -> str:
    return "9" if c.isdigit() else "a" if c in "abcdef" else "z" if c.islower() else "A" if c in "ABCDEF" else "Z" if c.isupper() else c


def _mixed(token: str) -> bool:
    return any(map(str.isdigit, token)) and any(map(str.isalpha, token))


class Automaton:
    """A probabilistic automaton inferred from examples; ``spread`` is the share of symbols drawn as anywhere."""

    def __init__(self, examples: list[str], alpha: float = ALPHA, spread: float = 0.0):
        self.arcs: list[dict[str, int]] = [{}]
        self.uses: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for example in examples:
            self._add(symbols(example))
        self._fold()
        alphabet = len({s for i in self.kept for s in self.uses[i]}) + 64
        all_uses = Counter()
        for i in self.kept:
            all_uses.update(self.uses[i])
        ends = sum(self.ends[i] for i in self.kept)
        total = sum(all_uses.values()) + ends + alphabet
        anywhere = lambda n: (n + 1) / total
        share = lambda n, state, n_all: math.log((1 - spread) * (n + 0.05) / (self._visits(state) + 0.05 * alphabet) + spread * anywhere(n_all))
        self.cost = {i: {s: share(self.uses[i].get(s, 0), i, n) for s, n in all_uses.items()} | {None: share(0, i, 0)} for i in self.kept}
        self.stop = {i: share(self.ends[i], i, ends) for i in self.kept}
        self.arcs = {i: self.arcs[i] for i in self.kept}
        del self.uses, self.ends  # the tree is not needed any more

    def _visits(self, state: int) -> int:
        return self.ends[state] + sum(self.uses[state].values())

    def _add(self, path: list[str]) -> None:
        at = 0
        for s in path:
            if s not in self.arcs[at]:
                self.arcs[at][s] = len(self.arcs)
                self.arcs.append({})
                self.uses.append({})
                self.ends.append(0)
            self.uses[at][s] = self.uses[at].get(s, 0) + 1
            at = self.arcs[at][s]
        self.ends[at] += 1

    def _compatible(self, left: int, right: int) -> bool:
        todo = [(left, right)]
        while todo:
            i, j = todo.pop()
            n, m = self._visits(i), self._visits(j)
            limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            pairs = [(self.ends[i], self.ends[j])] + [(self.uses[i].get(s, 0), self.uses[j].get(s, 0)) for s in self.uses[i].keys() | self.uses[j].keys()]
            if any(abs(a / n - b / m) > limit for a, b in pairs):
                return False
            todo += [(self.arcs[i][s], self.arcs[j][s]) for s in self.arcs[i].keys() & self.arcs[j].keys()]
        return True

    def _merge(self, into: int, tree: int) -> None:
        """Fold the tree below a state into another state."""
        todo = [(into, tree)]
        while todo:
            i, j = todo.pop()
            self.ends[i] += self.ends[j]
            for s, n in self.uses[j].items():
                self.uses[i][s] = self.uses[i].get(s, 0) + n
                if s in self.arcs[i]:
                    todo.append((self.arcs[i][s], self.arcs[j][s]))
                else:
                    self.arcs[i][s] = self.arcs[j][s]

    def _fold(self) -> None:
        """States join the kept ones in order of discovery: merged with the first compatible one, else kept."""
        kept = [0]
        while True:
            fringe = next(((i, s, j) for i in kept for s, j in sorted(self.arcs[i].items()) if j not in kept), None)
            if fringe is None:
                break
            parent, symbol, tree = fringe
            match = next((k for k in kept if self._compatible(k, tree)), None)
            if match is None:
                kept.append(tree)
            else:
                self.arcs[parent][symbol] = match
                self._merge(match, tree)
        self.kept = kept

    def score(self, path: list[str]) -> float:
        """Mean log-likelihood of a symbol, the end being one."""
        at, total = 0, 0.0
        for s in path:
            costs = self.cost[at]
            total += costs.get(s, costs[None])
            at = self.arcs[at].get(s, at)
        return (total + self.stop[at]) / (len(path) + 1)


class Scanner:
    """Finds base patterns and learnt formats in a text."""

    def __init__(self, examples: dict[str, list[str]] | None = None, held_out: list[str] | None = None):
        examples = examples or labelled(EXAMPLES, 1)
        self.automata = {kind: Automaton(tokens, spread=SPREAD if kind == "plain" else 0.0) for kind, tokens in examples.items()}
        others = held_out or labelled(HELD_OUT // 4, 2)["plain"]
        paths = [symbols(t) for t in others if _mixed(t)]
        shared = {os.path.commonprefix(tokens) for kind, tokens in examples.items() if kind != "plain"}
        self.prefixes = re.compile("|".join(sorted(map(re.escape, (p for p in shared if len(p) > 2)))) or r"(?!)")
        self.limits = {kind: 0.25 + max([0.0, *(self._gain(kind, p) for p in paths)]) for kind in examples if kind != "plain"}

    def _gain(self, kind: str, path: list[str]) -> float:
        return self.automata[kind].score(path) - self.automata["plain"].score(path)

    def _excess(self, token: str) -> float:
        """How far the best format is above its threshold; a credential has letters and digits."""
        return self._best(token)[0] if _mixed(token) else -1.0

    def _best(self, token: str) -> tuple[float, str]:
        path = symbols(token)
        plain = self.automata["plain"].score(path)
        return max((self.automata[kind].score(path) - plain - limit, kind) for kind, limit in self.limits.items())

    def format_of(self, token: str) -> str | None:
        """The format furthest above its threshold, if any is."""
        if not _mixed(token):
            return None
        excess, kind = self._best(token)
        return kind if excess > 0 else None

    def _candidates(self, text: str, start: int, end: int) -> set[tuple[int, int]]:
        """Parts of a run that may be a credential: their number grows with the run's length only."""
        out = {(start, end)}
        for cut in (_PATH_CUT, _ANY_CUT):
            at = start
            for m in cut.finditer(text, start, end):
                out.add((at, m.start()))
                at = m.end()
            out.add((at, end))
        for m in self.prefixes.finditer(text, start, end):
            stop = _PATH_CUT.search(text, m.start(), end)
            out.add((m.start(), stop.start() if stop else end))
        trimmed = set()
        for a, b in out:
            token = text[a:b].rstrip(_EDGES)
            left = len(token) - len(token.lstrip(_EDGES))
            if len(token) - left >= RUN:
                trimmed.add((a + left, a + len(token)))
        return trimmed

    def _learnt(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Credentials in a run that no base span touches, none overlapping another."""
        scored = sorted((-self._excess(text[a:b]), a - b, a, b) for a, b in self._candidates(text, start, end))
        taken: list[tuple[int, int]] = []
        for loss, _, a, b in scored:
            if loss < 0 and not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
        return taken

    def scan(self, text: str | None) -> list[tuple[int, int, str]]:
        """All spans as (start, end, kind), by start, then kind; none for null texts."""
        if not text:
            return []
        found = []
        low = text.lower()
        if any(w in low for w in _WORDS):
            found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        runs = [m.span() for m in _RUNS.finditer(text)]  # each key or digest lies within one
        for start, end in runs:
            found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text, start, end) if m.end() - m.start() >= 20]
            found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text, start, end)]
        base, i = sorted(found), 0
        for start, end in runs:
            while i < len(base) and base[i][1] <= start:
                i += 1
            at, k = start, i
            while k < len(base) and base[k][0] < end:  # what is left between base spans
                if base[k][0] - at >= RUN:
                    found += [(a, b, 3) for a, b in self._learnt(text, at, base[k][0])]
                at, k = max(at, base[k][1]), k + 1
            if end - at >= RUN:
                found += [(a, b, 3) for a, b in self._learnt(text, at, end)]
        return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, ``base_sha256`` and ``spans`` in code points.

    Null and empty texts have none. Repeated rows and null ids pass through; an empty table gives an
    empty result; other columns are not read. A map over Arrow batches without a shuffle.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("scan_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    found = scanner()  # inferred once and sent along

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column("scan_text"):
                hits = found.scan(text.as_py())
                for k in range(3):
                    counts[k].append(sum(kind == KINDS[k] for _, _, kind in hits))
                shown = [f"{kind}:{a}:{b}" for a, b, kind in hits]
                digests.append(hashlib.sha256(",".join(s for s in shown if not s.startswith("format")).encode()).hexdigest())
                spans.append(",".join(shown))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return source.mapInArrow(run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[SECRET]", found: Scanner | None = None) -> str | None:
    """The text with every span, overlapping ones joined, replaced by a mark."""
    out, at = [], 0
    for start, end, _ in (found or scanner()).scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return text if not at else "".join(out) + text[at:]


def redacted(text: Column) -> Column:
    found = scanner()

    @F.pandas_udf("string")
    def without_secrets(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, found=found) for t in texts], dtype=object)

    return without_secrets(text)
