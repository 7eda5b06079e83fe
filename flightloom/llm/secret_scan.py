"""Secret scan: fixed patterns, and automata inferred from labelled credentials.

Base kinds (assign, access, hex) are found by pattern in every whole text; each value found is a
labelled credential of its kind. From a bounded sample of those (``SAMPLE`` values per kind of at most ``LONGEST``
characters, those with the least hash) and of credentials made by rule in published formats, a prefix tree per kind is built
and its states are merged where they are statistically compatible: Hoeffding's bound on the frequencies of
symbols and ends down the trees, and Kolmogorov-Smirnov's on what is left to the end. States merge with those of their depth
first; over depths both need ``EVIDENCE`` words. So the automata know prefixes, alphabets and lengths of their formats.

One more automaton is inferred from ordinary runs: words of the corpus (``WORDS`` runs of letters in the case of
words, those with the least hash), and slugs, paths, names and numbers made of them by rule; nothing else of the corpus, as any
other run may be a credential. Its states merge only where the same symbol leads to them, and past the end of all words it
begins again, so that long ordinary runs keep their score.

Every candidate, a run of 16 or more credential characters that isn't within a base span, is scored by the best kind's
log-likelihood per character, its end included, less that of the ordinary automaton. It is a secret of that kind if
the score is above a threshold and it holds both letters and digits. The threshold comes from words held out
of the inference: a quarter of the way from the high end of the ordinary scores (``ORDINARY_OVER`` of them are over it) to the
low end of the credentials' (``MISSED`` of them are under it); the high end alone where the two cross.

Defined results: null and empty texts have no spans (empty string, and the digest of nothing); positions
are code points; runs of any length are scored (``LONGEST`` bounds the values of the sample only); repeated rows are scanned
each; null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm._io import written
from flightloom.llm._text import Scan, pieces, strings, tidy

# The kinds and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

MIN_CANDIDATE, LONGEST = 16, 4096
#: Spans that are walked one by one rather than side by side, and the bytes of them that are held as lists at a time.
ABREAST, BLOCK = 64, 1 << 12
SAMPLE, WORDS = 400, 3000
ORDINARY = "ordinary"
ALPHA = 0.05
EVIDENCE = 30
ORDINARY_OVER, MISSED = 0.005, 0.03
SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Weight of an automaton's overall frequencies beside those of a state.
SMOOTH, SMOOTH_END = 8.0, 2.0

_OF = np.full(256, -1, np.int16)
_OF[list(SYMBOLS)] = np.arange(len(SYMBOLS))
_RUN = _OF >= 0
_RUN[ord("=")] = False  # only as padding
_LETTER = np.zeros(256, bool)
_LETTER[list(SYMBOLS[:52])] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(SYMBOLS[:26])] = True
_EDGE = np.zeros(256, bool)
_EDGE[list(b"./-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


class Automaton:
    """Deterministic probabilistic automaton as tables: next state and log-probability by state and symbol, and of the end."""

    def __init__(self, move: np.ndarray, logp: np.ndarray, logend: np.ndarray):
        self.move, self.logp, self.logend = move, logp, logend
        #: Where the next state's row begins in the flat tables, by place in them.
        self._next = (move.astype(np.int64) * move.shape[1]).ravel().tolist()
        self._stays = (move == np.arange(len(move))[:, None]).all(1).tolist()

    def _walk(self, run: np.ndarray, state: int, total: float) -> tuple[int, float]:
        """State and log-likelihood after the bytes of a run, added in their order as in the steps of likelihood."""
        following, logp, width = self._next, self.logp.ravel(), self.move.shape[1]
        row = state * width
        for lo in range(0, len(run), BLOCK):
            symbols, rows = _OF[run[lo : lo + BLOCK]], []
            if self._stays[row // width]:
                rows = row  # that of every symbol left
            else:
                for symbol in symbols.tolist():
                    rows.append(row)
                    row = following[row + symbol]
            total = float(np.cumsum(np.concatenate([[total], logp[np.asarray(rows, np.int64) + symbols]]))[-1])
        return row // width, total

    def likelihood(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood per character of each span with its end; what goes on after all but ABREAST spans have ended is walked span by span."""
        order = np.argsort(-(ends - starts), kind="stable")
        at, sizes = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at))
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -k, "left"))
            if live <= ABREAST:
                for i in range(live):
                    state[i], total[i] = self._walk(data[at[i] + k : at[i] + sizes[i]], int(state[i]), float(total[i]))
                break
            symbol = _OF[data[at[:live] + k]]
            total[:live] += self.logp[state[:live], symbol]
            state[:live] = self.move[state[:live], symbol]
        out = np.empty(len(at))
        out[order] = (total + self.logend[state]) / (sizes + 1)
        return out


class _Tree:
    """Prefix tree of words; each node knows what passes it, what ends there, what follows and how far the ends are."""

    def __init__(self, words: list[bytes]):
        self.children: list[dict[int, int]] = []
        self.counts: list[dict[int, int]] = []
        self.passed: list[int] = []
        self.ended: list[int] = []
        self.left: list[list[int]] = []
        self.depth: list[int] = []
        self.symbol: list[int] = []
        self._node(0, -1)
        for word in sorted(words):
            node = 0
            for k, byte in enumerate(word):
                symbol = int(_OF[byte])
                self.passed[node] += 1
                self.left[node].append(len(word) - k)
                self.counts[node][symbol] = self.counts[node].get(symbol, 0) + 1
                if symbol not in self.children[node]:
                    self.children[node][symbol] = self._node(k + 1, symbol)
                node = self.children[node][symbol]
            self.passed[node] += 1
            self.left[node].append(0)
            self.ended[node] += 1

    def _node(self, depth: int, symbol: int) -> int:
        for table, value in ((self.children, {}), (self.counts, {}), (self.passed, 0), (self.ended, 0), (self.left, []), (self.depth, depth), (self.symbol, symbol)):
            table.append(value)
        return len(self.passed) - 1

    def distance(self, a: int, b: int, bound: float) -> float | None:
        """How far the frequencies and lengths of two nodes are apart; None if they aren't compatible."""
        todo, sizes = [(a, b)], math.sqrt(1 / self.passed[a] + 1 / self.passed[b])
        x, y = np.sort(self.left[a]), np.sort(self.left[b])
        points = np.concatenate([x, y])
        apart = float(np.abs(np.searchsorted(x, points, "right") / len(x) - np.searchsorted(y, points, "right") / len(y)).max())
        if apart > bound * sizes:
            return None
        while todo:
            x, y = todo.pop()
            n, m = self.passed[x], self.passed[y]
            limit = bound * (n**-0.5 + m**-0.5)
            if limit >= 1 and (x, y) != (a, b):
                continue  # too few words to tell anything here or below
            pairs = [(self.counts[x].get(s, 0) / n, self.counts[y].get(s, 0) / m) for s in self.counts[x].keys() | self.counts[y].keys()]
            pairs.append((self.ended[x] / n, self.ended[y] / m))
            if any(abs(p - q) > limit for p, q in pairs):
                return None
            if (x, y) == (a, b):
                apart += sum(abs(p - q) for p, q in pairs)
            todo += [(self.children[x][s], self.children[y][s]) for s in self.children[x].keys() & self.children[y].keys()]
        return apart

    def fold(self, a: int, b: int) -> None:
        """Adds the tree under b to that under a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.passed[x] += self.passed[y]
            self.ended[x] += self.ended[y]
            self.left[x] = self.left[x] + self.left[y]
            for symbol, count in self.counts[y].items():
                self.counts[x][symbol] = self.counts[x].get(symbol, 0) + count
            for symbol, child in self.children[y].items():
                if symbol in self.children[x]:
                    todo.append((self.children[x][symbol], child))
                else:
                    self.children[x][symbol] = child


def infer(words: list[bytes], alpha: float = ALPHA, same_symbol: bool = False) -> Automaton:
    """Merges compatible states of the words' prefix tree, layer by layer; same_symbol: only those that one symbol leads to."""
    tree, bound = _Tree(words or [b""]), math.sqrt(0.5 * math.log(2 / alpha))
    states = {0: None}  # in the order found
    while True:
        open_arcs = [(p, s) for p in states for s, c in tree.children[p].items() if c not in states]
        if not open_arcs:
            break
        least = min(tree.depth[tree.children[p][s]] for p, s in open_arcs)
        layer = sorted(((p, s) for p, s in open_arcs if tree.depth[tree.children[p][s]] == least), key=lambda arc: (-tree.passed[tree.children[arc[0]][arc[1]]], arc))
        for parent, symbol in layer:
            node = tree.children[parent][symbol]
            if node in states:
                continue
            best, near = None, math.inf
            for known in states:
                if known == 0 or same_symbol and tree.symbol[known] != symbol:
                    continue
                if not same_symbol and tree.depth[known] != tree.depth[node] and min(tree.passed[known], tree.passed[node]) < EVIDENCE:
                    continue
                apart = tree.distance(known, node, bound)
                if apart is not None and apart < near:
                    best, near = known, apart
            if best is None:
                states[node] = None
            else:
                tree.children[parent][symbol] = best
                tree.fold(best, node)
    number = {node: i for i, node in enumerate(states)}
    size = len(SYMBOLS)
    weight = np.zeros((len(states), size))
    for node, i in number.items():
        for symbol, count in tree.counts[node].items():
            weight[i, symbol] = count
    passed, ended = (np.array([t[node] for node in states], float) for t in (tree.passed, tree.ended))
    overall = (weight.sum(0) + 0.01) / (weight.sum() + 0.01 * size)
    logp = np.log((weight + SMOOTH * overall) / (weight.sum(1, keepdims=True) + SMOOTH))
    end = (ended + SMOOTH_END * (ended.sum() + 0.01) / (passed.sum() + 0.02)) / (passed + SMOOTH_END)
    # A symbol not seen in a state leads where most words go from there; past the end of all words ordinary runs begin again.
    again = [number[tree.children[0][symbol]] if symbol in tree.children[0] else 0 for symbol in range(size)]
    move = np.empty((len(states), size), np.int32)
    for node, i in number.items():
        usual = max(tree.children[node], key=lambda s: (tree.counts[node][s], -s), default=None)
        move[i] = number[tree.children[node][usual]] if usual is not None else again if same_symbol else i
        for symbol, child in tree.children[node].items():
            move[i, symbol] = number[child]
    return Automaton(move, logp + np.log1p(-end)[:, None], np.log(end))


# Prefixes of published token formats.
PREFIXES = (b"ghp_", b"gho_", b"github_pat_", b"glpat-", b"sk_live_", b"sk_test_", b"pk_live_", b"rk_live_", b"xoxb-", b"xoxp-", b"npm_", b"hf_", b"sk-", b"SG.", b"AIza", b"ya29.", b"dop_v1_", b"shpat_")


def seeds(count: int = 60, seed: int = 5) -> dict[str, list[bytes]]:
    """Credentials made by rule, the same each time: count of each form."""
    rng = np.random.Generator(np.random.PCG64(seed))
    upper, lower, digits = SYMBOLS[:26], SYMBOLS[26:52], SYMBOLS[52:62]

    def drawn(alphabet: bytes, n: int) -> bytes:
        return bytes(rng.choice(np.frombuffer(alphabet, np.uint8), int(n)).tobytes())

    def form(kind: int) -> bytes:
        n = rng.integers(16, 49)
        if kind < 4:
            return drawn((upper + lower + digits, upper + digits, lower + digits, upper + lower + digits + b"_-")[kind], n)
        if kind == 4:
            return PREFIXES[rng.integers(len(PREFIXES))] + drawn(upper + lower + digits, n)
        if kind == 5:
            size = 4 * int(rng.integers(5, 13))
            pad = int(rng.integers(0, 3))
            return drawn(upper + lower + digits + b"+/", size - pad) + b"=" * pad
        return b"eyJ" + b".eyJ".join(drawn(upper + lower + digits, rng.integers(17, 34)) for _ in range(2)) + b"." + drawn(upper + lower + digits + b"_-", 43)

    return {
        "assign": [form(k) for k in range(7) for _ in range(count)],
        "access": [b"AKIA" + drawn(upper + b"234567", 16) for _ in range(2 * count)],
        "hex": [drawn(digits + b"abcdef", n) for n in rng.choice([32, 40, 64], 2 * count)],
    }


# Common words, which stand in for those of an empty corpus.
COMMON = tuple(b"about after again between change country different example family follow great group house important information language large letter light little machine many mother mountain never night number often other paper people picture place plant point public question report right school second section small special state story study system table through under water where white without word work world write young".split())


def ordinary(words: list[bytes], count: int = 200, seed: int = 6) -> list[bytes]:
    """Ordinary runs made by rule of words: count of each form, and the words themselves."""
    rng = np.random.Generator(np.random.PCG64(seed))
    words = sorted(words) or list(COMMON)
    word = lambda: words[rng.integers(len(words))]
    number = lambda a, b: str(rng.integers(a, b)).encode()
    digits = lambda n: b"%0*d" % (int(n), rng.integers(0, 10**n))
    date = lambda sep: sep.join((number(1990, 2031), b"%02d" % rng.integers(1, 13), b"%02d" % rng.integers(1, 29)))
    several = lambda sep, low=2: sep.join(word() for _ in range(rng.integers(low, 6)))
    forms = (
        lambda: several(b"-"), lambda: several(b"_"), lambda: several(b"/"), lambda: several(b"."), lambda: several(b""), lambda: b"".join(word().title() for _ in range(rng.integers(2, 5))),
        lambda: several(b"-") + b"-" + number(1, 10000), lambda: several(b"_") + b"_" + number(1, 10000), lambda: several(b"/") + b"/" + number(1, 100000) + b".html", lambda: several(b"/") + b"/" + date(b"/") + b"/" + several(b"-"),
        lambda: word() + number(0, 1000) + b"." + word() + b".com", lambda: date(b"-") + b"-" + several(b"-"), lambda: date(b"") + b"_" + several(b"_"), lambda: several(b"-") + b"-v" + number(0, 20) + b"." + number(0, 20) + b"." + number(0, 20),
        lambda: digits(rng.integers(10, 18)), lambda: b"-".join(digits(4) for _ in range(rng.integers(3, 6))), lambda: several(b"") + number(0, 10000), lambda: b"".join(word().title() for _ in range(rng.integers(2, 5))) + number(0, 10000),
        lambda: word().upper() + b"-" + date(b"-") + b"-" + digits(rng.integers(2, 7)), lambda: word() + b"_" + number(0, 100) + b"_" + word() + b"_" + number(0, 100),
    )
    return words + [made() for made in forms for _ in range(count)]


def _laid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words in a row, with their starts and ends."""
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _mixed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which spans hold both letters and digits; no other is a secret."""
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
    return (digit[ends] > digit[starts]) & (letter[ends] > letter[starts])


class Grammar:
    """The automata of all kinds and of ordinary runs, and the threshold from the fifth of their words that is held out."""

    def __init__(self, labelled: dict[str, list[bytes]]):
        made = seeds()
        words = {k: sorted(set(labelled.get(k, []))) + made[k] for k in KINDS} | {ORDINARY: ordinary(labelled.get(ORDINARY, []))}
        self.automata = {k: infer([w for i, w in enumerate(v) if i % 5], same_symbol=k == ORDINARY) for k, v in words.items()}
        out = {k: [w for w in v[::5] if len(w) >= MIN_CANDIDATE] for k, v in words.items()}
        scores = {k: self.gains(*_laid(out[k]))[0] for k in out}
        high = float(np.quantile(scores[ORDINARY], 1 - ORDINARY_OVER))
        low = float(np.quantile(np.concatenate([scores[k] for k in KINDS]), MISSED))
        self.threshold = high + max(0.0, low - high) / 4
        self.held_out_recall = {k: float((scores[k] > self.threshold).mean()) for k in KINDS}

    def gains(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and best kind of each candidate."""
        score = np.stack([self.automata[k].likelihood(data, starts, ends) for k in KINDS])
        return score.max(0) - self.automata[ORDINARY].likelihood(data, starts, ends), score.argmax(0)

    def kinds(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of the kind of each candidate; -1: none."""
        if not len(starts):
            return np.zeros(0, np.int64)
        mixed = np.flatnonzero(_mixed(data, starts, ends))
        out = np.full(len(starts), -1)
        if len(mixed):
            gain, kind = self.gains(data, starts[mixed], ends[mixed])
            out[mixed] = np.where(gain > self.threshold, kind, -1)
        return out


def base_spans(scan: Scan) -> list[tuple[int, int, int, int, int]]:
    """(row, start, end, kind, value's start) of a piece, in bytes of the piece."""
    raw, at, found = scan.data.tobytes(), scan.offsets.tolist(), []
    for row, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
        text = raw[lo:hi]
        if b"=" in text or b":" in text:
            found += [(row, lo + m.start(), lo + m.end(), 0, lo + m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
        if b"AKIA" in text:
            found += [(row, lo + m.start(), lo + m.end(), 1, lo + m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    starts, ends = scan.spans(_HEX[scan.data])
    long = ends - starts >= MIN_HEX
    starts, ends = starts[long], ends[long]
    return found + [(r, a, b, 2, a) for r, a, b in zip(scan.rows(starts).tolist(), starts.tolist(), ends.tolist())]


def candidates(scan: Scan, base: list) -> tuple[np.ndarray, np.ndarray]:
    """Runs of credential characters, with padding and without dots, slashes and hyphens at their ends, that aren't within a base span.

    Runs over LONGEST characters are there too, but for those without both letters and digits, which can't be secrets.
    """
    data = scan.data
    starts, ends = scan.spans(_RUN[data])
    near = ends - starts >= MIN_CANDIDATE - 2  # padding may follow
    starts, ends = starts[near], ends[near]
    if not len(starts):
        return starts, ends
    last = scan.offsets[scan.rows(starts) + 1]
    inner = np.concatenate([[-1], np.flatnonzero(~_EDGE[data]), [len(data)]])
    starts = np.minimum(inner[np.searchsorted(inner, starts)], ends - 1)
    ends = np.maximum(inner[np.searchsorted(inner, ends) - 1] + 1, starts + 1)
    for _ in range(2):
        ends = ends + ((ends < last) & (data[np.minimum(ends, len(data) - 1)] == ord("=")))
    held = ends - starts >= MIN_CANDIDATE
    long = np.flatnonzero(ends - starts > LONGEST)
    if len(long):
        held[long] = _mixed(data, starts[long], ends[long])
    starts, ends = starts[held], ends[held]
    if base:
        spans = np.array(sorted((a, b) for _, a, b, *_ in base))
        reach = np.maximum.accumulate(spans[:, 1])
        before = np.searchsorted(spans[:, 0], starts, "right") - 1  # base spans that begin no later
        free = (before < 0) | (reach[before] < ends)
        starts, ends = starts[free], ends[free]
    return starts, ends


def plain_words(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Runs of 3 to 20 ASCII letters with no capital after the first that stand between spaces: starts and ends."""
    starts, ends = scan.words()
    sized = (ends - starts >= 3) & (ends - starts <= 20)
    starts, ends = starts[sized], ends[sized]
    bad = np.concatenate([[0], np.cumsum(~_LETTER[scan.data] | _UPPER[scan.data])])
    good = (bad[ends] == bad[starts + 1]) & _LETTER[scan.data[starts]] if len(starts) else np.zeros(0, bool)
    return starts[good], ends[good]


def labelled_sample(docs: DataFrame, per_kind: int = SAMPLE, words: int = WORDS) -> dict[str, list[bytes]]:
    """Values by kind, and plain words as ordinary: those with the least hash of all texts, per_kind and words of them."""

    def run(batches):
        bound = {k: per_kind for k in KINDS} | {ORDINARY: words}
        least: dict[str, dict[bytes, int]] = {k: {} for k in bound}
        heaps: dict[str, list] = {k: [] for k in bound}

        def offer(kind: str, value: bytes, order: int) -> None:
            if value in least[kind] or len(heaps[kind]) >= bound[kind] and -heaps[kind][0][0] <= order:
                return
            if len(heaps[kind]) >= bound[kind]:
                del least[kind][heapq.heappop(heaps[kind])[1]]
            heapq.heappush(heaps[kind], (-order, value))
            least[kind][value] = order

        for batch in batches:
            text = strings(batch.column(0))
            for lo, hi in pieces(text):
                scan = Scan(text[lo:hi])
                raw = scan.data.tobytes()
                for _, _, end, kind, start in base_spans(scan):
                    if end - start <= LONGEST:
                        offer(KINDS[kind], raw[start:end], int.from_bytes(hashlib.blake2b(raw[start:end], digest_size=8).digest(), "big"))
                starts, ends = plain_words(scan)
                hashes, first = np.unique(scan.hashes(starts, ends), return_index=True)
                for order, at in zip(hashes[:words].tolist(), first[:words].tolist()):  # sorted by hash
                    if len(heaps[ORDINARY]) >= words and -heaps[ORDINARY][0][0] <= order:
                        break
                    offer(ORDINARY, raw[starts[at] : ends[at]], order)
        rows = [(k, v, format(o, "016x")) for k, values in least.items() for v, o in values.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], ["kind", "value", "h"])

    found = written(docs.select("text").mapInArrow(tidy(run), "kind string, value binary, h string").distinct(), "values")
    chosen = None
    for kind in (*KINDS, ORDINARY):
        part = found.where(F.col("kind") == kind).orderBy("h", "value").limit(words if kind == ORDINARY else per_kind)
        chosen = part if chosen is None else chosen.unionByName(part)
    out: dict[str, list[bytes]] = {}
    for row in chosen.collect():  # at most 3 * per_kind values and the words
        out.setdefault(row["kind"], []).append(bytes(row["value"]))
    return out


def scan_piece(column: pa.Array, grammar: Grammar) -> pd.DataFrame:
    """Base counts, base_sha256 and spans of each text of a piece."""
    n = len(column)
    scan = Scan(column)
    base = base_spans(scan)
    starts, ends = candidates(scan, base)
    kinds = grammar.kinds(scan.data, starts, ends)
    more = [(r, a, b, k) for r, a, b, k in zip(scan.rows(starts).tolist(), starts.tolist(), ends.tolist(), kinds.tolist()) if k >= 0]
    lead = np.concatenate([[0], np.cumsum((scan.data & 0xC0) != 0x80)])
    origin = lead[scan.offsets]

    def told(spans) -> list[list[tuple[int, int, int]]]:
        by_row: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for r, a, b, k in spans:
            by_row[r].append((int(lead[a] - origin[r]), k, int(lead[b] - origin[r])))
        return [sorted(x) for x in by_row]

    def text(spans) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    own = told(s[:4] for s in base)
    every = told([*(s[:4] for s in base), *more])
    out = {f"n_{kind}": [sum(k == i for _, k, _ in x) for x in own] for i, kind in enumerate(KINDS)}
    return pd.DataFrame(out | {"base_sha256": [hashlib.sha256(text(x).encode()).hexdigest() for x in own], "spans": [text(x) for x in every]})


def scanned(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        for batch in batches:
            text = strings(batch.column(1))
            for lo, hi in pieces(text):
                got = scan_piece(text[lo:hi], held.value)
                arrays = [pa.array(got[c].to_numpy(), pa.int64()) for c in ("n_assign", "n_access", "n_hex")] + [pa.array(got[c], pa.string()) for c in ("base_sha256", "spans")]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
