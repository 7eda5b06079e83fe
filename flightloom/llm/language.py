"""Language of each word and text by a linear-chain conditional random field.

A word's emission scores sum learned weights of its affixes, inner character n-grams, its whole form and
its place in the lexicons of the languages; learned transitions join neighbouring words of a line.
Forward-backward gives each word's probabilities, so texts that switch between languages are labelled
word by word. A text's score of a language is the mean of its words' probabilities.

Training takes a bounded sample, at most ``PER_LANG`` texts and ``BYTES`` per language, those with the least hash of
their id, for the ``LANGS`` most frequent languages. Half of the training lines are spliced from two languages, so that switches are learned.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows with a null
language are predicted but not learned from; without any language to learn all are ``und``; a null id is
not held out; ties go to the language that sorts first; repeated rows are labelled each; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm._io import low_hash, sample
from flightloom.llm._text import Scan, mix, pieces, strings, tidy

ORDERS = (1, 2, 3, 4, 5)
CELLS = 1 << 17
PER_LANG = 300
#: Bounds of the sample beside PER_LANG: languages, bytes of a text, bytes of a language's texts.
LANGS, LONGEST, BYTES = 64, 1 << 16, 4 << 20
#: Bytes of text that are labelled together; a word that repeats among them is scored once.
PIECE = 1 << 20
LEXICON = 500
LINE = 40
STEPS = 40
UNKNOWN = "und"
_K = np.uint64(0xD6E8FEB86659FD93)
_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def _letters(codes: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(codes, (1 << 16) - 1)]
    high = codes >= 1 << 16
    if high.any():
        kinds, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in kinds.tolist()])[back]
    return out


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, the word of each, whole-word hash of each word; 0 for words without letters).

    A word is lower-cased, freed of all but letters and put between spaces; n-grams with a space in them
    are its affixes, those without are inner n-grams.
    """
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace").lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes[_letters(codes) | (codes == 32)]
    gap = codes == 32
    word = np.cumsum(gap) - 1  # a space belongs to the word after it
    base = codes.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(7)
    base ^= base >> np.uint64(29)
    spaces = np.concatenate([[0], np.cumsum(gap)])
    cells, owner = [], []
    h = np.zeros(len(codes), np.uint64)
    for k in range(max(ORDERS)):
        m = len(codes) - k
        if m <= 0:
            break
        h = (h[:m] + base[k:]) * _K
        start, end = np.arange(m), np.arange(m) + k
        inner = spaces[end] - spaces[start + 1]  # spaces strictly between first and last
        ok = (inner == 0) & ~(gap[:m] & gap[k:]) & ((k > 0) | ~gap[:m])
        cells.append((h[ok] >> np.uint64(47)).astype(np.int32))
        owner.append(np.where(gap[:m], word[:m], word[:m])[ok])
    cells, owner = np.concatenate(cells), np.concatenate(owner)
    letters = np.bincount(word[~gap], minlength=len(words))[: len(words)]
    place = np.arange(len(codes)) - np.maximum.accumulate(np.where(gap, np.arange(len(codes)), 0))
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, word[~gap], mix(base[~gap] + place[~gap].astype(np.uint64) * _K))
    whole = np.where(letters > 0, mix(whole) | np.uint64(1), np.uint64(0))
    return cells, owner, whole


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the lines by falling length, and how many are still running at each step."""
    order = np.argsort(-lengths, kind="stable")
    running = np.cumsum(np.bincount(lengths, minlength=lengths.max() + 1)[::-1])[::-1]
    return order, running[1:]


def forward_backward(emission: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transition: np.ndarray, first: np.ndarray):
    """Marginals of each word, expected transitions and their number, and the log of all partitions.

    emission: scores by word and label; starts, lengths: the lines, none of them empty.
    """
    peak = emission.max(1)
    local = np.exp(emission - peak[:, None])
    move = np.exp(transition)
    order, running = _by_length(lengths)
    at = starts[order]
    alpha, scale = np.zeros_like(local), np.zeros(len(local))
    state = local[at] * np.exp(first)
    for t, live in enumerate(running.tolist()):
        rows = at[:live] + t
        if t:
            state = (state[:live] @ move) * local[rows]
        total = state.sum(1)
        state = state / total[:, None]
        alpha[rows], scale[rows] = state, total
    beta = np.ones_like(local)
    pairs = np.zeros_like(move)
    for t in range(len(running) - 1, 0, -1):
        rows = at[: running[t]] + t
        back = local[rows] * beta[rows] / scale[rows][:, None]
        pairs += alpha[rows - 1].T @ back
        beta[rows - 1] = back @ move.T
    marginal = alpha * beta
    return marginal / marginal.sum(1, keepdims=True), pairs * move, float((np.log(scale) + peak).sum())


class Model:
    """Weights of the field. labels: the languages; lexicon: whole-word hash to a language's number."""

    def __init__(self, labels, cells, lexicon_keys, lexicon_of, lexicon_weights, transition, first):
        self.labels, self.cells, self.transition, self.first = labels, cells, transition, first
        self.lexicon_keys, self.lexicon_of, self.lexicon_weights = lexicon_keys, lexicon_of, lexicon_weights

    def listed(self, whole: np.ndarray) -> np.ndarray:
        """Row of lexicon_weights for each word; the last row (zeros) for unlisted ones."""
        none = len(self.lexicon_weights) - 1
        if not len(self.lexicon_keys):
            return np.full(len(whole), none)
        at = np.minimum(np.searchsorted(self.lexicon_keys, whole), len(self.lexicon_keys) - 1)
        return np.where(self.lexicon_keys[at] == whole, self.lexicon_of[at], none)

    def emission(self, cells, owner, whole) -> np.ndarray:
        n, k = len(whole), len(self.labels)
        counts = np.maximum(1, np.bincount(owner, minlength=n))[:, None]
        out = np.stack([np.bincount(owner, self.cells[cells, y], n) for y in range(k)], 1) / np.sqrt(counts)
        return out + self.lexicon_weights[self.listed(whole)]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a piece."""
        n = len(column)
        marginal, rows, lettered = self.words(column)
        total = np.stack([np.bincount(rows[lettered], marginal[lettered, y], n) for y in range(len(self.labels))], 1) if len(rows) else np.zeros((n, len(self.labels)))
        count = total.sum(1)
        best = total.argmax(1)
        score = np.where(count > 0, total[np.arange(n), best] / np.maximum(count, 1e-300), 0.0)
        return [self.labels[b] if c > 0 else UNKNOWN for b, c in zip(best.tolist(), count.tolist())], np.clip(score, 0, 1)

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of each word of a piece, its row, and whether it has a letter."""
        scan = Scan(column)
        starts, ends = scan.words()
        rows = scan.rows(starts)
        if not len(starts):
            return np.zeros((0, len(self.labels))), rows, np.zeros(0, bool)
        _, at, back = np.unique(scan.hashes(starts, ends), return_index=True, return_inverse=True)
        raw = scan.data.tobytes()
        cells, owner, whole = word_features([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        emission = self.emission(cells, owner, whole)[back]
        breaks = np.concatenate([[0], np.cumsum(scan.data == 10)])[starts]
        fresh = np.concatenate([[True], (breaks[1:] != breaks[:-1]) | (rows[1:] != rows[:-1])])
        first = np.flatnonzero(fresh)
        lengths = np.diff(np.append(first, len(starts)))
        marginal, _, _ = forward_backward(emission, first, lengths, self.transition, self.first)
        return marginal, rows, (whole > 0)[back]


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Model | None:
    """Fits the field by Adam on the whole sample; None without languages."""
    labels = sorted(set(langs))
    if not labels:
        return None
    k, number = len(labels), {x: i for i, x in enumerate(labels)}
    ids: dict[bytes, int] = {}
    lines: list[list[list[int]]] = [[] for _ in labels]
    for text, lang in zip(texts, langs):
        for line in text.encode("utf-8", "replace").split(b"\n"):
            words = [ids.setdefault(w, len(ids)) for w in line.split()]
            lines[number[lang]] += [words[i : i + LINE] for i in range(0, len(words), LINE)]
    if not ids:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    tokens, gold, lengths = [], [], []
    for y in range(k):
        for line in lines[y]:
            tokens += line
            gold += [y] * len(line)
            other = int(rng.integers(0, k))
            more: list[int] = []
            if rng.random() < 0.5 and other != y and lines[other]:
                more = lines[other][int(rng.integers(0, len(lines[other])))]
                more = more[: int(rng.integers(1, len(more) + 1))]
                tokens += more
                gold += [other] * len(more)
            lengths.append(len(line) + len(more))
    tokens, gold, lengths = np.array(tokens), np.array(gold), np.array(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    cells, owner, whole = word_features(list(ids))
    # Lexicon: the most frequent whole words of each language, each kept by the language that has it most.
    seen = np.stack([np.bincount(tokens[gold == y], minlength=len(ids)) for y in range(k)], 1).astype(float)
    seen /= np.maximum(1, seen.sum(0))
    top = np.unique(np.concatenate([np.argsort(-seen[:, y], kind="stable")[:LEXICON] for y in range(k)]))
    top = top[whole[top] > 0]
    keys, first_at = np.unique(whole[top], return_index=True)
    model = Model(labels, np.zeros((CELLS, k)), keys, seen[top[first_at]].argmax(1), np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(k))
    listed = model.listed(whole)
    roots = np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(ids))))
    truth = np.eye(k)
    lead = np.concatenate([[False], np.ones(len(tokens) - 1, bool)])
    lead[starts] = False
    gold_moves = np.bincount(gold[np.flatnonzero(lead) - 1] * k + gold[lead], minlength=k * k).reshape(k, k)
    gold_first = np.bincount(gold[starts], minlength=k)
    params = [model.cells, model.lexicon_weights, model.transition, model.first]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        marginal, moves, _ = forward_backward(model.emission(cells, owner, whole)[tokens], starts, lengths, model.transition, model.first)
        miss = marginal - truth[gold]
        by_word = np.stack([np.bincount(tokens, miss[:, y], len(ids)) for y in range(k)], 1)
        scaled = by_word / roots[:, None]
        by_list = np.zeros_like(model.lexicon_weights)
        np.add.at(by_list, listed, by_word)
        by_list[-1] = 0
        grads = [np.stack([np.bincount(cells, scaled[owner, y], CELLS) for y in range(k)], 1), by_list, moves - gold_moves, marginal[starts].sum(0) - gold_first]
        for p, g, m, s in zip(params, grads, moment, square):
            g = g / len(tokens) + 1e-7 * p
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    model.lexicon_weights[-1] = 0
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> list:
    """The bounded sample: (text, lang) of at most per_lang documents for each of the LANGS most frequent languages.

    Chosen by the least hash of doc_id, from ids and languages alone; then the texts are fetched, of which those over LONGEST
    bytes are left out, and more than BYTES for a language.
    """
    ids = docs.select("doc_id", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    common = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}  # at most LANGS rows
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = ids.where(low_hash("doc_id", "lang", common, per_lang)).withColumn("place", place).where(F.col("place") <= per_lang).select("doc_id", "lang").distinct()
    rows = docs.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most LANGS * per_lang ids
    rows = sample(rows, "lang", [*order, F.col("text")], per_lang, BYTES, LONGEST)
    return rows.orderBy(*order, "lang", "text").select("text", "lang").collect()


def labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            text = strings(batch.column(2))
            for lo, hi in pieces(text, PIECE):
                found, score = held.value.predict(text[lo:hi]) if held.value else ([UNKNOWN] * (hi - lo), np.zeros(hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), batch.column(1)[lo:hi], pa.array(found, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def trained(docs: DataFrame) -> Model | None:
    rows = training_rows(docs)
    return fit([r.text for r in rows], [r.lang for r in rows])
