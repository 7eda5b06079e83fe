"""Quality rules with a verdict on each host.

Base rules count words, symbols, repeated lines and repeated word windows of every whole text. The failures of
each rule are then summed by host (``source``), each host's failure rate is shrunk towards the corpus by an
empirical beta prior, and the verdicts on the host are joined back to its documents.

The prior of a rule has the corpus' failure rate as its mean; its strength comes from how far the hosts' rates
scatter beyond chance, each host weighing by its documents. A host is poor by a rule if its shrunk rate shows that
its documents pass less than half as often as those of the corpus; then none of them is kept. Where
hosts differ by chance only, the prior is strong and no host is poor.

Defined results: a null text is an empty one (no words, so it fails the rule on length); a null host is
a host of its own; repeated rows and ids are judged one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm._io import written
from flightloom.llm._text import Scan, _SPACE, grams, pieces, ranges, strings, tidy

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Share of the corpus' pass rate under which a host is poor.
MIN_PASS_SHARE = 0.5
MAX_DUP_LINES = 2
#: Strength of a prior (in documents) when hosts don't scatter beyond chance.
STRONGEST = 1e6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _sum_by(rows: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text of a piece."""
    n = len(column)
    scan = Scan(column)
    starts, ends = scan.words()
    rows = scan.rows(starts)
    lead = (scan.data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead & ~_SPACE[scan.data])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[scan.data])])
    at = scan.offsets
    out = {"n_words": _sum_by(rows, n), "word_chars": points[at[1:]] - points[at[:-1]], "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}

    first, last = scan.spans(scan.data != 10)
    inked = np.concatenate([[0], np.cumsum(~_SPACE[scan.data])])
    full = inked[last] > inked[first]
    first, last = first[full], last[full]
    line_rows = scan.rows(first)
    lines = pd.DataFrame({"r": line_rows, "h": scan.hashes(first, last)})
    out["n_dup_lines"] = _sum_by(line_rows[lines.duplicated().to_numpy()], n)

    windows = grams(scan.hashes(starts, ends), WINDOW)
    m = len(windows)
    whole = np.flatnonzero(rows[:m] == rows[WINDOW - 1 : WINDOW - 1 + m]) if m else np.zeros(0, np.int64)
    again = pd.DataFrame({"r": rows[whole], "h": windows[whole]}).duplicated(keep=False).to_numpy()
    marked = np.zeros(len(starts), bool)
    hit = whole[again]
    marked[np.unique(ranges(hit, np.full(len(hit), WINDOW)))] = True
    out["n_repeat_words"] = _sum_by(rows[marked], n)
    return out


def counted(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the five counts of every whole text."""

    def run(batches):
        for batch in batches:
            text = strings(batch.column(2))
            for lo, hi in pieces(text):
                got = measure(text[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi].cast(pa.string()), *(pa.array(got[k]) for k in COUNTS)], ["doc_id", "host", *COUNTS])

    return docs.select("doc_id", F.col(host).cast("string").alias("host"), "text").mapInArrow(tidy(run), "doc_id long, host string, " + ", ".join(f"{k} long" for k in COUNTS))


def rules() -> dict[str, F.Column]:
    """Whether a document fails each rule, from its counts; the first two are the base rules."""
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeated_words": F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT,
        "symbols": F.col("n_symbols") * 10 > F.col("word_chars"),
        "repeated_lines": F.col("n_dup_lines") > MAX_DUP_LINES,
    }


def base_failed() -> F.Column:
    found = rules()
    return found["few_words"] | found["repeated_words"]


def host_verdicts(rated: DataFrame, names: tuple[str, ...], min_share: float = MIN_PASS_SHARE) -> DataFrame:
    """host, n_docs, rate_<rule> (shrunk) and host_reasons (the rules by which it is poor) from rows (host, a flag for each rule).

    Rows are summed before any shuffle; one row of sums of all hosts reaches the driver.
    """
    hosts = written(rated.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(F.col(r).cast("long")).alias(r) for r in names)), "hosts")
    n = F.col("n_docs").cast("double")
    sums = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), *(F.sum(r).alias(f"x_{r}") for r in names), *(F.sum(F.col(r) * F.col(r) / n).alias(f"q_{r}") for r in names)).first()
    poor = []
    for r in names:
        mean, strength = prior(sums["h"], sums["n"] or 0.0, sums["nn"] or 0.0, sums[f"x_{r}"] or 0, sums[f"q_{r}"] or 0.0)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(r) + F.lit(strength * mean)) / (n + F.lit(strength)))
        poor.append(F.when(1 - F.col(f"rate_{r}") < F.lit(min_share * (1 - mean)), F.lit(r)))
    return hosts.select("host", "n_docs", *(f"rate_{r}" for r in names), F.concat_ws(",", *poor).alias("host_reasons"))


def prior(hosts: int, n: float, nn: float, failed: float, squares: float) -> tuple[float, float]:
    """Mean and strength of a rule's beta prior: from the sums over hosts of n, n * n, failures and failures^2 / n.

    The scatter of the rates, weighted by n, is held against what chance alone gives (analysis of variance).
    """
    mean = failed / n if n else 0.0
    spread, room = mean * (1 - mean), n - (nn / n if n else 0.0) - (hosts - 1)
    if spread <= 0 or room <= 0:
        return mean, STRONGEST
    shared = ((squares - n * mean * mean) / spread - (hosts - 1)) / room
    return mean, min(STRONGEST, 1 / shared - 1) if 0 < shared < 1 else STRONGEST if shared <= 0 else 0.0


def judged(docs: DataFrame, host: str = "source", min_share: float = MIN_PASS_SHARE) -> DataFrame:
    """Counts, base_failed, kept, host and host_reasons for every document.

    The counts are written once; verdicts join them back on the host, whose rows are dealt by Spark's
    skew join where one host holds a large share.
    """
    rated = written(counted(docs, host).withColumns(rules()).withColumn("base_failed", base_failed()), "quality")
    hosts = written(host_verdicts(rated, tuple(rules()), min_share), "verdicts").withColumnRenamed("host", "h")
    joined = rated.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("host_reasons") == "")).alias("kept"), "host", "host_reasons")
