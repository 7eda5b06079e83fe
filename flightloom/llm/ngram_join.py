"""N-gram Jaccard self-join: exact links between texts, and the classes they form.

1. Every whole text becomes the set of its 4-word shingles (48-bit hashes once it is counted). Equal sets form one class; a
   class is known by a hash of its set, so copies cost nothing further on.
2. A sketch counts all shingles of all classes in ``CELLS`` cells. Shingles are ordered rare first by the
   level of their cell, then by hash. The order decides only speed; links don't depend on it.
3. Each class files its prefix in that order: two sets with Jaccard >= t must share a prefix shingle.
4. First every posting list pairs its members with its least member, subject to the length filter, the positional
   filter (both tails are too short for the missing overlap) and the suffix filter. The last one is not the
   recursive split of the suffixes but a bound on the symmetric difference of whole sets, from hashed cells of at
   least twice a set's size; like the split it only excludes pairs that can't link. Pairs that pass are compared exactly.
5. Lists that still reach over several components make units, one for each least member. A first pass keeps, of
   each unit, the members that have a partner in another component which no filter excludes; only these get their shingles,
   and a second pass compares them exactly within the unit's task and gives out a spanning forest of the
   links. No pass gives more rows than it has members, however many pairs a group of near copies holds.
6. Units over ``UNIT`` are cut into blocks, about the square root of their size of them; pairs of blocks are dealt to
   different tasks.

Classes are told apart by 64-bit hashes of their sets alone: of n different sets about n * n / 4e19 pairs are
merged by mistake, that is none up to 10^9 sets and two or three among 10^10.

Defined results: null texts and texts without words have an empty set and link with nothing; fewer than
four words form one shingle; repeated ids are judged row by row and the least id of a class names it; a
null id takes part in its class but never names one that has ids; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm._io import discard, relieve, veiled, written
from flightloom.llm._text import Scan, grams, mix, pieces, strings, tidy
from flightloom.llm.components import components

CELLS = 1 << 22
CHUNK = 1 << 16
#: Weight of a unit that one task takes whole; a set weighs 1, and more from ``BITS`` / 2 shingles on.
UNIT = 32
BITS = 1024
WIDEST = 1 << 22
WORD_GRAM = 4
PERCENT = 85


def shingle_sets(column: pa.Array, n: int = WORD_GRAM, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a piece."""
    scan = Scan(column, lower)
    starts, ends = scan.words()
    rows, words = scan.rows(starts), scan.hashes(starts, ends)
    counts = np.bincount(rows, minlength=len(column))
    first = np.concatenate([[0], np.cumsum(counts)])
    all_grams = grams(words, n)
    out = []
    for i, count in enumerate(counts.tolist()):
        a = first[i]
        if count >= n:
            out.append(np.unique(all_grams[a : a + count - n + 1]))
        elif count:
            out.append(grams(words[a : a + count], count))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """64-bit name of a set: sum of its remixed hashes and its size, as a signed number."""
    total = np.add.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sets_of(docs: DataFrame, n: int = WORD_GRAM) -> DataFrame:
    """doc_id, mark, n_shingles, set_key, tokens, bits; the last two are null where this task has given that set before.

    bits: the marked cells of the set, ``width`` of them.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            text = strings(batch.column(2))
            for lo, hi in pieces(text):
                sizes, keys, tokens, bits = [], [], [], []
                for s in shingle_sets(text[lo:hi], n):
                    key = set_key(s) if len(s) else None
                    sizes.append(len(s))
                    keys.append(key)
                    known = key is None or key in seen
                    tokens.append(None if known else pack(s))
                    bits.append(None if known else _bits(s >> np.uint64(16), width(len(tokens[-1]) // 6)))
                    seen.add(key)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(tokens, pa.binary()), pa.array(bits, pa.binary())],
                    ["doc_id", "mark", "n_shingles", "set_key", "tokens", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(tidy(run), "doc_id long, mark long, n_shingles long, set_key long, tokens binary, bits binary")


def pack(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of sorted 64-bit hashes, six bytes each."""
    short = np.unique(tokens >> np.uint64(16)).astype("<u8")
    return short.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _arrays(column) -> list[np.ndarray]:
    """Sorted 48-bit hashes of each packed set."""
    out = []
    for x in column:
        raw = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        out.append(wide.view("<u8").reshape(-1))
    return out


def cell_levels(sets: DataFrame) -> np.ndarray:
    """Level (about 8 times the binary logarithm of the count) of each cell: CELLS bytes, whatever the input."""

    def count(batches):
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for tokens in _arrays(batch.column(0)):
                np.add.at(cells, (tokens & np.uint64(CELLS - 1)).astype(np.int64), 1)
        parts = cells.reshape(-1, CHUNK)
        held = [k for k in range(len(parts)) if parts[k].any()]
        packed = [zlib.compress(parts[k].astype(np.uint8 if parts[k].max() < 256 else np.uint32).tobytes(), 1) for k in held]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])

    def add(frames):
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, counts in zip(frame["chunk"], frame["counts"]):
                data = zlib.decompress(counts)
                row = total.setdefault(chunk, np.zeros(CHUNK, np.int64))
                row += np.frombuffer(data, np.uint8 if len(data) == CHUNK else np.uint32)
        if total:
            levels = [np.minimum(255, np.ceil(8 * np.log2(np.maximum(row, 1)))).astype(np.uint8).tobytes() for row in total.values()]
            yield pd.DataFrame({"chunk": list(total), "levels": levels})

    parts = sets.where("tokens is not null").select("tokens").mapInArrow(tidy(count), "chunk int, counts binary")
    chunks = CELLS // CHUNK
    summed = parts.repartition(chunks, "chunk").mapInPandas(tidy(add), "chunk int, levels binary")
    out = np.zeros((chunks, CHUNK), np.uint8)
    for row in summed.collect():  # CELLS bytes
        out[row["chunk"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def width(n: int) -> int:
    """Cells for a set of n: the power of two from twice its size on."""
    return min(WIDEST, max(BITS, 1 << (2 * n - 1).bit_length()))


def _bits(tokens: np.ndarray, cells: int = BITS) -> bytes:
    at = ((mix(tokens) >> np.uint64(40)) & np.uint64(cells - 1)).astype(np.int64)
    flags = np.zeros(cells, np.uint8)
    flags[at] = 1
    return np.packbits(flags).tobytes()


def postings(sets: DataFrame, levels, percent: int, among=None) -> DataFrame:
    """token, set_key, n, pos: the prefix of each set in rare-first order; among: only tokens this filter may hold."""

    def run(batches):
        rank = levels.value
        seen: set[int] = set()
        for batch in batches:
            keys, sets_here = batch.column(0).to_pylist(), _arrays(batch.column(1))
            out_t, out_k, out_n, out_p = [], [], [], []
            for key, tokens in zip(keys, sets_here):
                if key in seen:
                    continue
                seen.add(key)
                n = len(tokens)
                p = prefix_length(n, percent)
                order = rank[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]
                chosen = np.argsort(order, kind="stable")[:p]  # tokens are sorted by hash
                prefix, place = tokens[chosen], np.arange(p, dtype=np.int32)
                if among is not None:
                    kept = _may_hold(among.value, prefix.view(np.int64))
                    prefix, place = prefix[kept], place[kept]
                out_t.append(prefix)
                out_k.append(np.full(len(prefix), key, np.int64))
                out_n.append(np.full(len(prefix), n, np.int32))
                out_p.append(place)
            if out_t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in out_t], out_k, out_n, out_p)], ["token", "set_key", "n", "pos"])

    return sets.where("tokens is not null").select("set_key", "tokens").mapInArrow(tidy(run), "token long, set_key long, n int, pos int")


def _runs(frames):
    """Regroups sorted frames so that each yielded frame holds whole runs of its first column."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        first = frame.columns[0]
        cut = int(np.searchsorted(frame[first].to_numpy(), frame[first].iloc[-1], "left"))
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        rest = frame.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _required(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two sets of these sizes that link."""
    return -((-percent * (na + nb)) // (100 + percent))


def star_pairs(met: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a posting list with the list's least member, where the filters allow it."""
    n, pos, head = F.col("n").cast("long"), F.col("pos").cast("long"), F.col("head")
    size, at = head["n"].cast("long"), head["pos"].cast("long")
    need = F.ceil(F.lit(percent) * (n + size) / F.lit(100.0 + percent))
    length = F.least(n, size) * 100 >= F.greatest(n, size) * percent
    position = 1 + F.least(n - pos, size - at) - 1 + F.least(pos, at) >= need
    return met.where((F.col("set_key") != head["set_key"]) & length & position).select(head["set_key"].alias("a"), F.col("set_key").alias("b")).distinct()


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bloom filter of long keys in CELLS * 8 bits with three probes: CELLS bytes, whatever the input."""

    def probe(batches):
        cells = np.zeros(CELLS * 8, bool)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy(zero_copy_only=False)):
                cells[at] = True
        parts = cells.reshape(-1, CHUNK)
        held = [k for k in range(len(parts)) if parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([np.flatnonzero(parts[k]).astype(np.uint16).tobytes() for k in held], pa.binary())], ["chunk", "at"])

    def merge(frames):
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, at in zip(frame["chunk"], frame["at"]):
                total.setdefault(chunk, np.zeros(CHUNK, np.uint8))[np.frombuffer(at, np.uint16)] = 1
        if total:
            yield pd.DataFrame({"chunk": list(total), "bits": [np.packbits(x).tobytes() for x in total.values()]})

    chunks = CELLS * 8 // CHUNK
    out = np.zeros((chunks, CHUNK // 8), np.uint8)
    for row in keys.mapInArrow(tidy(probe), "chunk int, at binary").repartition(min(64, chunks), "chunk").mapInPandas(tidy(merge), "chunk int, bits binary").collect():  # CELLS bytes
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _probes(keys: np.ndarray) -> list[np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64))
    return [((h >> np.uint64(shift)) & np.uint64(CELLS * 8 - 1)).astype(np.int64) for shift in (0, 19, 38)]


def _may_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for probe in _probes(keys):
        ok &= (held[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8)) & 1 == 1
    return ok


def tokens_of(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """set_key, tokens of the sets named in keys (set_key, holder), written.

    holder is the least doc_id that holds the set's tokens, so of copies one row is taken. keys is a written table:
    where its files are small Spark broadcasts it, and only rows that it names are dealt out.
    """
    held = sets.where("tokens is not null").select("set_key", F.col("doc_id").alias("holder"), "tokens")
    held = held.join(keys.toDF("k", "h"), (F.col("set_key") == F.col("k")) & F.col("holder").eqNullSafe(F.col("h")), "left_semi")
    return written(held.select("set_key", "tokens"), "tokens")


def _folded(cells: list[bytes], words: int) -> np.ndarray:
    """The marked cells of sets as rows of so many 64-bit words; a wider row's cells fall on their remainders."""
    out = np.empty((len(cells), words), np.uint64)
    for i, x in enumerate(cells):
        row = np.frombuffer(x, np.uint64)
        out[i] = row if len(row) == words else np.bitwise_or.reduce(row.reshape(-1, words), 0)
    return out


def _most(na, ba, nb, bb) -> np.ndarray:
    """Greatest overlap of two sets that the marked cells of either leave possible."""
    return np.minimum(na - np.bitwise_count(ba & ~bb).sum(1), nb - np.bitwise_count(bb & ~ba).sum(1))


def plausible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the suffix filter doesn't exclude, with ha, hb; bits: set_key, n_shingles, bits, holder."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            ba, bb = (np.array(batch.column(i).to_pylist(), object) for i in (3, 5))
            least = np.array([min(len(x), len(y)) // 8 for x, y in zip(ba, bb)], np.int64)
            ok = np.zeros(len(na), bool)
            for words in np.unique(least).tolist():
                at = np.flatnonzero(least == words)
                ok[at] = _most(na[at], _folded(ba[at], words), nb[at], _folded(bb[at], words)) >= _required(na[at], nb[at], percent)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1, 6, 7)], ["a", "b", "ha", "hb"])

    left = bits.select(F.col("set_key").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("ba"), F.col("holder").alias("ha"))
    right = bits.select(F.col("set_key").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bb"), F.col("holder").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "ba", "nb", "bb", "ha", "hb")
    return both.mapInArrow(tidy(run), "a long, b long, ha long, hb long")


def confirmed(pairs: DataFrame, first: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, compared exactly; tokens: set_key, tokens; first: those of the sets a.

    All three are written tables, so that Spark can split the pairs of a hot a, which carry the tokens of b.
    """

    def run(batches):
        for batch in batches:
            left, right = _arrays(batch.column(2)), _arrays(batch.column(3))
            ok = []
            for x, y in zip(left, right):
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                same = int(np.count_nonzero(large[at] == small))
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    pairs = pairs.select("a", "b")
    right = tokens.select(F.col("set_key").alias("b"), F.col("tokens").alias("right")).join(pairs, "b")
    left = first.select(F.col("set_key").alias("a"), F.col("tokens").alias("left"))
    return right.join(left, "a").select("a", "b", "left", "right").mapInArrow(tidy(run), "a long, b long")


def units_of(met: DataFrame, roots: DataFrame, unit: int = UNIT) -> DataFrame:
    """unit, side, set_key, comp, n: the members of posting lists that reach over components.

    Lists with one least member are one unit, so near copies, which share many lists, are in few units. A heavy unit is
    cut into blocks: a row goes to each pair of blocks that its own is part of; side tells the two apart
    (0: both are one).
    """
    comps = roots.withColumnRenamed("node", "set_key")
    rows = met.select("token", F.col("head.set_key").alias("head"), "set_key", "n").join(comps, "set_key", "left")
    rows = written(rows.select("token", "head", "set_key", "n", F.coalesce("root", "set_key").alias("comp")), "rows")
    # A written table's size is known, so Spark broadcasts a short one and long lists aren't dealt out by their token.
    lists = written(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"), "lists")
    every, rows = rows, written(rows.join(lists, "token", "left_semi").select("head", "set_key", "n", "comp").distinct(), "open")
    discard(every, lists)
    weight = F.greatest(F.lit(1.0), F.col("n") * 2.0 / BITS)
    blocks = F.when(F.col("w") <= unit, 1).otherwise(F.ceil(F.sqrt(F.col("w") * 4.0 / unit))).cast("int")
    sizes = written(rows.groupBy("head").agg(F.sum(weight).alias("w")).select("head", blocks.alias("blocks")), "sizes")
    rows = rows.join(sizes, "head").withColumn("mine", F.pmod(F.xxhash64("set_key"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.xxhash64("head", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return rows.select(name.alias("unit"), side.alias("side"), "set_key", "comp", "n")


def _each_unit(frames):
    """(frame, first row, past-the-last row) of each unit, its rows by rising size, in frames sorted by unit and size."""
    for frame in _runs(frames):
        unit = frame["unit"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]])).tolist()
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield frame, lo, hi


def _meet(comp: np.ndarray, side: np.ndarray, i: int, end: int) -> np.ndarray:
    """Which rows after i up to end are its partners: those of another component, and of the other block if there are two."""
    return (comp[i + 1 : end] != comp[i]) & ((side[i] == 0) | (side[i + 1 : end] != side[i]))


def partnered(units: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """unit, side, set_key, comp, n, holder of the members that have a partner which no filter excludes."""

    def run(frames):
        for frame, lo, hi in _each_unit(frames):
            n, comp, side = (frame[c].to_numpy()[lo:hi].astype(np.int64) for c in ("n", "comp", "side"))
            cells = frame["bits"].to_list()[lo:hi] if hi - lo < len(frame) else frame["bits"].to_list()
            ends = np.searchsorted(n, n * 100 // percent, "right")  # length filter
            wide = np.array([len(x) // 8 for x in cells])  # rises with n
            good = np.zeros(hi - lo, bool)
            for words in np.unique(wide).tolist():
                first, last = np.searchsorted(wide, [words, words + 1])
                rows = _folded(cells[first : ends[last - 1]], words)
                for i in range(first, last):
                    j = i + 1 + np.flatnonzero(_meet(comp, side, i, ends[i]))
                    if len(j):
                        ok = _most(n[i], rows[i - first], n[j], rows[j - first]) >= _required(n[i], n[j], percent)
                        good[j[ok]] = True
                        good[i] |= ok.any()
            if good.any():
                yield frame.iloc[lo:hi][good][["unit", "side", "set_key", "comp", "n", "holder"]]

    rows = units.join(bits.select("set_key", "bits", "holder"), "set_key").select("unit", "side", "set_key", "comp", "n", "bits", "holder")
    return rows.repartition("unit").sortWithinPartitions("unit", "n").mapInPandas(tidy(run), "unit long, side int, set_key long, comp long, n int, holder long")


def forests(members: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span what links in each unit, by exact comparison in the unit's task: fewer rows than members."""

    def run(frames):
        for frame, lo, hi in _each_unit(frames):
            comp, side = (frame[c].to_numpy()[lo:hi].astype(np.int64) for c in ("comp", "side"))
            sets = _arrays(pa.array(frame["tokens"].to_list()[lo:hi] if hi - lo < len(frame) else frame["tokens"].to_list(), pa.binary()))
            n = np.array([len(s) for s in sets])
            ends = np.searchsorted(n, n * 100 // percent, "right")
            starts = np.concatenate([[0], np.cumsum(n)])
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mine, out = np.zeros(int(ids.max()) + 1, bool), []
            for i in range(hi - lo):
                if not _meet(comp, side, i, ends[i]).any():
                    continue
                mine[ids[starts[i] : starts[i + 1]]] = True
                same = np.add.reduceat(mine[ids[starts[i + 1] : starts[ends[i]]]], starts[i + 1 : ends[i]] - starts[i + 1], dtype=np.int64)
                mine[ids[starts[i] : starts[i + 1]]] = False
                links = 100 * same >= percent * (n[i] + n[i + 1 : ends[i]] - same)
                for j in (i + 1 + np.flatnonzero(links & _meet(comp, side, i, ends[i]))).tolist():
                    if comp[j] != comp[i]:
                        out.append((i, j))
                        comp[comp == comp[j]] = comp[i]
            if out:
                key = frame["set_key"].to_numpy()[lo:hi]
                i, j = np.array(out).T
                yield pd.DataFrame({"a": key[i], "b": key[j]})

    rows = members.join(tokens, "set_key").select("unit", "side", "set_key", "comp", F.length("tokens").alias("size"), "tokens")
    return rows.repartition("unit").sortWithinPartitions("unit", "size").mapInPandas(tidy(run), "a long, b long")


def linked_classes(sets: DataFrame, percent: int = PERCENT, unit: int = UNIT) -> DataFrame:
    """node, root: the components of all set keys that link with another (root: the least key)."""
    spark = sets.sparkSession
    levels = spark.sparkContext.broadcast(cell_levels(sets))
    several = postings(sets, levels, percent).groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    among = spark.sparkContext.broadcast(key_filter(several))
    relieve(spark)
    filed = written(postings(sets, levels, percent, among).distinct(), "filed")
    heads = filed.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("set_key", "n", "pos")).alias("head")).where("members > 1")
    heads = written(heads, "heads")
    met = written(filed.join(heads, "token"), "met")  # drops lists of one, which the filter may have passed
    discard(filed, heads)
    bits = sets.where("bits is not null").groupBy("set_key").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.min("doc_id").alias("holder"))
    bits = written(bits, "bits")
    stars = written(star_pairs(met, percent), "stars")
    pairs = written(plausible(stars, bits, percent), "pairs")
    keys = written(pairs.select("a", "ha").union(pairs.select("b", "hb")).distinct(), "keys")
    tokens = tokens_of(keys, sets)
    first = written(tokens.join(pairs.select(F.col("a").alias("set_key")).distinct(), "set_key", "left_semi"), "first")
    links = written(confirmed(pairs, first, tokens, percent), "links")
    roots = components(links)
    discard(stars, pairs, keys, tokens, first, links)
    relieve(spark)
    members = written(partnered(units_of(met.where("members > 2"), roots, unit), bits, percent), "members")  # a list of two has no other pair
    discard(met, bits)
    keys = written(members.select("set_key", "holder").distinct(), "keys")
    tokens = tokens_of(keys, sets)
    more = written(forests(members, tokens, percent), "links")
    discard(members, keys, tokens)
    relieve(spark)
    return components(roots.toDF("a", "b").unionByName(more))


def classed(docs: DataFrame, n: int = WORD_GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component_id, group for every row of docs.

    group is the same number for all rows of a component and null for rows without a shingle.
    """
    sets = written(sets_of(docs, n), "sets")
    roots = linked_classes(sets, percent)
    rows = written(sets.select("doc_id", "mark", "n_shingles", "set_key"), "rows")
    discard(sets)
    named = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    named = named.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    named = written(named.select("set_key", "root", "least"), "named")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    by_set = written(named.join(least, "root").select("set_key", "component_id", F.col("root").alias("group")), "by-set")
    discard(named, least)
    return rows.join(by_set, "set_key", "left").select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def classes(docs: DataFrame, n: int = WORD_GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return classed(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, n: int = WORD_GRAM, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the least id, with all its columns.

    Rows without a shingle all stay. Of rows equal in id and text that are least together one stays.
    """
    rows = written(classed(docs, n, percent), "classed")
    least = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("m"))
    kept = least.select(F.col("m.doc_id").alias("id"), F.col("m.mark").alias("m"), F.lit(True).alias("one"))
    bare = rows.where("group is null").select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), F.lit(False).alias("one")).distinct()
    kept = written(kept.unionByName(bare), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m"))
    sizes = written(rows.join(kept, same).groupBy("id", "m", "one").agg(F.count("*").alias("rows")), "kept")
    plain, own, names = veiled(docs)
    found = plain.join(sizes, F.col(own["doc_id"]).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(own["text"]) == F.col("m")))
    single = found.where("rows = 1 or not one").withColumn("nth", F.lit(1))
    several = found.where("rows > 1 and one").withColumn("nth", F.row_number().over(Window.partitionBy("id", "m").orderBy(F.lit(1))))
    return single.unionByName(several).where("nth = 1").select(*plain.columns).toDF(*names)
