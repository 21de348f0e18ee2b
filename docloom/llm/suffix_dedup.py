"""Exact-substring dedup over UTF-8 bytes: strings of a length that also start elsewhere.

A rule (:class:`Repeat`) names that length; several rules may be asked at once. Each window of the shortest rule's length is owned
by its least k-gram (by hash, the first of equals), and a longer window by the owner of its beginning, so equal windows have equal
anchors at equal places, and a window is repeated only if its anchor is. Only the contexts of repeated anchors, a few hundred
bytes each, are compared. Equal contexts of an anchor are one from then on, with a count. The contexts of an anchor
are ordered by suffix arrays (:mod:`docloom.llm.suffix_array`) of what follows and, reversed, of what precedes the anchor; two
windows are equal where both common prefixes reach far enough, whatever their length.

An anchor with more contexts than a task should hold is cut: its windows are dealt by quarters of their places, then sixteenths
and so on, to longer anchors that all windows of such a range have in common. The last range is one place, whose anchor is the window
itself, so this ends with one context for each anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.suffix_array import suffix_array
from docloom.plans.stored import drop_stored, free_shuffles, sized, small, stored


@dataclass(frozen=True)
class Repeat:
    """Bytes covered by strings of ``length`` bytes that start twice or more, if ``across`` in two documents or more.

    Runs of such bytes count only if they hold ``words`` whole words (between white space) or more. With ``words``, so many whole words in a row
    that come again count however short they are, so that such a rule finds all repeated passages of that many words.
    """

    length: int = 400
    across: bool = False
    words: int = 0


LENGTH = 400
#: A passage of over 50 words that several documents have. Where 51 words are 200 bytes or more, the bytes find it; windows of shorter words are found by themselves.
PASSAGE = Repeat(200, across=True, words=51)
#: The most bytes of a k-gram.
GRAM = 128
#: Bytes hashed together; longer texts are read in overlapping parts. Places take PLACE_BITS of a sort key.
PART, PLACE_BITS = 1 << 20, 24
#: Contexts of one anchor that a task may hold; beyond that the anchor is cut.
WIDE = 1024
#: Bytes of a suffix array's symbol, and contexts taken together.
SYMBOL, BATCH = 64, 2048

ANCHORS = "doc_id long, version long, at long, lo int, hi int, token long, digest long"
CONTEXTS = "token long, digest long, lo int, hi int, n long, low long, high long, bytes binary"
PIECES = "of_token long, of_digest long, " + CONTEXTS
COVERED = "token long, digest long, spans array<struct<rule:int,a:int,b:int>>"


def default_gram(length: int) -> int:
    """The largest power of two that leaves two thirds of a window of ``length`` for other places, GRAM at most."""
    return min(GRAM, 1 << max(0, (length // 3).bit_length() - 1))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram`` bytes in a row (a power of two), by doubling."""
    h, base, step = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while step < gram:
        h = h[:-step] + h[step:] * np.uint64(base)
        base, step = base * base % (1 << 64), step * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes the place of its least k-gram; and all k-gram hashes."""
    hashes = gram_hashes(data, gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    key = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    width, span, least = length - gram + 1, 1, key
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    count = len(key) - width + 1
    least = np.minimum(least[:count], least[width - span : width - span + count])
    return (least & mask).astype(np.int64), hashes


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def _anchors(short: int, long: int, gram: int):
    """Anchors of the windows of ``short`` bytes; their contexts hold windows of ``long`` bytes where the text goes on."""
    import xxhash

    def settle(parts: list[tuple[int, int, int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        """parts: doc_id, version, place in the text, bytes, windows that start in the part."""
        data = b"".join(p[3] for p in parts)
        if len(data) < short:
            return
        at, hashes = window_anchors(np.frombuffer(data, np.uint8), short, gram)
        sizes = np.array([len(p[3]) for p in parts])
        starts = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(parts)), sizes)[: len(at)]
        whole = np.arange(len(at)) - starts[part] < np.array([p[4] for p in parts])[part]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new & whole)
        if not len(first):
            return
        # A run of windows of one anchor ends where the next begins or where windows leave the part.
        stop = np.flatnonzero(np.append(new | ~whole, True))
        last = stop[np.searchsorted(stop, first, "right")] - 1
        p, own = at[first], part[first]
        end = np.minimum(last + long, (starts + sizes)[own])
        digest = xxhash.xxh3_64_intdigest
        # The number of windows is the seed: it tells contexts apart that the end of a text or part cuts to the same bytes.
        names = [digest(data[i:k], j - i) for i, j, k in zip(first.tolist(), last.tolist(), end.tolist())]
        ids = pa.array([parts[k][0] for k in own], pa.int64())
        versions = pa.array([parts[k][1] for k in own], pa.int64())
        base = np.array([x[2] for x in parts], np.int64)[own]
        yield pa.record_batch(
            [ids, versions, pa.array(base + p - starts[own]), pa.array((p - last).astype(np.int32)), pa.array((p - first).astype(np.int32)), pa.array(hashes[p].view(np.int64)), _signed(names)],
            names=[x.split()[0] for x in ANCHORS.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for doc, version, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = (text.as_py() or "").encode()
                for begin in range(0, len(data) - short + 1, PART):
                    piece = data[begin : begin + PART + long - 1]
                    parts.append((doc, version, begin, piece, min(PART, len(data) - short + 1 - begin)))
                    held += len(piece)
                    if held >= PART:
                        yield from settle(parts)
                        parts, held = [], 0
            yield from settle(parts)

    return run


def _context_rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(columns)], names=[name for name, _ in columns])


def _contexts(long: int):
    """Bytes of the contexts that lie in a document: (doc text, wanted contexts) to a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text, wanted in zip(b.column(0), b.column(1)):
                data = (text.as_py() or "").encode()
                rows += [(w["token"], w["digest"], w["lo"], w["hi"], w["n"], w["low"], w["high"], data[w["at"] - w["hi"] : w["at"] - w["lo"] + long]) for w in wanted.as_py()]
            yield _context_rows(rows, CONTEXTS)

    return run


def _blocks(strings: list[bytes], width: int) -> np.ndarray:
    """A row of ``width`` bytes each, all bytes one up (UTF-8 has none of 255), filled with zeros."""
    rows = np.zeros((len(strings), width), np.uint8)
    for row, s in zip(rows, strings):
        row[: len(s)] = np.frombuffer(s, np.uint8)
        row[: len(s)] += 1
    return rows


def _ranks(right: np.ndarray, left: np.ndarray, right_sizes: np.ndarray, left_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order of all right parts and of all left parts.

    The text is each context's two parts as symbols of SYMBOL bytes, with a separator after each that is below all
    symbols; a symbol's name keeps the order of its bytes.
    """
    both = [np.ascontiguousarray(x).view(">u8").astype(np.uint64).reshape(len(x), -1, SYMBOL // 8) for x in (right, left)]
    counts = [-(-s // SYMBOL) for s in (right_sizes, left_sizes)]
    flat = np.concatenate([x.reshape(-1, SYMBOL // 8) for x in both])
    order = np.lexsort(flat.T[::-1])
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[order][1:] != flat[order][:-1]).any(1)
    name = np.empty(len(flat), np.int64)
    name[order] = np.cumsum(fresh) + 1
    cut = len(right) * both[0].shape[1]
    symbols = np.zeros((len(right), both[0].shape[1] + both[1].shape[1] + 2), np.int64)
    held = np.zeros(symbols.shape, bool)
    at = 0
    starts = []
    for names, count in ((name[:cut].reshape(len(right), -1), counts[0]), (name[cut:].reshape(len(right), -1), counts[1])):
        wide = names.shape[1]
        symbols[:, at : at + wide], symbols[:, at + wide] = names, 1
        held[:, at : at + wide], held[:, at + wide] = np.arange(wide) < count[:, None], True
        at += wide + 1
    per = held.sum(1)
    starts.append(np.cumsum(per) - per)
    starts.append(starts[0] + counts[0] + 1)
    text = [*symbols[held].tolist(), 0]
    rank = np.empty(len(text), np.int64)
    rank[suffix_array(text)] = np.arange(len(text))
    return rank[starts[0]], rank[starts[1]]


def _common(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Common prefix of each row in ``order`` with the one before; -1 where that is of another anchor."""
    a, b = order[1:], order[:-1]
    same = rows[a] == rows[b]
    found = np.where(same.all(1), rows.shape[1], same.argmin(1))
    found = np.minimum(found, np.minimum(sizes[a], sizes[b]))
    return np.concatenate(([-1], np.where(token[a] == token[b], found, -1)))


def repeated_offsets(token: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: list[bytes], times: np.ndarray, low: np.ndarray, high: np.ndarray, rules: list[Repeat]) -> list[np.ndarray]:
    """For each rule a row for each context, true at each offset whose window is repeated.

    A window at offset o starts o bytes before the anchor; a context holds those of offsets lo to hi. It stands for ``times``
    places, in documents with keys from ``low`` to ``high``.
    """
    right, left = [c[h:] for c, h in zip(contexts, hi)], [c[:h][::-1] for c, h in zip(contexts, hi)]
    sizes = [np.array(list(map(len, x))) for x in (right, left)]
    rows = [_blocks(x, -(-max(1, int(s.max())) // SYMBOL) * SYMBOL) for x, s in zip((right, left), sizes)]
    ranks = _ranks(rows[0], rows[1], sizes[0], sizes[1])
    orders = [np.lexsort((r, token)) for r in ranks]
    common = [_common(*x, token) for x in zip(rows, sizes, orders)]

    def runs(side: int, need: int) -> np.ndarray:
        """Numbers of the runs of contexts that have ``need`` bytes of this side in common."""
        run = np.empty(len(token), np.int64)
        run[orders[side]] = np.cumsum(common[side] < need)
        return run

    found = [np.zeros((len(contexts), int(hi.max()) + 1), bool) for _ in rules]
    for o in range(int(lo.min()), int(hi.max()) + 1):
        here = (lo <= o) & (o <= hi)
        before = runs(1, o) * (len(contexts) + 1)
        for rule, marks in zip(rules, found):
            own = np.flatnonzero(here & (sizes[0] >= rule.length - o))
            if not len(own):
                continue
            pair = (before + runs(0, rule.length - o))[own]
            order = np.argsort(pair, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(pair[order]) != 0)))
            inside = own[order]
            if rule.across:
                again = np.minimum.reduceat(low[inside], edge) != np.maximum.reduceat(high[inside], edge)
            else:
                again = np.add.reduceat(times[inside], edge) > 1
            marks[inside, o] = np.repeat(again, np.diff(np.append(edge, len(inside))))
    return found


def _spans(found: list[np.ndarray], rules: list[int]) -> tuple[np.ndarray, pa.Array]:
    """The rows that have some offset, and for each the ranges of its offsets as structs rule, a, b."""
    parts = []
    for rule, flags in zip(rules, found):
        edges = np.diff(np.pad(flags.view(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, a), (_, b) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        parts.append(np.stack([row, np.full(len(row), rule), a, b - 1]))
    row, rule, a, b = (both := np.concatenate(parts, axis=1))[:, np.argsort(both[0], kind="stable")]
    rows, starts = np.unique(row, return_index=True)
    ranges = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (rule, a, b)], ["rule", "a", "b"])
    return rows, pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), ranges)


def _compare(rules: list[tuple[int, Repeat]]):
    """Contexts sorted by anchor to the offsets repeated in each; whole anchors are taken together."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = pa.Table.from_batches(held).combine_chunks()
        token, lo, hi, times, low, high = (columns.column(k).to_numpy().astype(np.int64) for k in (0, 2, 3, 4, 5, 6))
        found = repeated_offsets(token, lo, hi, columns.column(7).to_pylist(), times, low, high, [r for _, r in rules])
        some, spans = _spans(found, [k for k, _ in rules])
        return pa.record_batch([*(columns.column(k).combine_chunks().take(pa.array(some)) for k in range(2)), spans], names=["token", "digest", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= BATCH:
                token = b.column(0).to_numpy()
                cut = int(np.flatnonzero(token != token[-1])[-1]) + 1 if (token != token[-1]).any() else 0
                if not cut and (len(held) == 1 or held[-2].column(0)[-1].as_py() == token[-1]):
                    continue  # the anchor goes on
                last = held.pop().slice(0, cut)
                yield settle([*held, last] if cut else held)
                held = [b.slice(cut)]
        if held:
            yield settle(held)

    return run


def _split(rule: Repeat, level: int, slack: int):
    """Contexts to those of longer anchors: ranges of places, a quarter as long at each level, with what all windows of a range have in common as its name."""
    import xxhash

    step = 1 << max(0, slack.bit_length() - 2 * level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            rows: list[tuple] = []
            for token, name, lo, hi, n, low, high, data in zip(*(c.to_pylist() for c in b.columns)):
                least = max(lo, rule.length - (len(data) - hi))
                for begin in range(lo - lo % step, hi + 1, step):
                    end = min(begin + step - 1, slack)
                    a, z = max(least, begin), min(hi, end)
                    if a > z:
                        continue
                    piece = data[hi - z : hi - a + rule.length]
                    new = digest(data[hi - begin : hi - end + rule.length], (token + (level << 32) + begin) & 0xFFFFFFFFFFFFFFFF)
                    rows.append((token, name, _one(new), _one(digest(piece, z - a)), a, z, n, low, high, piece))
            yield _context_rows(rows, PIECES)

    return run


def _one(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _of_wide(said: DataFrame, index: int, rule: Repeat, slack: int, done: list[DataFrame], level: int = 1) -> DataFrame:
    """COVERED rows for contexts of very common anchors, whose windows are dealt to longer anchors. ``done`` takes up the tables written."""
    pieces = stored(said.mapInArrow(_split(rule, level, slack), PIECES), "pieces")
    contexts = stored(
        pieces.groupBy("token", "digest").agg(*[f(c).alias(c) for c, f in (("lo", F.first), ("hi", F.first), ("n", F.sum), ("low", F.min), ("high", F.max), ("bytes", F.first))]), "contexts"
    )
    wide = stored(_wide(contexts), "wide")
    done += [pieces, contexts, wide]
    found = _in_order(contexts.join(sized(wide), "token", "left_anti"), [(index, rule)])
    if 2 * level < slack.bit_length() and not wide.isEmpty():
        found = found.unionAll(_of_wide(contexts.join(sized(wide), "token", "left_semi"), index, rule, slack, done, level + 1))
    return found.join(pieces.select("of_token", "of_digest", "token", "digest"), ["token", "digest"]).select(F.col("of_token").alias("token"), F.col("of_digest").alias("digest"), "spans")


def _wide(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("token").agg(F.count("*").alias("contexts")).where(F.col("contexts") > WIDE).select("token")


def _in_order(contexts: DataFrame, rules: list[tuple[int, Repeat]]) -> DataFrame:
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    return contexts.select(*names).repartition("token").sortWithinPartitions("token").mapInArrow(_compare(rules), COVERED)


def _runs(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The runs that ranges, which may overlap or touch, cover together."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.concatenate(([True], start[1:] > reach[:-1]))
    return list(zip(start[first].tolist(), reach[np.append(first[1:], True)].tolist()))


def whole_words(data: bytes, start: int, stop: int) -> int:
    """Words of ``data`` that lie in start to stop as a whole."""
    split = [0 < at < len(data) and not data[at - 1 : at].isspace() and not data[at : at + 1].isspace() for at in (start, stop)]
    return max(0, len(data[start:stop].split()) - sum(split))


SHORT = "doc_id long, version long, rule int, start long, stop long, high long, low long"


def word_windows(data: np.ndarray, words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of ``words`` whole words that are shorter than ``length`` bytes start and stop."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    if len(starts) < words:
        return starts[:0], stops[:0]
    starts, stops = starts[: len(starts) - words + 1], stops[words - 1 :]
    narrow = stops - starts < length
    return starts[narrow], stops[narrow]


def _short(rules: list[Repeat]):
    """Windows of words that are too short for the byte strings of their rule, by the 128-bit digest of their bytes."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for b in batches:
            for doc, version, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = (text.as_py() or "").encode()
                for k, rule in enumerate(rules):
                    if not rule.words:
                        continue
                    starts, stops = word_windows(np.frombuffer(data, np.uint8), rule.words, rule.length)
                    for at in range(0, len(starts), 1 << 16):
                        own = [digest(data[i:j]) for i, j in zip(starts[at : at + (1 << 16)].tolist(), stops[at : at + (1 << 16)].tolist())]
                        n = len(own)
                        yield pa.record_batch(
                            [
                                pa.array([doc] * n, pa.int64()), pa.array([version] * n, pa.int64()), pa.array([k] * n, pa.int32()), pa.array(starts[at : at + n]), pa.array(stops[at : at + n]),
                                _signed([x >> 64 for x in own]), _signed([x & (1 << 64) - 1 for x in own]),
                            ],
                            names=[x.split()[0] for x in SHORT.split(", ")],
                        )

    return run


def _short_ranges(whole: DataFrame, rules: list[Repeat], key) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, range) of the short windows that come again, and the stored table that they are read from."""
    windows = stored(whole.select("doc_id", "version", "text").mapInArrow(_short(rules), SHORT), "short-windows")
    across = F.element_at(F.array(*[F.lit(r.across) for r in rules]), F.col("rule") + 1)
    digests = windows.groupBy("rule", "high", "low").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("times"))
    again = digests.where((F.col("times") > 1) & (~across | (F.col("least") != F.col("most")))).select("rule", "high", "low")
    return windows.join(again, ["rule", "high", "low"]).select("doc_id", "version", F.struct("rule", "start", "stop").alias("range")), windows


def _cut(rules: list[Repeat], keep_text: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            listed = b.column(2)
            flat = listed.flatten()
            which, start, stop = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))
            for text, begin, end in zip(b.column(1), np.concatenate(([0], ends[:-1])).tolist() if len(ends) else [], ends.tolist()):
                data = (text.as_py() or "").encode()
                own = slice(begin, end)
                found = [_runs(start[own][which[own] == k], stop[own][which[own] == k]) for k in range(len(rules))]
                found = [[r for r in runs if not rule.words or whole_words(data, *r) >= rule.words] for rule, runs in zip(rules, found)]
                kept, at = [], 0
                for first, last in found[0]:
                    kept.append(data[at:first])
                    at = last
                left = b"".join([*kept, data[at:]])
                spans = [[{"start": s, "stop": e} for s, e in x] for x in found]
                rows.append((
                    len(data), sum(e - s for s, e in found[0]), len(found[0]), hashlib.sha256(left).hexdigest(),
                    spans[0], spans[1] if len(spans) > 1 else None, left.decode("utf-8", "ignore") if keep_text else None,
                ))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind, kind, pa.string())
            names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "reported", "kept_text")
            yield pa.record_batch([b.column(0), *(pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)), b.column(3), b.column(4)], names=["doc_id", *names, "was_null", "rest"])

    return run


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, keep_text: bool = True,
    carry: list[str] | None = None, rule: Repeat | None = None, report: Repeat | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, reported, kept_text, was_null, rest.

    What ``rule`` finds, by default all strings of ``length`` bytes that start twice, is removed. ``spans`` are the removed runs of
    bytes; ``kept_text`` is what is left, without characters that a cut split (null with ``keep_text`` off). ``reported`` are the
    runs of a second rule, which are not removed (null without one). ``rest`` holds the columns named in ``carry``. Null and empty texts,
    and such shorter than a rule's length and words, are kept whole. A repeated row is a document
    of its own, so both it and its copy go; only for a rule that asks for two documents rows of one id and text are one. Null ids are
    kept. An empty table gives an empty result; other columns are not read. ``gram`` has to be a power of two and under the shortest length.
    """
    spark = docs.sparkSession
    rules = [rule or Repeat(length), *([report] if report else [])]
    short, long = min(r.length for r in rules), max(r.length for r in rules)
    gram = gram or default_gram(short)
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(text).isNull().alias("was_null"), rest.alias("rest"))
    whole = whole.withColumn("version", F.xxhash64("text"))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "version")
    keyed = whole.withColumn("key", key)
    same = F.expr("d.key = o.key and d.version = o.version and d.doc_id <=> o.doc_id")

    anchors = stored(whole.select("doc_id", "version", "text").mapInArrow(_anchors(short, long, gram), ANCHORS), "anchors")
    again = stored(anchors.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token"), "tokens")
    repeated = stored(anchors.join(again, "token"), "repeated")
    drop_stored(anchors, again)
    free_shuffles(spark)

    one = F.min(F.struct("doc_id", "version", "at", "lo", "hi")).alias("one")
    grouped = repeated.groupBy("token", "digest").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), one)
    context = stored(grouped.select("token", "digest", "n", "low", "high", "one.*"), "contexts")
    wide = stored(_wide(context), "wide")
    done = [repeated, context, wide]
    free_shuffles(spark)

    def said(of: DataFrame) -> DataFrame:
        """The bytes of contexts, each read from one document."""
        wanted = of.groupBy(key.alias("key"), "doc_id", "version").agg(F.collect_list(F.struct("token", "digest", "at", "lo", "hi", "n", "low", "high")).alias("wanted"))
        return _named(keyed, of).alias("d").join(wanted.alias("o"), same).select("text", "wanted").mapInArrow(_contexts(long), CONTEXTS)

    def _named(rows: DataFrame, by: DataFrame) -> DataFrame:
        """The rows that ``by`` names, if a broadcast can tell them from the others before they are shuffled."""
        done.append(keys := stored(by.select(key.alias("key")).distinct(), "keys"))
        return rows.join(F.broadcast(keys), "key", "left_semi") if small(keys) else rows

    found = _in_order(said(context.join(sized(wide), "token", "left_anti")), list(enumerate(rules)))
    if not wide.isEmpty():
        done.append(common := stored(said(context.join(sized(wide), "token", "left_semi")), "common"))
        for k, r in enumerate(rules):
            found = found.unionAll(_of_wide(common, k, r, short - gram, done))
    covered = stored(found, "covered")
    free_shuffles(spark)

    lengths = F.element_at(F.array(*[F.lit(r.length) for r in rules]), F.col("s.rule") + 1)
    each = repeated.join(covered, ["token", "digest"]).select("doc_id", "version", "at", F.explode("spans").alias("s"))
    ranges = each.select("doc_id", "version", F.struct("s.rule", (F.col("at") - F.col("s.b")).alias("start"), (F.col("at") - F.col("s.a") + lengths).alias("stop")).alias("range"))
    if any(r.words for r in rules):
        short_ranges, windows = _short_ranges(whole, rules, key)
        ranges, done = ranges.unionAll(short_ranges), [*done, windows]
    places = ranges.groupBy(key.alias("key"), "doc_id", "version").agg(F.collect_list("range").alias("covered"))
    places = stored(places, "places")
    drop_stored(covered, *done)
    free_shuffles(spark)
    keys = stored(places.select("key").distinct(), "keys")
    carried = whole.schema["rest"].dataType.simpleString()
    runs = "array<struct<start:bigint,stop:bigint>>"
    out = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {runs}, reported {runs}, kept_text string, was_null boolean, rest {carried}"

    def cut(rows: DataFrame) -> DataFrame:
        return rows.alias("d").join(places.alias("o"), same, "left").select("d.doc_id", "text", "covered", "was_null", "rest").mapInArrow(_cut(rules, keep_text), out)

    if not small(keys):
        return cut(keyed)
    zero, none = F.lit(0).cast("long"), F.array().cast(runs)
    untouched = keyed.join(F.broadcast(keys), "key", "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        none.alias("spans"), (none if report else F.lit(None).cast(runs)).alias("reported"), (F.col("text") if keep_text else F.lit(None).cast("string")).alias("kept_text"), "was_null", "rest",
    )
    return cut(keyed.join(F.broadcast(keys), "key", "left_semi")).unionByName(untouched)
