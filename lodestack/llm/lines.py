"""Line deduplication by an exact set-similarity join.

A line is the set of its distinct lower-cased words. Words are put in one order over all texts, rare ones first: rarity is a
count by hashed bucket, in a table of fixed size, with the word's hash deciding among equals. Two sets that reach the
threshold then share a word among the first few of each (prefix filter), are of similar size (length filter), and enough
words are left from the shared place on (positional filter). A sketch of 64 bits, 256 for long lines, that changes by one
bit per word bounds how much two sets differ. Candidates that pass are confirmed on their full sets.

Equal sets are folded first: only the first line of a set is compared. Prefix words that no other set has are left out. The
rest is exchanged by word and put in order by word and size, so that the sets similar in size to one stand in one stretch
before it; of a word's sets only that stretch is held. A line goes when an earlier one matches it, so one match is enough:
under prefix words with many sets every set first meets the earliest one, and sets that found a match there are not compared
again. Texts are tokenised twice, for the rarity and for the sets; of candidates alone the lines are tokenised once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.filters import bit_filter, passes
from lodestack.llm.tables import releasing
from lodestack.llm.words import BLOCK, LOWER, WORDS, byte_view, mixed, slices, span_hashes, token_spans, word_hashes

PERCENT = 80
RARITY_BITS = 16
#: Bits of a word's place in a line's order, and what is left for the line's number among those sorted at once.
ORDER_BITS = 43
#: Words from which a line has the wide sketch.
LONG = 100
#: Sets under one prefix word beyond which they meet the earliest of them first; it only spares comparisons.
CROWDED = 1000
FILTER_BITS = 24
CROWDED_BITS = 20
#: Bytes of text tokenised together, few enough for a core's cache.
SLICE = 1 << 19
#: Pairs looked at together.
PAIRS = 1 << 16

_U = np.uint64
_LINE = _U(0xC2B2AE3D27D4EB4F)
#: What a prefix word carries of its set, in one column: its place in the set, whether the set still needs a match, name, order and sketch.
_POSTING = np.dtype([("at", "<i4"), ("open", "<i4"), ("name", "<i8"), ("order", "<i8"), ("sketch", "<u8", 4)])


def line_words(column: pa.Array, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, begin, words): lines with words, and the distinct words of each, by `rank` of their bucket or, without, by hash."""
    data, offsets = byte_view(column)
    starts, ends, first = token_spans(data, offsets, WORDS)
    words = span_hashes(data, starts, ends, LOWER)
    breaks = np.flatnonzero(data == 0x0A)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    line = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1))[:-1] + row
    if rank is None:
        place = words >> _U(64 - ORDER_BITS)
    else:
        low = _U(ORDER_BITS - RARITY_BITS)
        place = rank[(words & _U(len(rank) - 1)).view(np.int64)].astype(_U) << low | words >> _U(64) - low
    keys = line.astype(_U) << _U(ORDER_BITS) | place
    order = np.argsort(keys)
    keys, sorted_words = keys[order], words[order]
    new = np.ones(len(words), bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    alike = np.zeros(len(words), bool)
    alike[1:] = keys[1:] == keys[:-1]
    if len(line) and line[-1] >> 64 - ORDER_BITS or (new & alike).any():  # too many lines for a key, or two words of one place
        order = np.lexsort((words, place, line))
        sorted_words = words[order]
        new[1:] = sorted_words[1:] != sorted_words[:-1]
    line = line[order]
    new[1:] |= line[1:] != line[:-1]
    words, line, row = sorted_words[new], line[new], row[order[new]]
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    base = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)
    return row[begin], line[begin] - base[row[begin]], np.concatenate([begin, [len(words)]]), words


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def places(r: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A 64-bit name of a line within its row."""
    return mixed(mixed(r.view(_U)) + line.astype(_U) * _LINE)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _packed(x: np.ndarray, width: int) -> pa.Array:
    """Rows of `width` bytes each as a binary column."""
    count = x.nbytes // width
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(np.arange(count + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(byte_view(column)[0], kind)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in slices(batches, "text", SLICE):
        words = word_hashes(batch.column(0))[0]
        table += np.bincount((words & _U(len(table) - 1)).view(np.int64), minlength=len(table))
    used = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(table[used], pa.int64())], names=["bucket", "n"])


def word_ranks(texts: DataFrame) -> np.ndarray:
    """The place of each hashed bucket of words when those that occur least in all texts come first."""
    got = texts.select("text").mapInArrow(releasing(_counts), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2^RARITY_BITS rows
    table = np.zeros(1 << RARITY_BITS, np.int64)
    table[got["bucket"].to_numpy()] = got["n"].to_numpy()
    ranks = np.empty(len(table), np.uint32)
    ranks[np.argsort(table, kind="stable")] = np.arange(len(table), dtype=np.uint32)
    return ranks


def _keys(words: np.ndarray) -> np.ndarray:
    """Half of a word's hash, as the key that candidates meet under; two words with one key only cost a comparison."""
    return (words >> _U(32)).astype(np.uint32).view(np.int32)


def _sketches(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Four times 64 bits per set, each turned by the words that fall on it: sets that differ in d words differ in at most
    d bits, and so do the four parts laid over each other. Short sets have them laid over each other in the first."""
    if len(begin) < 2:
        return np.zeros((0, 4), _U)
    bits, part = _U(1) << (words >> _U(20) & _U(63)), words >> _U(26) & _U(3)
    parts = np.stack([np.bitwise_xor.reduceat(np.where(part == k, bits, _U(0)), begin[:-1]) for k in range(4)], axis=1)
    short = np.diff(begin) < LONG
    parts[short, 0] = np.bitwise_xor.reduce(parts[short], axis=1)
    parts[short, 1:] = 0
    return parts


def _lines(shipped, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            row, line, begin, words = line_words(batch.column(0), shipped.value)
            n = np.diff(begin)
            sizes = prefix_sizes(n, percent)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            kept = np.arange(cuts[-1]) + np.repeat(begin[:-1] - cuts[:-1], sizes)
            r = np.array(batch.column(1), np.int64)[row]
            sketches = _sketches(words, begin)
            sums = [np.add.reduceat(x, begin[:-1]) if len(n) else x[:0] for x in (words, mixed(words ^ _LINE))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2).take(pa.array(row)), _long(r), pa.array(line, pa.int32()), _long(sums[0]), _long(sums[1]), pa.array(n, pa.int32()),
                    _packed(sketches, 32), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(_keys(words[kept]), pa.int32())),
                ],
                names=["doc_id", "r", "line", "name", "check", "n", "sketch", "words"],
            )

    return run


def _postings(shipped):
    """From name, n, sketch, words, open, order and further columns: a row for each prefix word in the filter. `meet` is the word and
    the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, words = np.asarray(lists.offsets), np.asarray(lists.values)
            words = words[offsets[0] : offsets[-1]]
            size = np.diff(offsets)
            row = np.repeat(np.arange(len(size)), size)
            keep = np.flatnonzero(passes(shipped.value, mixed(words.view(np.uint32))))
            row, words = row[keep], words[keep]
            out = np.empty(len(row), _POSTING)
            out["at"] = keep - (offsets[:-1] - offsets[0])[row]
            out["open"], out["name"] = np.asarray(batch.column(4))[row], np.asarray(batch.column(0))[row]
            out["order"] = np.asarray(batch.column(5))[row]
            out["sketch"] = _unpacked(batch.column(2), _U).reshape(-1, 4)[row]
            meet = (words.astype(np.int64) << 32) + np.asarray(batch.column(1), np.int64)[row]
            rows = pa.array(row)
            more = [c.take(rows) for c in batch.columns[6:]]
            yield pa.RecordBatch.from_arrays([_long(meet), _packed(out, _POSTING.itemsize), *more], names=["meet", "posting", *batch.schema.names[6:]])

    return run


def _full_sets(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = byte_view(batch.column(0))
            breaks = np.flatnonzero(data == 0x0A)
            before = np.searchsorted(breaks, offsets)
            first = before[:-1] + np.arange(batch.num_rows)  # lines before those of a row: one more per row than line feeds
            row = np.repeat(np.arange(batch.num_rows), np.diff(before) + 1)
            line = np.arange(len(row)) - first[row]
            r = np.array(batch.column(1), np.int64)[row]
            picked = np.flatnonzero(passes(shipped.value, places(r, line)))
            starts, ends = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
            starts[first], ends[first + np.diff(before)] = offsets[:-1], offsets[1:]
            inner = np.arange(len(breaks)) + np.repeat(np.arange(batch.num_rows), np.diff(before))  # the lines that a line feed ends
            ends[inner], starts[inner + 1] = breaks, breaks + 1
            view = memoryview(np.ascontiguousarray(data))
            chosen = pa.array([view[a:z] for a, z in zip(starts[picked].tolist(), ends[picked].tolist())], pa.binary())
            of, _, begin, words = line_words(chosen, None)  # by hash within a line
            yield pa.RecordBatch.from_arrays([_long(r[picked[of]]), pa.array(line[picked[of]], pa.int32()), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), _long(words))], names=["r", "line", "words"])

    return run


def _mixed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_long(mixed(np.array(batch.column(0), np.int32).view(np.uint32)))], names=["p"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        o = places(np.array(batch.column(0), np.int64), np.array(batch.column(1), np.int64))
        yield pa.RecordBatch.from_arrays([_long(o)], names=["o"])


def _matching(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            x, y = batch.column(1), batch.column(2)
            fx, fy, wx, wy = np.asarray(x.offsets), np.asarray(y.offsets), np.asarray(x.values), np.asarray(y.values)
            for i in range(batch.num_rows):
                both = np.concatenate([wx[fx[i] : fx[i + 1]], wy[fy[i] : fy[i + 1]]])
                total = len(both)
                both.sort()
                common = np.count_nonzero(both[1:] == both[:-1])  # a word is once in a set
                keep[i] = 100 * common >= percent * (total - common)
            yield batch.select([0]).filter(pa.array(keep))

    return run


def could_match(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (x[i], y[j]) of postings, of sets of n[i] and m[j] words, pass: length filter, positional filter on the
    shared place, and the fewest words by which the sketches say the sets differ."""
    n, m = n[i], m[j]
    sizes = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
    left = np.minimum(n - x["at"][i], m - y["at"][j]) * (100 + percent) >= (n + m) * percent
    chosen = np.flatnonzero(sizes & left & (x["name"][i] != y["name"][j]))
    n, m = n[chosen], m[chosen]
    parts = x["sketch"][i[chosen]] ^ y["sketch"][j[chosen]]
    differ = np.bitwise_count(np.bitwise_xor.reduce(parts, axis=1)).astype(np.int64)
    wide = np.bitwise_count(parts).sum(axis=1, dtype=np.int64)
    differ = np.where((n >= LONG) & (m >= LONG), wide, differ)  # the wide sketches say no less
    return chosen[(n + m - differ) * (100 + percent) >= 2 * percent * (n + m)]


def _size(meet: np.ndarray) -> np.ndarray:
    return meet & 0xFFFFFFFF


def _met(percent: int):
    """(x, y, order of y) from rows in the order of `meet`: each row meets the rows before it with the same word and a similar
    size. y is not after x by their orders; if these are equal the pair comes both ways. x needs a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meet, rows = np.zeros(0, np.int64), np.zeros(0, _POSTING)
        for batch in batches:
            held = len(meet)
            meet = np.concatenate([meet, np.asarray(batch.column(0))])
            rows = np.concatenate([rows, _unpacked(batch.column(1), _POSTING)])
            n, is_open, later = _size(meet), rows["open"] > 0, meet[held:]
            low = np.searchsorted(meet, later - n[held:] + (n[held:] * percent + 99) // 100)
            count = np.arange(held, len(meet)) - low
            ends, start = np.cumsum(count), 0
            while start < len(later):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
                many = count[start:end]
                j = np.repeat(np.arange(start, end) + held, many)
                i = np.arange(len(j)) + np.repeat(low[start:end] - (np.cumsum(many) - many), many)
                start = end
                chosen = could_match(n, rows, n, rows, i, j, percent)
                i, j = i[chosen], j[chosen]
                x, y = np.concatenate([i, j]), np.concatenate([j, i])
                keep = (rows["order"][y] <= rows["order"][x]) & is_open[x]
                x, y = x[keep], y[keep]
                yield pa.RecordBatch.from_arrays([_long(rows["name"][x]), _long(rows["name"][y]), _long(rows["order"][y])], names=["x", "y", "o"])
            first = low[-1] if len(later) else 0  # rows before it are too small for, or of another word than, all that come
            meet, rows = meet[first:], rows[first:]

    return run


def _met_first(percent: int):
    """(x, y, order of y) from rows that hold both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (_size(np.asarray(batch.column(k))) for k in (0, 2))
            x, y = (_unpacked(batch.column(k), _POSTING) for k in (1, 3))
            every = np.arange(batch.num_rows)
            chosen = could_match(n, x, m, y, every, every, percent)
            yield pa.RecordBatch.from_arrays([_long(x["name"][chosen]), _long(y["name"][chosen]), _long(y["order"][chosen])], names=["x", "y", "o"])

    return run


def lines_to_keep(texts: DataFrame, scratch, percent: int) -> DataFrame:
    """(r, line) of the lines with words that stay; texts has text, r and doc_id."""
    context = texts.sparkSession.sparkContext
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, r bigint, line int, name bigint, `check` bigint, n int, sketch binary, words array<int>"
    lines = texts.select("text", "r", "doc_id").mapInArrow(releasing(_lines(context.broadcast(word_ranks(texts)), percent)), schema)
    folded = lines.groupBy("name", "check").agg(F.min(F.struct("doc_id", "r", "line", "n", "sketch", "words")).alias("s"))
    sets = scratch.put(folded.select("name", "s.*"))
    counts = scratch.put(sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("t")).where("t > 1"))
    shared = bit_filter(counts.select("word").mapInArrow(_mixed_keys, "p bigint"), F.col("p"), FILTER_BITS)
    crowded = bit_filter(counts.where(F.col("t") > CROWDED).select("word").mapInArrow(_mixed_keys, "p bigint"), F.col("p"), CROWDED_BITS)
    scratch.drop(counts)

    # only whole numbers are compared before candidates are confirmed, where the ids themselves are
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))) if whole else F.lit(0).cast("bigint")

    def posted(df: DataFrame, table: np.ndarray, *more: str) -> DataFrame:
        further = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in more)
        return df.select("name", "n", "sketch", "words", "open", order.alias("order"), *more).mapInArrow(releasing(_postings(context.broadcast(table))), f"meet bigint, posting binary{further}")

    def matched(pairs: DataFrame) -> DataFrame:
        """The names x of the pairs (x, y) that reach the threshold with y before x. Each x tries the y of the least order first,
        and the others only if that fails, so that a group of alike sets costs as many comparisons as it has sets."""
        pairs = scratch.put(pairs.distinct())
        ends = pairs.select(F.col("x").alias("name")).unionByName(pairs.select(F.col("y").alias("name"))).distinct()
        wanted = scratch.put(sets.select("name", "doc_id", "r", "line").join(ends, "name"))
        chosen = bit_filter(wanted.select("r", "line").mapInArrow(_placed, "o bigint"), F.col("o"), FILTER_BITS)
        read = texts.select("text", "r").mapInArrow(releasing(_full_sets(context.broadcast(chosen))), "r bigint, line int, words array<bigint>")
        # rows that are equal in every column name their lines alike
        full = scratch.put(wanted.join(read, ["r", "line"]).dropDuplicates(["name"]).select("name", F.struct("doc_id", "r", "line").alias("first"), "words"))

        def confirmed(some: DataFrame) -> DataFrame:
            x = some.join(full.select(F.col("name").alias("x"), F.col("first").alias("first_x"), F.col("words").alias("words_x")), "x")
            both = x.join(full.select(F.col("name").alias("y"), F.col("first").alias("first_y"), F.col("words").alias("words_y")), "y")
            return scratch.put(both.where("first_y < first_x").select("x", "words_x", "words_y").mapInArrow(releasing(_matching(percent)), "x bigint").distinct())

        nearest = scratch.put(pairs.groupBy("x").agg(F.min_by("y", "o").alias("y")))
        near = confirmed(nearest)
        late = confirmed(pairs.select("x", "y").join(near, "x", "left_anti").join(nearest, ["x", "y"], "left_anti"))
        scratch.drop(pairs, wanted, full, nearest)
        return near.unionByName(late)

    word, marked, gone = F.shiftright("meet", 32), sets.withColumn("open", F.lit(True)), None
    if crowded.any():
        rows = scratch.put(posted(marked, crowded, "doc_id", "r", "line").withColumn("word", word))
        earliest = rows.groupBy("word").agg(F.min(F.struct("doc_id", "r", "line", "meet", "posting")).alias("y"))
        star = rows.join(earliest, "word").select("meet", "posting", F.col("y.meet").alias("meet_y"), F.col("y.posting").alias("posting_y"))
        gone = matched(star.mapInArrow(_met_first(percent), "x bigint, y bigint, o bigint"))
        scratch.drop(rows)
        marked = sets.join(gone, sets["name"] == gone["x"], "left").select(*sets.columns, F.isnull("x").alias("open"))
    met = posted(marked, shared).repartition(word).sortWithinPartitions("meet").mapInArrow(releasing(_met(percent)), "x bigint, y bigint, o bigint")
    late = matched(met)
    all_gone = late if gone is None else gone.unionByName(late)
    return sets.join(all_gone, sets["name"] == all_gone["x"], "left_anti").select("r", "line")


def _rebuilt(place: int):
    """`place` is where the text stands in the row."""
    blank = bytes([0x20, *range(0x09, 0x0E)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (pa.RecordBatch.from_arrays([*b.columns, b.column(0).field(place)], names=["row", "keep", "text"]) for b in batches)
        for batch in slices(texts, "text", BLOCK):
            out = []
            for text, keep in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                lines, keep = (text or "").split("\n"), set(keep or ())
                left = [line for n, line in enumerate(lines) if n in keep or not line.encode().strip(blank)]
                kept = "\n".join(left)
                out.append((None if text is None else kept, 0 if text is None else len(lines), len(lines) - len(left), hashlib.sha256(kept.encode()).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=["row", "kept_text", "n_lines", "n_removed", "kept_sha256"])

    return run


def dedupe_lines(docs: DataFrame, scratch, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: row (the input row as a struct), kept_text, n_lines, n_removed, kept_sha256.

    Lines are what line feeds separate. A line is removed if an earlier line, removed or not, has a Jaccard similarity of at
    least `percent` hundredths to it; order is by id (null first), then by a hash of the row, then by line number. Lines
    without words stay and match nothing. A null text stays null with no lines; an empty one has one line and stays. Rows
    equal in id and text hold the same lines at the same places, so both keep them. Very long lines are one set like any
    other. An empty table gives no rows; other columns are carried in `row` untouched.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("r")
    )
    texts = rows.where("text is not null").select("text", "r", "doc_id")
    keep = scratch.put(lines_to_keep(texts, scratch, percent).groupBy("r").agg(F.collect_set("line").alias("keep")))
    row_type = rows.schema["row"].dataType.simpleString()
    joined = rows.select("row", "r").join(keep, "r", "left").select("row", "keep")
    return joined.mapInArrow(releasing(_rebuilt(docs.columns.index(text))), f"row {row_type}, kept_text string, n_lines bigint, n_removed bigint, kept_sha256 string")
