"""Benchmark decontamination with suffix arrays over the training text.

Documents are read in shards (a MB or more of whole texts). Each shard sorts the suffixes of its words into a suffix
array, and every suffix of the benchmark is put into its place there by binary search. A training suffix's longest verbatim
match is then with one of the two benchmark suffixes around it, so common prefixes in both directions give, for each
place of the text, the length and place of its longest match. Places that match a window's words or more are hits. A
shard needs no other shard, so there is no shuffle, and copies or hot sources cost nothing extra.

Words outside the benchmark's vocabulary, and ends of texts and items, end every match; suffixes that begin with such a word
match nothing and are in no array.

The benchmark is cut into blocks of about ``block_bytes``, whose own suffix arrays are made by executors and written to the
shared folder, where tasks read them; only their paths reach the driver. A benchmark of several blocks is taken in one
pass for each, and documents hit in several are merged by row, so a task holds one block.

Defined cases: null or empty texts have no words and hit nothing; a very long text is a shard by itself; items without words
are ignored; an item with fewer words than a window is one window; an item without item_id counts as one named ''; a
document that repeats is judged each time alike; an empty benchmark leaves all documents clean; extra columns pass
through ``decontaminate`` untouched.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, free_name, fresh_path, open_store, table, trimmed, with_text
from .words import ALNUM, chunks, hashes, lowered, spans, utf8

WINDOW = 10
#: Bound of what a task holds of the benchmark at once: bytes of its text, about two million words.
BLOCK_BYTES = 12 << 20
#: Bytes of a shard, and most for large benchmarks, as all of a block is searched in each.
SHARD_BYTES = 1 << 20
MOST_SHARD_BYTES = 4 << 20


class Line:
    """Word numbers in a row, with a 0 after each text, and for each place how many words are left before a 0."""

    def __init__(self, ids: np.ndarray, bits: int, per: int):
        self.ids, self.per = ids, per
        zero = np.flatnonzero(ids == 0)
        at = np.arange(len(ids))
        self.left = zero[np.searchsorted(zero, at)] - at if len(ids) else at
        # the next words up to a 0 as one number
        self.key, alive, wide = np.zeros(len(ids), np.int64), np.ones(len(ids), bool), np.append(ids, np.zeros(per, np.int64))
        for k in range(per):
            word = wide[k : k + len(ids)]
            alive &= word > 0
            self.key = (self.key << bits) | np.where(alive, word, 0)

    def suffixes(self, depth: int) -> np.ndarray:
        """Places of words in the order of the suffixes from there, as far as depth words at least, by doubling."""
        at = np.flatnonzero(self.ids)
        order = np.argsort(self.key[at], kind="stable")
        at = at[order]
        rank = np.zeros(len(self.ids) + 1, np.int64)
        key = self.key[at]
        new = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, np.arange(1, len(at) + 1), 0))
        done, tied = self.per, np.arange(len(at))
        while done < depth and len(tied):
            # ranks are places in the array, so equal ones stand together
            own = rank[at[tied]]
            same = np.append(own[1:] == own[:-1], False)
            tied = tied[same | np.append(False, same[:-1])]
            if not len(tied):
                break
            sub = at[tied]
            second = np.where(self.left[sub] > done, rank[np.minimum(sub + done, len(self.ids))], 0)
            pair = rank[sub] * (len(self.ids) + 1) + second
            order = np.argsort(pair, kind="stable")
            sub, pair = sub[order], pair[order]
            at[tied] = sub
            new = np.append(True, pair[1:] != pair[:-1])
            rank[sub] = np.maximum.accumulate(np.where(new, tied + 1, 0))
            done *= 2
        return at


def bisected(keys, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """First place in [low, high) whose key is not less than (right: greater than) the wanted one; ``keys`` gives places' keys, sorted within each range."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        key = keys(open_, middle)
        up = key <= wanted[open_] if right else key < wanted[open_]
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_prefix(a: Line, at: np.ndarray, b: Line, of: np.ndarray) -> np.ndarray:
    """How many words the suffix of a at each place shares with that of b."""
    out, alive = np.zeros(len(at), np.int64), np.flatnonzero((at >= 0) & (of >= 0))
    step = 0
    while len(alive):
        x, y = at[alive] + step, of[alive] + step
        word = a.ids[x]
        alive = alive[(word == b.ids[y]) & (word > 0)]
        step += 1
        out[alive] = step
    return out


class TestIndex:
    """Items of a benchmark as a line of words, the suffix array of it, and which items have each window."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        texts = [t for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, first = spans(data, offsets, ALNUM)
        low = lowered(data).tobytes()
        coded = pa.array([low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()).dictionary_encode()
        self.words, self.window = coded.dictionary, window
        number = coded.indices.to_numpy().astype(np.int64) + 1
        own = np.zeros(len(self.words), np.uint64)
        own[number - 1] = hashes(data, starts, ends)
        order = np.argsort(own)
        self.hash, self.hash_id = own[order], order + 1
        self.bits = max(1, int(len(self.words)).bit_length())
        self.per = max(1, min(8, 63 // self.bits))
        self.line = Line(_line(number, first), self.bits, self.per)
        count = np.diff(first)
        self.names = [n for n, _ in items]
        item_of = np.repeat(np.arange(len(items)), count + 1)
        self.item, self.begin = item_of, (first[:-1] + np.arange(len(items)))[item_of] if len(items) else item_of
        self.longest = int(count.max(initial=0))
        self.order = self.line.suffixes(self.longest + 1)
        # windows: a number for each different one, and the items that have it
        left = self.line.left[self.order]
        follows = common_prefix(self.line, self.order[:-1], self.line, self.order[1:]) >= window
        group = np.cumsum(np.append(True, ~follows)[: len(self.order)]) - 1
        full = left >= window
        self.group = np.full(len(self.line.ids), -1, np.int64)
        self.group[self.order[full]] = group[full]
        pairs = np.unique(np.stack([group[full], item_of[self.order[full]]]), axis=1)
        self.group_begin = np.searchsorted(pairs[0], np.arange(int(group.max(initial=-1)) + 2))
        self.group_item = pairs[1]
        #: first places of the items with fewer words than a window, which are windows as they are
        self.short = (first[:-1] + np.arange(len(items)))[(count > 0) & (count < window)]

    def items_of(self, group: int) -> list[str]:
        return [self.names[i] for i in self.group_item[self.group_begin[group] : self.group_begin[group + 1]]]

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each training word by its 64-bit hash, 0 outside the vocabulary; ``scan_shard`` confirms what matches by the bytes."""
        if not len(self.hash) or not len(starts):
            return np.zeros(len(starts), np.int64)
        h = hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.hash_id[at], 0)

    @property
    def shard_bytes(self) -> int:
        return min(MOST_SHARD_BYTES, max(SHARD_BYTES, 6 * len(self.order)))


def _line(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of texts in a row with a 0 after each text."""
    line = np.zeros(len(ids) + len(first) - 1, np.int64)
    line[np.arange(len(ids)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = ids
    return line


def _inserted(index: TestIndex, shard: Line, array: np.ndarray) -> np.ndarray:
    """For every benchmark suffix, in order, how many training suffixes come before it."""
    test, q, per = index.line, index.order, index.per
    sorted_ = shard.key[array]
    low, high = (np.searchsorted(sorted_, test.key[q], side=x).astype(np.int64) for x in ("left", "right"))
    done = per
    live = np.flatnonzero((low < high) & (test.left[q] >= done))
    while len(live):
        keys = lambda i, at, done=done: shard.key[array[at] + done]
        wanted = test.key[q[live] + done]
        low[live], high[live] = bisected(keys, low[live], high[live], wanted, False), bisected(keys, low[live], high[live], wanted, True)
        done += per
        live = live[(low[live] < high[live]) & (test.left[q[live]] >= done)]
    return low


def _with_prefix(index: TestIndex, shard: Line, array: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the array whose suffixes begin with all words of the (short) items at these places."""
    test, per, bits = index.line, index.per, index.bits
    low, high, size = np.zeros(len(at), np.int64), np.full(len(at), len(array), np.int64), test.left[at]
    for done in range(0, int(size.max(initial=0)), per):
        live = np.flatnonzero((low < high) & (size > done))
        keys = lambda i, x, done=done: shard.key[array[x] + done]
        wanted = test.key[at[live] + done]
        # words beyond the item's may be any
        beyond = (np.int64(1) << bits * np.maximum(0, per - (size[live] - done))) - 1
        low[live], high[live] = bisected(keys, low[live], high[live], wanted, False), bisected(keys, low[live], high[live], wanted | beyond, True)
    return low, high


def scan_shard(index: TestIndex, data: np.ndarray, offsets: np.ndarray) -> list[dict]:
    """For each text: n_words, n_hit, the hit words' indices, items with occurring windows, matches of a window or more, and the longest match of any length."""
    starts, ends, first = spans(data, offsets, ALNUM)
    ids = index.lookup(data, starts, ends)
    while (out := _scan_ids(index, ids, first)) and (wrong := _misread(index, data, starts, ends, ids, first, out)):
        ids[wrong] = 0  # another word with the hash of a benchmark word
    return out


def _misread(index: TestIndex, data, starts, ends, ids, first, out) -> list[int]:
    seen = set()
    for t, x in enumerate(out):
        seen.update((first[t] + x["hit_words"]).tolist())
        if x["longest"]:
            seen.update(range(first[t] + x["longest"][1], first[t] + x["longest"][1] + x["longest"][3]))
    return [i for i in seen if lowered(data[starts[i] : ends[i]]).tobytes() != index.words[int(ids[i]) - 1].as_py()]


def _scan_ids(index: TestIndex, ids: np.ndarray, first: np.ndarray) -> list[dict]:
    window, texts = index.window, len(first) - 1
    begin = first[:-1] + np.arange(texts)  # of texts in the line
    none = np.zeros(0, np.int64)
    out = [{"n_words": int(w), "n_hit": 0, "hit_words": none, "items": set(), "matches": [], "longest": None} for w in np.diff(first)]
    shard = Line(_line(ids, first), index.bits, index.per)
    array = shard.suffixes(index.longest + 1)
    if not len(array) or not len(index.order):
        return out
    # the benchmark suffixes before and after each training suffix
    after = np.searchsorted(_inserted(index, shard, array), np.arange(len(array)), side="right")
    before = np.where(after > 0, index.order[after - 1], -1)
    behind = np.where(after < len(index.order), index.order[np.minimum(after, len(index.order) - 1)], -1)
    one, two = common_prefix(shard, array, index.line, before), common_prefix(shard, array, index.line, behind)
    size, of = np.zeros(len(shard.ids), np.int64), np.full(len(shard.ids), -1, np.int64)
    size[array], of[array] = np.maximum(one, two), np.where(one >= two, before, behind)
    owner = np.searchsorted(begin, np.arange(len(shard.ids)), side="right") - 1
    hit = np.zeros(len(shard.ids) + 1, np.int64)

    def match(at: int, place: int, words: int) -> tuple:
        return index.names[index.item[place]], int(at - begin[owner[at]]), int(place - index.begin[place]), words

    whole = np.flatnonzero(size >= window)
    np.add.at(hit, whole, 1)
    np.add.at(hit, whole + size[whole], -1)
    for t, group in set(zip(owner[whole].tolist(), index.group[of[whole]].tolist(), strict=True)):
        out[t]["items"].update(index.items_of(group))
    # a match that the place before it belongs to is no match of its own
    for at in whole[(whole == 0) | (size[whole - 1] != size[whole] + 1)].tolist():
        out[owner[at]]["matches"].append(match(at, int(of[at]), int(size[at])))
    low, high = _with_prefix(index, shard, array, index.short)
    for place, a, b in zip(index.short.tolist(), low.tolist(), high.tolist(), strict=True):
        n = int(index.line.left[place])
        for at in array[a:b].tolist():
            hit[at] += 1
            hit[at + n] -= 1
            out[owner[at]]["items"].add(index.names[index.item[place]])
            out[owner[at]]["matches"].append(match(at, place, n))
    covered = np.cumsum(hit[:-1]) > 0
    for t in set(owner[covered].tolist()):
        words = np.flatnonzero(covered[begin[t] : begin[t] + out[t]["n_words"]])
        out[t]["hit_words"], out[t]["n_hit"] = words, len(words)
    for t, (a, n) in enumerate(zip(begin.tolist(), np.diff(first).tolist(), strict=True)):
        if n and size[at := a + int(np.argmax(size[a : a + n]))]:
            out[t]["longest"] = match(at, int(of[at]), int(size[at]))
    return out


def index_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Paths of the indexes of a benchmark's blocks, made and written by executors; one of no items if it has no rows."""
    rows = bounded(benchmark.sparkSession) and benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    folder = fresh_path(benchmark.sparkSession, "benchmark")
    blocks = max(1, -(-int(rows.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0) // block_bytes))
    fs, top = open_store(folder)
    fs.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[str, bytes]] = []
        fs, top = open_store(folder)

        def write(block: int) -> pa.RecordBatch:
            draft = f"{top}/.{block}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(draft) as to:
                to.write(pickle.dumps(TestIndex(held, window), 5))
            fs.move(draft, f"{top}/{block}")
            held.clear()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{block}"]})

        now = None
        for batch in batches:
            for block, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if held and block != now:
                    yield write(now)
                now = block
                held.append((name, text))
        if held:
            yield write(now)

    placed = rows.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block"), "item_id", "text")
    dealt = placed.repartition(blocks, "block").sortWithinPartitions("block", "item_id", "text")
    paths = sorted(r["path"] for r in dealt.mapInArrow(trimmed(run), "path string").collect())
    if not paths:
        with fs.open_output_stream(f"{top}/none") as to:
            to.write(pickle.dumps(TestIndex([], window), 5))
    return paths or [f"{folder}/none"]


_indexes: dict[str, TestIndex] = {}


def _index(path: str) -> TestIndex:
    """A block's index; a worker keeps the last one."""
    if path not in _indexes:
        fs, name = open_store(path)
        with fs.open_input_stream(name) as source:
            _indexes.clear()
            _indexes[path] = pickle.loads(source.read())
    return _indexes[path]


_PLACE = [T.StructField("item_id", T.StringType()), T.StructField("word_start", T.LongType()), T.StructField("item_word_start", T.LongType()), T.StructField("length", T.LongType())]
MATCH = T.StructType(_PLACE)
HITS = T.StructType(
    [T.StructField("origin", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH)), T.StructField("longest", MATCH)]
)


def _scan(texts: pa.Array, index: TestIndex) -> Iterator[dict]:
    """Results of every text."""
    data, offsets = utf8(texts)
    for i, j in chunks(offsets, index.shard_bytes):
        yield from scan_shard(index, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _hits(docs: DataFrame, path: str, every: bool) -> DataFrame:
    """Hit words, items and matches of rows (origin, doc_id, text): of all, or of those that match anything."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, names = to_arrow_schema(HITS), [f.name for f in _PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _scan(batch.column(2), _index(path)), strict=True):
                if every or x["longest"]:
                    matches = [dict(zip(names, m, strict=True)) for m in sorted(x["matches"])]
                    rows.append({"origin": origin, "doc_id": doc, "n_words": x["n_words"], "hits": x["hit_words"].tolist(), "items": sorted(x["items"]), "matches": matches, "longest": x["longest"] and dict(zip(names, x["longest"], strict=True))})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select("origin", "doc_id", "text").mapInArrow(trimmed(run), HITS)


def match_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of every row: doc_id, n_words, n_hit, items (sorted), matches and longest.

    A match is (item, place, place in the item, words). ``matches`` are the longest ones from each place of a window's words
    or more, and short items; ``longest`` is the longest of any length, with one place of the benchmark that has it.
    """
    first, *others = index_blocks(benchmark, window, block_bytes)
    rows = with_text(docs).withColumn("origin", F.monotonically_increasing_id())
    if not others:
        merged = _hits(rows, first, True)
    else:
        rows = cut(rows)  # the passes must agree on the rows' numbers
        found = cut(_hits(rows, first, True))
        for path in others:
            found = found.unionByName(cut(_hits(rows, path, False)))
        whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        # a row for each block at most
        longest = F.max(F.when(F.col("longest").isNotNull(), F.struct("longest.length", "longest")))["longest"].alias("longest")
        merged = found.groupBy("origin").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), whole("hits"), whole("items"), whole("matches"), longest)
    return merged.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "items", "matches", "longest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a benchmark window, all columns as they are."""
    bounded(docs.sparkSession)
    text, kept = free_name(docs.columns, "scanned_text"), T.StructType(docs.schema.fields)

    def clean(df: DataFrame, path: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = pa.array([x["n_hit"] == 0 for x in _scan(batch.column(batch.num_columns - 1), _index(path))], pa.bool_())
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(ok)

        return df.withColumn(text, F.col("text").cast("string")).mapInArrow(trimmed(run), kept)

    first, *others = index_blocks(benchmark, window, block_bytes)
    out = clean(docs, first)
    for path in others:
        out = clean(cut(out), path)  # cut, so that no task holds two blocks
    return out


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).cast("long").alias("longest_match"),
        F.coalesce(F.col("longest.length"), F.lit(0)).cast("long").alias("longest_verbatim"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """n_words, n_hit, n_items, items_sha256 of one text, by comparing every window at every place (for tests)."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    words, hit, names = word.findall(low(text)), set(), set()
    for name, item in items:
        have = word.findall(low(item))
        size = min(window, len(have))
        for p in range(len(have) - size + 1) if have else ():
            for q in range(len(words) - size + 1):
                if words[q : q + size] == have[p : p + size]:
                    hit.update(range(q, q + size))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
