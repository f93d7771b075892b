"""Removal of byte strings that documents repeat, by a distributed suffix sort whose comparisons are hash look-ups.

A suffix is compared by its first LENGTH bytes alone. Two of them share a window of LENGTH bytes only if they share its
anchor, the 25-byte gram with the least hash in the window, so suffixes are dealt by anchors and only anchors that stand
in two different texts are dealt at all. Blocks of documents sort their own suffixes and send one of each kind; tasks
that own an anchor merge what the blocks send. In both places suffixes are sorted by mergesort: prefix polynomial hashes
give the hash of any substring, a binary search over them the length of the common extension of two suffixes. The order
that comes out is verified on the bytes of neighbours, so a collision of hashes never decides.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.common import materialise, scratch_root

LENGTH, GRAM = 50, 25
#: Bytes of text that a block holds at most (a longer text is a block of its own), that a bucket of the block table and of the anchors stand for.
BLOCK, TABLE_BUCKET, ANCHOR_BUCKET = 1 << 23, 1 << 25, 1 << 24
MOST_TABLE_BUCKETS = 100_000
#: An anchor in this many blocks is hot: its suffixes are dealt one by one, by their own hashes.
HOT_BLOCKS = 4096
#: Window places of a text that are hashed together, bytes of suffixes that are sorted together.
CHUNK, SORTED = 1 << 18, 1 << 21
NO_ID = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """The first n powers of the base; a worker keeps the longest table so far."""
    if len(_POWERS[0]) < n:
        table = np.full(n, _BASE, np.uint64)
        table[0] = 1
        _POWERS[0] = np.cumprod(table)
    return _POWERS[0][:n]


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A mixed hash of every GRAM bytes, from those of half, a quarter and so on."""
    sizes, h = {1: _BYTES[text]}, None
    for k in (1, 2, 4, 8):
        h = sizes[k]
        sizes[2 * k] = h[:-k] * _power(k) + h[k:]
    n = len(text) - GRAM + 1
    return _mixed((sizes[16][:n] * _power(8) + sizes[8][16 : 16 + n]) * _BASE + sizes[1][24 : 24 + n])


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of the anchors of joined texts that end at `ends`, and the first and last window of each.

    Every window inside one text has one anchor: of its grams with the least hash the first.
    """
    out, wide = [], LENGTH - GRAM + 1
    low = np.uint64((1 << 20) - 1)
    owner = np.searchsorted(ends, np.arange(0, len(text), CHUNK), side="right") if len(text) else []
    for number, begin in enumerate(range(0, len(text) - LENGTH + 1, CHUNK)):
        part = text[begin : begin + CHUNK + LENGTH - 1]
        n = len(part) - LENGTH + 1
        hashes = gram_hashes(part)
        key = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
        for k in (1, 2, 4, 8):
            key = np.minimum(key[:-k], key[k:])
        least = (np.minimum(key[:n], key[wide - 16 : wide - 16 + n]) & low).astype(np.int64)
        inside = np.ones(n, bool)
        for end in ends[owner[number] :]:
            if end - LENGTH + 1 >= begin + n:
                break
            inside[max(end - LENGTH + 1 - begin, 0) : max(end - begin, 0)] = False
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        cut = np.flatnonzero((np.diff(least[at]) != 0) | (np.diff(at) != 1)) + 1
        first, last = np.append(0, cut), np.append(cut, len(at)) - 1
        place = least[at[first]]
        out.append((hashes[place], place + begin, at[first] + begin, at[last] + begin))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out))


class Suffixes:
    """Prefix polynomial hashes of a text, and comparisons of its substrings by them."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        self.power = powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        self.prefix[1:] = np.cumsum(_BYTES[text] * self.power[:n])

    def hash(self, at: np.ndarray, size: int) -> np.ndarray:
        """Equal for equal substrings, in whatever text they stand."""
        return (self.prefix[at + size] - self.prefix[at]) * self.power[len(self.text) - at] * _power(-len(self.text))

    def common(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many bytes two substrings of one size have in common at their begin, by binary search."""
        at_a, at_b = self.prefix[a], self.prefix[b]
        scale_a, scale_b = self.power[len(self.text) - a], self.power[len(self.text) - b]
        same = (self.prefix[a + size] - at_a) * scale_a == (self.prefix[b + size] - at_b) * scale_b
        rest = np.flatnonzero(~same)
        a, b, at_a, at_b, scale_a, scale_b = a[rest], b[rest], at_a[rest], at_b[rest], scale_a[rest], scale_b[rest]
        low, high = np.zeros(len(rest), np.int64), size[rest] - 1
        for _ in range(int(high.max()).bit_length() if len(rest) else 0):
            middle = (low + high + 1) >> 1
            same = (self.prefix[a + middle] - at_a) * scale_a == (self.prefix[b + middle] - at_b) * scale_b
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out = size.copy()
        out[rest] = low
        return out

    def sign(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the substring at a is before, equal to or after that at b."""
        k = self.common(a, b, size)
        at = np.minimum(k, size - 1)
        return np.where(k == size, 0, np.sign(self.text[a + at].astype(np.int16) - self.text[b + at]))

    def true_sign(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """sign() by the bytes themselves."""
        out = np.zeros(len(a), np.int64)
        for begin in range(0, len(a), 1 << 15):
            s = slice(begin, begin + (1 << 15))
            steps = np.arange(size[s].max())
            inside = steps < size[s][:, None]
            top = len(self.text) - 1
            d = (self.text[np.minimum(a[s][:, None] + steps, top)].astype(np.int16) - self.text[np.minimum(b[s][:, None] + steps, top)]) * inside
            out[s] = np.sign(d[np.arange(len(d)), (d != 0).argmax(1)])
        return out

    def classes(self, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A number for each substring, the same for equal substrings of one group. Substrings of a group have one size.

        Each group is sorted by mergesort, all groups side by side: an element's place in the merged run is its place in its own
        run and its rank in the other one.
        """
        order = np.argsort(group, kind="stable")
        held = group[order]
        begins = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(held)))
        begin, count = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        run = 1
        while len(sizes) and run < sizes.max():
            i = np.flatnonzero(count > run)
            place, base = i - begin[i], begin[i]
            mine = place // run
            other = np.minimum(base + (mine ^ 1) * run, base + count[i])
            low, high = other.copy(), np.minimum(other + run, base + count[i])
            late = (mine & 1).astype(bool)
            own = order[i]
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                x, y = order[middle], own[open_]
                sign = self.sign(at[x], at[y], size[y])
                up = (sign < 0) | (sign == 0) & late[open_]
                low[open_] = np.where(up, middle + 1, low[open_])
                high[open_] = np.where(up, high[open_], middle)
            order[base + (mine & ~1) * run + place % run + low - other] = own
            run *= 2
        x, y = order[:-1], order[1:]
        same_group = held[1:] == held[:-1]
        sign = np.full(len(x), -1)
        near = np.flatnonzero(same_group)
        sign[near] = self.true_sign(at[x[near]], at[y[near]], size[y[near]])
        if (sign > 0).any():  # a collision of hashes misled the sort: sort those groups by their bytes
            for g in np.unique(begin[1:][sign > 0]).tolist():
                k = int(count[g])
                order[g : g + k] = sorted(order[g : g + k].tolist(), key=lambda e: self.text[at[e] : at[e] + size[e]].tobytes())
            x, y = order[:-1], order[1:]
            sign[near] = self.true_sign(at[x[near]], at[y[near]], size[y[near]])
        out = np.empty(len(order), np.int64)
        out[order] = np.append(0, np.cumsum(sign != 0)) if len(order) else 0
        return out


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """A number for each row of several key arrays, the same for equal rows."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _least(classes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class the least value and a member that has it."""
    order = np.lexsort((values, classes))
    first = order[np.append(True, np.diff(classes[order]) != 0)] if len(order) else order
    return values[first], first


def _pieces(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The substrings one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return text[np.arange(total) + np.repeat(at - (ends - size), size)]


# ---- blocks of documents


def _bucketed(docs: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    """docs(doc_id, data) as a table of blocks (block, seq, doc_id, data, digest), bucketed so that later groupings by block move no text.

    A block holds texts of one size, up to a factor of two, from as many rows one after another as together stay below block_bytes;
    a longer text is alone.
    """
    spark = docs.sparkSession
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    size = F.greatest(F.lit(8), F.floor(F.log2(F.length("data") + F.lit(1.0)))).cast("int")
    placed = docs.withColumns({"seq": F.monotonically_increasing_id(), "size_of_row": size})
    run = F.floor(F.col("seq") / F.greatest(F.lit(1.0), F.lit(float(block_bytes)) / F.pow(F.lit(2.0), F.col("size_of_row") + 1)))
    made = placed.select(F.xxhash64("size_of_row", run, F.shiftright("seq", 33)).alias("block"), "seq", "doc_id", "data", F.unhex(F.sha2("data", 256)).alias("digest"))
    made.write.format("parquet").bucketBy(buckets, "block").option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


class Block:
    """The different texts of one block that no smaller document has whole, joined."""

    def __init__(self, rows: pa.Table, notes: pa.Table):
        rows = rows.sort_by("seq")
        self.block = rows.column("block")[0].as_py()
        self.ids = [NO_ID if i is None else i for i in rows.column("doc_id").to_pylist()]
        self.data, digests = rows.column("data").to_pylist(), rows.column("digest").to_pylist()
        noted = [(d, f, h) for d, f, h in zip(*(notes.column(c).to_pylist() for c in ("digest", "first", "packed")))]
        first: dict[bytes, int] = {}
        for i, d in zip(self.ids, digests):
            first[d] = min(i, first.get(d, NO_ID))
        before = {d: f for d, f, _ in noted if d is not None}
        #: by row: whether a smaller document has the same text; the row whose spans it shares
        self.copy = [len(x) >= LENGTH and (i > first[d] or before.get(d, NO_ID) < i) for i, x, d in zip(self.ids, self.data, digests)]
        self.row_of: dict[bytes, int] = {}
        for k, (d, x) in enumerate(zip(digests, self.data)):
            if not self.copy[k] and len(x) >= LENGTH:
                self.row_of.setdefault(d, k)
        self.same_as = [self.row_of.get(d, k) for k, d in enumerate(digests)]
        self.rows = np.array(sorted(self.row_of.values()), np.int64)
        self.text = np.frombuffer(b"".join([self.data[k] for k in self.rows]), np.uint8)
        self.ends = np.cumsum([len(self.data[k]) for k in self.rows]).astype(np.int64) if len(self.rows) else np.zeros(0, np.int64)
        self.packed = [h for _, _, h in noted if h is not None]

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _ask(buckets: int):
    """For each block the hashes of its anchors by bucket; the lowest bit tells that several of its texts have one."""

    def run(rows: pa.Table, notes: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "packed": pa.array([], pa.binary())})
        block = Block(rows, notes)
        hashes, place, _, _ = anchors(block.text, block.ends)
        hashes, owner = hashes & ~np.uint64(1), block.owner(place)
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        last = np.append(begins[1:], len(hashes))[: len(begins)] - 1
        several = owner[begins] != owner[last]
        return _dealt(block.block, hashes[begins] % np.uint64(buckets), hashes[begins] | several.astype(np.uint64))

    return run


def _dealt(block: int, bucket: np.ndarray, values: np.ndarray) -> pa.Table:
    order = np.argsort(bucket, kind="stable")
    bucket, values = bucket[order], values[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    stops = np.append(edges[1:], len(bucket))[: len(edges)]
    packed = [values[a:b].tobytes() for a, b in zip(edges, stops)]
    return pa.table({"bucket": pa.array(bucket[edges].astype(np.int64)), "block": pa.array([block] * len(edges), pa.int64()), "packed": pa.array(packed, pa.binary())})


def _answer(hot_blocks: int):
    """To each block the hashes that stand in two different texts; the lowest bit tells that an anchor is hot."""

    def run(asked: pa.Table) -> pa.Table:
        blocks, packed = asked.column("block").to_pylist(), asked.column("packed").to_pylist()
        marked = np.frombuffer(b"".join(packed), np.uint64)
        hashes = marked & ~np.uint64(1)
        _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
        several = np.zeros(len(times), bool)
        several[number[marked != hashes]] = True
        shared = ((times > 1) | several)[number]
        told = hashes | (times >= hot_blocks)[number].astype(np.uint64)
        ends = np.cumsum([len(p) // 8 for p in packed])
        out = [told[a:b][shared[a:b]].tobytes() for a, b in zip([0, *ends], ends)]
        kept = [i for i, x in enumerate(out) if x]
        return pa.table({"block": pa.array([blocks[i] for i in kept], pa.int64()), "packed": pa.array([out[i] for i in kept], pa.binary())})

    return run


SEGMENTS = "bucket long, block long, keys binary, shifts binary, windows binary, ids binary, bytes binary, of binary, seqs binary, places binary, later binary"


def _segments(buckets: int):
    """The block's suffixes at shared anchors: runs of windows with one anchor, each different run once, by bucket."""

    def run(rows: pa.Table, notes: pa.Table) -> pa.Table:
        names = SEGMENTS.replace(",", "").split()[::2]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 9]
        none = pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        block = Block(rows, notes) if rows.num_rows else None
        shared = np.sort(np.frombuffer(b"".join(block.packed), np.uint64)) if block else []
        if not len(shared):
            return none
        key, place, begin, last = anchors(block.text, block.ends)
        key = key & ~np.uint64(1)
        at = np.searchsorted(shared, key)
        found = shared[np.minimum(at, len(shared) - 1)]
        some = np.flatnonzero((found | np.uint64(1)) == (key | np.uint64(1)))
        if not len(some):
            return none
        hot = found[some] != key[some]
        key, place, begin, last = key[some], place[some], begin[some], last[some]
        text = Suffixes(block.text)
        # windows of hot anchors go alone
        many = np.where(hot, last - begin + 1, 1)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key, place, begin, last, hot = (np.repeat(x, many) for x in (key, place, begin, last, hot))
        begin, last = np.where(hot, begin + step, begin), np.where(hot, begin + step, last)
        bucket = np.where(hot, _mixed(text.hash(begin, LENGTH)), key) % np.uint64(buckets)
        shift, windows = place - begin, last - begin + 1
        kind = text.classes(begin, windows + LENGTH - 1, _numbered(key, shift, windows))
        owner = block.owner(begin)
        own_id = np.array(block.ids, np.int64)[block.rows[owner]]
        least, first = _least(kind, own_id)  # classes are 0, 1, ... in this order
        doc_begin = np.append(0, block.ends)[owner]
        out = []
        order = np.lexsort((kind, bucket))
        edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            member = order[a:b]
            kinds_here, of = np.unique(kind[member], return_inverse=True)
            one = first[kinds_here]
            out.append((
                int(bucket[member[0]]), block.block, key[one].tobytes(), shift[one].astype(np.uint8).tobytes(), windows[one].astype(np.uint8).tobytes(), least[kinds_here].tobytes(),
                _pieces(block.text, begin[one], windows[one] + LENGTH - 1).tobytes(), of.astype(np.uint32).tobytes(), block.rows[owner[member]].astype(np.uint32).tobytes(),
                (begin[member] - doc_begin[member]).astype(np.uint32).tobytes(), (own_id[member] > least[kind[member]]).tobytes(),
            ))
        return pa.table({n: pa.array(x, t) for n, x, t in zip(names, zip(*out), kinds)})

    return run


def _spans_of_runs(text: Suffixes, at: np.ndarray, key: np.ndarray, shift: np.ndarray, windows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of windows from several blocks, those windows that also stand in a run with a smaller id: (run, begin, end) of each
    connected part, in bytes from the run's begin."""
    size = windows + LENGTH - 1
    # whole runs first, then the windows of anchors that have different runs
    kind = text.classes(at, size, _numbered(key, shift, windows))
    least, one = _least(kind, ids)
    many = windows[one]
    run = np.repeat(np.arange(len(one)), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    smallest = least[run]
    _, number, runs = np.unique(key[one], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero((runs > 1)[number][run])
    own, step = run[open_], step[open_]
    window = text.classes(at[one][own] + step, np.full(len(own), LENGTH), _numbered(key[one][own], shift[one][own] - step))
    lowest = np.full(len(own), NO_ID)
    np.minimum.at(lowest, window, least[own])
    smallest[open_], run_begin = lowest[window], np.cumsum(many) - many
    held = np.repeat(np.arange(len(key)), windows)
    step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = np.flatnonzero(smallest[run_begin[kind][held] + step] < ids[held])
    cut = np.append(True, (np.diff(gone) != 1) | (np.diff(held[gone]) != 0)) if len(gone) else np.zeros(0, bool)
    first, last = gone[cut], gone[np.append(cut[1:], True)] if len(gone) else gone
    return held[first], step[first], step[last] + LENGTH


def _merged(sent: pa.Table) -> pa.Table:
    """What blocks have sent for one bucket, sorted together, some anchors at a time: to each block the places that a smaller document
    has too."""
    raw = {n: sent.column(n).to_pylist() for n in sent.column_names}
    joined = lambda n, t: np.frombuffer(b"".join(raw[n]), t)
    key, shift, windows, ids = joined("keys", np.uint64), joined("shifts", np.uint8).astype(np.int64), joined("windows", np.uint8).astype(np.int64), joined("ids", np.int64)
    data = joined("bytes", np.uint8)
    size = windows + LENGTH - 1
    at = np.cumsum(size) - size
    parts = len(data) // SORTED + 1
    part = _mixed(key) % np.uint64(parts)
    found = []
    for p in range(parts):
        some = np.flatnonzero(part == p)
        text = Suffixes(_pieces(data, at[some], size[some]))
        of, begin, end = _spans_of_runs(text, np.cumsum(size[some]) - size[some], key[some], shift[some], windows[some], ids[some])
        found.append((some[of], begin, end))
    span_of, span_from, span_to = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(span_of, kind="stable")
    span_of, span_from, span_to = span_of[order], span_from[order], span_to[order]
    span_begin = np.searchsorted(span_of, np.arange(len(key) + 1))
    # by member: all of its run if its own block has it earlier, else those windows
    base = np.cumsum([0, *[len(x) // 8 for x in raw["keys"]]])
    members = [len(x) // 4 for x in raw["of"]]
    of = joined("of", np.uint32).astype(np.int64) + np.repeat(base[:-1], members)
    seq, place, later = joined("seqs", np.uint32), joined("places", np.uint32).astype(np.int64), joined("later", np.bool_)
    spans = np.where(later, 1, span_begin[of + 1] - span_begin[of])
    who = np.repeat(np.arange(len(of)), spans)
    nth = np.minimum(span_begin[of[who]] + np.arange(len(who)) - np.repeat(np.cumsum(spans) - spans, spans), max(len(span_of) - 1, 0))
    some = len(span_of) > 0
    begin = place[who] + np.where(later[who], 0, span_from[nth] if some else 0)
    end = place[who] + np.where(later[who], size[of[who]], span_to[nth] if some else 0)
    packet = np.repeat(np.arange(len(members)), members)[who]
    packed = np.stack([seq[who].astype(np.uint32), begin.astype(np.uint32), end.astype(np.uint32)], 1)
    stops = np.searchsorted(packet, np.arange(len(members) + 1))
    kept = [i for i in range(len(members)) if stops[i + 1] > stops[i]]
    return pa.table({"block": pa.array([raw["block"][i] for i in kept], pa.int64()), "packed": pa.array([packed[stops[i] : stops[i + 1]].tobytes() for i in kept], pa.binary())})


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(rows: pa.Table, notes: pa.Table) -> pa.Table:
    """Each document of a block with its removed spans and what is left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    if not rows.num_rows:
        return schema.empty_table()
    block = Block(rows, notes)
    found = np.frombuffer(b"".join(block.packed), np.uint32).reshape(-1, 3).astype(np.int64)
    found = found[np.argsort(found[:, 0], kind="stable")]
    stops = np.searchsorted(found[:, 0], np.arange(len(block.data) + 1))
    spans, left = [], []
    for k, data in enumerate(block.data):
        own = found[stops[block.same_as[k]] : stops[block.same_as[k] + 1], 1:]
        if block.copy[k]:
            spans.append([(0, len(data))])
        elif not len(own):
            spans.append([])
        else:
            own = own[np.argsort(own[:, 0], kind="stable")]
            reach = np.maximum.accumulate(own[:, 1])
            new = np.append(True, own[1:, 0] > reach[:-1])
            spans.append(list(zip(own[new, 0].tolist(), reach[np.append(new[1:], True)].tolist())))
        edges = [0, *[x for s in spans[-1] for x in s], len(data)]
        left.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]) if spans[-1] else data)
    ids = rows.sort_by("seq").column("doc_id").combine_chunks()
    given = [[{"start": a, "end": b} for a, b in s] for s in spans]
    return pa.table([ids, pa.array([len(x) for x in block.data], pa.int64()), pa.array(given, schema.field("spans").type), pa.array(left, pa.binary())], schema=schema)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK, anchor_bytes: int = ANCHOR_BUCKET, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes of its UTF-8, spans (byte offsets that are removed, maximal) and kept, the rest.

    A byte goes if a string of LENGTH bytes that covers it also starts in a row with a smaller id. Null texts are empty. A null id
    is larger than every other, and null or equal ids are not smaller than each other, so rows that repeat an id keep what only
    they share. Texts below LENGTH bytes stay whole. Columns of docs but these two do not matter and are not returned. The result
    does not depend on the sizes: bytes of text of a block, bytes whose anchors meet in one task, blocks that make an anchor hot.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")).alias("data"))
    total = rows.agg(F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("n")).head().n
    table = _bucketed(rows, min(MOST_TABLE_BUCKETS, total // TABLE_BUCKET + 1), block_bytes)
    buckets = total // anchor_bytes + 1
    by_block = table.groupBy("block")
    # whole copies: a block asks once for each of its texts
    texts = table.where(F.length("data") >= LENGTH).groupBy("digest", "block").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("own"))
    first = texts.groupBy("digest").agg(F.min("own").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = texts.join(first.hint("merge"), "digest").where("first < own").select("block", "digest", "first")
    copies = materialise(copies.withColumn("packed", F.lit(None).cast("binary")), "suffix-copies")

    def noted(packed: DataFrame):
        told = packed.select("block", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("first"), "packed")
        return by_block.cogroup(copies.unionAll(told).groupBy("block"))

    asked = by_block.cogroup(copies.groupBy("block")).applyInArrow(_ask(buckets), "bucket long, block long, packed binary")
    shared = materialise(asked.groupBy("bucket").applyInArrow(_answer(hot_blocks), "block long, packed binary"), "suffix-anchors")
    sent = noted(shared).applyInArrow(_segments(buckets), SEGMENTS)
    gone = materialise(sent.groupBy("bucket").applyInArrow(_merged, "block long, packed binary"), "suffix-spans")
    return noted(gone).applyInArrow(_cut, RESULT)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
