"""Repeated-substring deduplication by window fingerprints with a difference cover.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else in
the corpus. Fingerprints of fixed windows stand in for sorted suffixes (no suffix is ordered: that would send 110 bytes for each
sample, twelve times the text); they are grouped one bucket at a time, and a difference cover keeps that small:

1. The texts are hashed to *parts* (one copy of each distinct text, with the count of
   copies seen, so that a text copied a million times is worked on once).
2. Of each part, only the suffixes at a difference cover modulo ``PERIOD`` are named by
   their first ``length - PERIOD + 1`` bytes. Equal strings of ``length`` bytes, wherever
   they start, have a cover sample at the same offset below ``PERIOD``, so their
   samples tie. The names go to suffix buckets; each bucket is sorted on its own, and the
   bits that come back to a part say which samples tie with another suffix.
3. Only suffixes with a tied sample ahead can be in a long tie; they alone are named, by
   their first ``length`` bytes, again bucket by bucket.
4. Names that tie are verified: their 64 bits and a second, independent name of 32 go to buckets once more, and only those tie
   that are equal in both. Of 10**13 suffixes no two different ones are expected to (10**26 / 2**97 pairs, or 0.0006).
5. Ties of that depth are the repeated strings; each part marks the bytes they cover.

A part sends each name once and gets a bit for it back, hence a bucket holds at most one
entry per name and part, whatever the number of copies. Names come from two independent prefix sums;
before they are verified, names have 12 bits more than their number needs, so that one in 4096 ties by chance; buckets are ranges of names. Nothing but the
sorted names, delta-coded, is shuffled. Parts and buckets are sized by bytes and numbered so that each is a partition of its own.

Every part sends to every bucket: rows grow with the square of the text, one per 96 * 10**12 of its bytes squared. Beyond some 100 GB of text
that is more rows than names are worth, and parts would have to be merged in a hop of their own before the buckets.

Defined cases: a null text is empty; texts shorter than ``length`` are kept whole; repeated
rows count as copies; texts are one text if the first 128 bits of their SHA-256 are equal; a very long text is a part of its own, hashed some bytes at a time; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

#: A perfect difference set modulo 91.
PERIOD = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)

#: Bits of a name when it is verified, and before that beyond the logarithm of the names (a false tie costs work, not correctness).
WHOLE_BITS, SPARE_BITS = 64, 12
#: Bytes of text for each part, and for each bucket (which then holds a name for each byte at most).
PART_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20
#: Bytes of text hashed at a time.
WORK = 1 << 19

_RNG = np.random.default_rng(20240229)
_TABLES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base, its powers and those of its inverse modulo 2**64."""
    out = []
    for b in _BASES:
        inverse = pow(b, -1, 1 << 64)
        both = []
        for x in (b, inverse):
            p = np.empty(n, np.uint64)
            p[0] = 1
            done = 1
            while done < n:
                step = np.uint64(pow(x, done, 1 << 64))
                k = min(done, n - done)
                p[done : done + k] = p[:k] * step
                done += k
            both.append(p)
        out.append((both[0], both[1]))
    return out


class Names:
    """Fingerprints of substrings of one buffer."""

    def __init__(self, data: np.ndarray, powers: list[tuple[np.ndarray, np.ndarray]]):
        self.powers = powers
        self.sums = []
        for table, (p, _) in zip(_TABLES, powers, strict=True):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * p[: len(data)], out=s[1:])
            self.sums.append(s)

    def _sums(self, starts: np.ndarray, length: int) -> list[np.ndarray]:
        m = int(starts[-1]) + 1 if len(starts) else 0
        if 4 * len(starts) < m:
            return [(s[starts + length] - s[starts]) * inv[starts] for s, (_, inv) in zip(self.sums, self.powers, strict=True)]
        # most offsets are asked for: go over all of them in a row
        return [((s[length : m + length] - s[:m]) * inv[:m])[starts] for s, (_, inv) in zip(self.sums, self.powers, strict=True)]

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Names of the strings that start at ascending offsets."""
        a, b = self._sums(starts, length)
        return self._mixed(a ^ (b >> np.uint64(31)) ^ (b << np.uint64(33)))

    def both(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The same and second names from the same sums, mixed another way: together they are as good as both sums."""
        a, b = self._sums(starts, length)
        return self._mixed(a ^ (b >> np.uint64(31)) ^ (b << np.uint64(33))), self._other(a, b)

    def _other(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._mixed(b + np.uint64(0x94D049BB133111EB) * (a ^ (a >> np.uint64(27)))) >> np.uint64(32)


def _pack(sorted_names: np.ndarray) -> bytes:
    """Delta-code ascending names: the deltas' byte planes, deflated where that helps."""
    deltas = np.diff(sorted_names, prepend=np.uint64(0)).astype("<u8")
    planes = deltas.view(np.uint8).reshape(-1, 8).T
    used = [k for k in range(8) if planes[k].any()]
    out = [len(sorted_names).to_bytes(8, "little"), bytes([len(used)])]
    for k in used:
        raw = planes[k].tobytes()
        small = zlib.compress(raw, 1) if k >= 2 and np.count_nonzero(planes[k][:4096]) * 2 < min(len(raw), 4096) else raw
        flag = len(small) < len(raw)
        body = small if flag else raw
        out += [bytes([k, flag]), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def _unpack(blob: bytes) -> np.ndarray:
    n, used = int.from_bytes(blob[:8], "little"), blob[8]
    planes, at = np.zeros((n, 8), np.uint8), 9
    for _ in range(used):
        k, flag, size = blob[at], blob[at + 1], int.from_bytes(blob[at + 2 : at + 10], "little")
        body = blob[at + 10 : at + 10 + size]
        planes[:, k] = np.frombuffer(zlib.decompress(body) if flag else body, np.uint8)
        at += 10 + size
    return np.cumsum(planes.reshape(-1).view("<u8"), dtype=np.uint64)


_PART_FIELDS = [("part", pa.int32()), ("keys", pa.binary()), ("copies", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())]
_PART_SQL = "part int, keys binary, copies binary, sizes binary, body binary"
_NAME_FIELDS = [("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())]
_NAME_SQL = "bucket int, part int, blob binary"


def _rows(rows: list[tuple], fields: list) -> pa.Table:
    schema = pa.schema(fields)
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _deal(part_ids: np.ndarray, block: int):
    """Texts of a task, once each, as compressed blocks of up to ``block`` bytes per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, n_parts = zstandard.ZstdCompressor(level=1), len(part_ids)
        held: dict[int, list] = {}
        again: dict[bytes, int] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for part, docs in held.items():
                keys = b"".join(k for k, _ in docs)
                copies = np.ones(len(docs), "<i8").tobytes()
                sizes = np.array([len(t) for _, t in docs], "<i8").tobytes()
                rows.append((int(part_ids[part]), keys, copies, sizes, press.compress(b"".join(t for _, t in docs))))
            held.clear()
            if rows:
                yield from _rows(rows, _PART_FIELDS).to_batches()

        for batch in batches:
            for raw in batch.column(0):
                text = raw.as_py()
                key = hashlib.sha256(text).digest()[:16]
                if key in again:
                    again[key] += 1
                    continue
                again[key] = 0
                held.setdefault(int.from_bytes(key[:6], "little") % n_parts, []).append((key, text))
                total += len(text)
                if total >= block:
                    yield from flush()
                    total = 0
        yield from flush()
        extra: dict[int, list] = {}
        for key, n in again.items():
            if n:
                extra.setdefault(int.from_bytes(key[:6], "little") % n_parts, []).append((key, n))
        rows = [(int(part_ids[part]), b"".join(k for k, _ in x), np.array([n for _, n in x], "<i8").tobytes(), np.full(len(x), -1, "<i8").tobytes(), b"") for part, x in extra.items()]
        if rows:
            yield from _rows(rows, _PART_FIELDS).to_batches()

    return run


class Part:
    """The distinct texts of a part in the order of their keys; the same whenever it is built."""

    def __init__(self, table: pa.Table):
        import zstandard

        count: dict[bytes, int] = {}
        text: dict[bytes, bytes] = {}
        for keys, copies, sizes, body in zip(*(table.column(c).to_pylist() for c in ("keys", "copies", "sizes", "body")), strict=True):
            data = zstandard.ZstdDecompressor().decompress(body) if body else b""
            at = 0
            for k, (n, size) in enumerate(zip(np.frombuffer(copies, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist(), strict=True)):
                key = keys[16 * k : 16 * k + 16]
                count[key] = count.get(key, 0) + n
                if size >= 0:
                    text.setdefault(key, data[at : at + size])
                    at += size
        self.keys = sorted(text)
        self.copies = [count[k] for k in self.keys]
        self.sizes = np.array([len(text[k]) for k in self.keys], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(b"".join(text[k] for k in self.keys), np.uint8)

    def chunks(self, length: int) -> Iterator[tuple[int, int, Names]]:
        """Runs of WORK offsets of the part, and names of what starts in them; a long document spans many."""
        total = len(self.data)
        powers = _powers(min(total, WORK + length) + 1)
        for lo in range(0, total, WORK):
            hi = min(lo + WORK, total)
            yield lo, hi, Names(self.data[lo : min(hi + length, total)], powers)

    def samples(self, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the cover samples in the part, and their names."""
        tied = length - PERIOD + 1
        cover = np.array(COVER)
        where, what = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, hi, names in self.chunks(length):
            rows = []
            first = int(np.searchsorted(self.starts, lo, side="right")) - 1
            for d in range(first, int(np.searchsorted(self.starts, hi))):
                s = int(self.starts[d])
                a, b = max(lo - s, 0), min(hi - s, int(self.sizes[d]) - tied + 1)
                if a < b:
                    p = (np.arange(a - a % PERIOD, b, PERIOD)[:, None] + cover).ravel()
                    rows.append(p[(p >= a) & (p < b)] + s)
            if rows:
                at = np.concatenate(rows)
                where.append(at)
                what.append(names.at(at - lo, tied) >> np.uint64(64 - bits))
        return np.concatenate(where), np.concatenate(what)

    def suffixes(self, runs: np.ndarray, length: int, both: bool = False) -> tuple[np.ndarray, ...]:
        """Offsets in the runs (start, end pairs) and the names (with ``both``, also the second ones) of the strings that start there."""
        where, what, more = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for lo, hi, names in self.chunks(length):
            i, j = int(np.searchsorted(runs[:, 1], lo, side="right")), int(np.searchsorted(runs[:, 0], hi))
            if i < j:
                at = _expanded(np.stack([np.maximum(runs[i:j, 0], lo), np.minimum(runs[i:j, 1], hi)], axis=1))
                where.append(at)
                if both:
                    first, second = names.both(at - lo, length)
                    more.append(second)
                else:
                    first = names.at(at - lo, length)
                what.append(first)
        return (np.concatenate(where), np.concatenate(what), *([np.concatenate(more)] if both else []))


def _expanded(runs: np.ndarray) -> np.ndarray:
    """All offsets in the runs."""
    n = runs[:, 1] - runs[:, 0]
    return np.repeat(runs[:, 0] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _edges(u: np.ndarray, bits: int, buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending names: a bucket is a range of names."""
    at = np.searchsorted(u >> np.uint64(bits - 32), [(b << 32) // len(buckets) for b in range(len(buckets) + 1)]).tolist()
    return [(int(b), i, j) for b, i, j in zip(buckets.tolist(), at[:-1], at[1:], strict=True) if i < j]


def _to_buckets(part: int, names: np.ndarray, bits: int, buckets: np.ndarray) -> list[tuple]:
    """Each distinct name once, in rows of one bucket."""
    u = np.unique(names)
    return [(b, part, _pack(u[i:j])) for b, i, j in _edges(u, bits, buckets)]


def _in_order(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pairs, where in that order a pair differs from the one before)."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # names that tie by chance: rare
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]


def _pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count, place of each) of the distinct pairs, ascending."""
    order, new = _in_order(first, second)
    at = np.flatnonzero(new)
    place = np.empty(len(first), np.int64)
    place[order] = np.cumsum(new) - 1
    return first[order[at]], second[order[at]], np.diff(np.append(at, len(first))), place


def _pairs_to_buckets(part: int, first: np.ndarray, second: np.ndarray, buckets: np.ndarray) -> list[tuple]:
    a, b, _, _ = _pairs(first, second)
    rows = []
    for k, i, j in _edges(a, WHOLE_BITS, buckets):
        packed = _pack(a[i:j])
        rows.append((k, part, len(packed).to_bytes(8, "little") + packed + b[i:j].astype("<u4").tobytes()))
    return rows


def _sorted_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sort a bucket's names; to each part, a bit for each of its names that another part has."""
    bucket = key[0].as_py()
    if bucket < 0:
        return table
    parts = table.column("part").to_pylist()
    names = [_unpack(x) for x in table.column("blob").to_pylist()]
    ordered = np.sort(np.concatenate(names))
    tied = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    return _rows([(bucket, p, np.packbits(_among(n, tied)).tobytes()) for p, n in zip(parts, names, strict=True)], _NAME_FIELDS)


def _verified_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The same for pairs of names: a bit for each pair that another part has."""
    bucket = key[0].as_py()
    if bucket < 0:
        return table
    first, second = [], []
    for blob in table.column("blob").to_pylist():
        n = int.from_bytes(blob[:8], "little")
        first.append(_unpack(blob[8 : 8 + n]))
        second.append(np.frombuffer(blob[8 + n :], "<u4"))
    ends = np.cumsum([len(x) for x in first])
    a, b = np.concatenate(first), np.concatenate(second)
    del first, second
    order, new = _in_order(a, b)
    del a, b
    tied = np.empty(len(order), bool)
    tied[order] = ~(new & np.append(new[1:], True))
    parts = table.column("part").to_pylist()
    return _rows([(bucket, p, np.packbits(x).tobytes()) for p, x in zip(parts, np.split(tied, ends[:-1]), strict=True)], _NAME_FIELDS)


def _among(names: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(names), bool)
    return ascending[np.minimum(np.searchsorted(ascending, names), len(ascending) - 1)] == names


def _elsewhere(u: np.ndarray, bits: int, buckets: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """For each distinct name of a part, whether another part has it, by the buckets' answers."""
    tied = np.zeros(len(u), bool)
    for b, i, j in _edges(u, bits, buckets):
        tied[i:j] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=j - i).astype(bool)
    return tied


def _ties(names: np.ndarray, bits: int, buckets: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """For each name whether it occurs elsewhere: in this part, or in another."""
    order = np.argsort(names)
    ordered = names[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(names)]
    at = np.flatnonzero(new)
    tied = (np.diff(np.append(at, len(names))) > 1) | _elsewhere(ordered[at], bits, buckets, answers)
    out = np.empty(len(names), bool)
    out[order] = tied[np.cumsum(new) - 1]
    return out


def _partition_ids(n: int) -> np.ndarray:
    """n numbers that Spark's hash partitioning (Murmur3 of an integer, seed 42) deals to n partitions, one each."""
    most = 16 * n + 64
    while True:
        x = np.arange(most, dtype=np.uint32)
        rotl = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
        h = np.uint32(42) ^ (rotl(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
        h = rotl(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        slots, first = np.unique(h.view(np.int32).astype(np.int64) % n, return_index=True)
        if len(slots) == n:
            return first.astype(np.int64)
        most *= 2


def _merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of intervals whose starts and ends both ascend, as (start, end) rows."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate([[True], starts[1:] > np.maximum.accumulate(ends)[:-1]])
    first = np.flatnonzero(new)
    return np.stack([starts[first], np.maximum.reduceat(ends, first)], axis=1)


def repeated_bytes(docs: DataFrame, length: int = 200, text: str = "text", id_col: str = "doc_id", part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs and the digest of what is left."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    # tasks are sized by bytes: what a part or a bucket holds does not depend on the cluster
    total = int(docs.agg(F.sum(F.length(raw).cast("long"))).first()[0] or 0)
    n_parts, n_buckets = max(1, -(-total // part_bytes)), max(1, -(-total // bucket_bytes))
    part_ids, buckets = _partition_ids(n_parts), _partition_ids(n_buckets)
    width = lambda names: min(WHOLE_BITS, max(33, names.bit_length() + SPARE_BITS))
    bits, long_bits = width(total * len(COVER) // PERIOD), width(total)
    cut_off = np.uint64(WHOLE_BITS - long_bits)
    dealt = docs.select(raw.alias("raw")).filter(F.length("raw") >= length).mapInArrow(_deal(part_ids, 16 << 20), _PART_SQL)
    parts = dealt.repartition(n_parts, "part")

    def named(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return _rows(_to_buckets(key[0].as_py(), Part(t).samples(length, bits)[1], bits, buckets), _NAME_FIELDS)

    def answered(answers: pa.Table) -> dict[int, bytes]:
        return dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))

    def note(part: int, runs: np.ndarray) -> tuple:
        """A row that passes the buckets by, back to its part."""
        return (-1 - part, part, zlib.compress(runs.astype("<i8").tobytes(), 1))

    def noted(part: int, got: dict[int, bytes]) -> np.ndarray:
        return np.frombuffer(zlib.decompress(got.pop(-1 - part)), "<i8").reshape(-1, 2)

    def candidates(key: tuple[pa.Scalar, ...], t: pa.Table, answers: pa.Table) -> pa.Table:
        part, p = key[0].as_py(), Part(t)
        where, names = p.samples(length, bits)
        at = np.sort(where[_ties(names, bits, buckets, answered(answers))])
        doc = np.searchsorted(p.starts, at, side="right") - 1
        first = np.maximum(at - PERIOD + 1, p.starts[doc])
        last = np.minimum(at, p.starts[doc + 1] - length)
        ok = first <= last
        runs = _merged(first[ok], last[ok] + 1)
        return _rows([*_to_buckets(part, p.suffixes(runs, length)[1] >> cut_off, long_bits, buckets), note(part, runs)], _NAME_FIELDS)

    def verify(key: tuple[pa.Scalar, ...], t: pa.Table, answers: pa.Table) -> pa.Table:
        part, p, got = key[0].as_py(), Part(t), answered(answers)
        where, first, second = p.suffixes(noted(part, got), length, both=True)
        tied = _ties(first >> cut_off, long_bits, buckets, got)
        at, first, second = where[tied], first[tied], second[tied]
        del where, tied
        return _rows([*_pairs_to_buckets(part, first, second, buckets), note(part, _merged(at, at + 1))], _NAME_FIELDS)

    def cut(key: tuple[pa.Scalar, ...], t: pa.Table, answers: pa.Table) -> pa.Table:
        p, got = Part(t), answered(answers)
        where, first, second = p.suffixes(noted(key[0].as_py(), got), length, both=True)
        u, _, n, place = _pairs(first, second)
        starts = np.sort(where[((n > 1) | _elsewhere(u, WHOLE_BITS, buckets, got))[place]])
        holes = _merged(starts, starts + length)
        # runs of neighbouring documents may touch: cut them at the documents' ends
        doc = np.searchsorted(p.starts, holes[:, 0], side="right") - 1
        rows = []
        i = 0
        for d, k in enumerate(p.keys):
            a, b = int(p.starts[d]), int(p.starts[d + 1])
            j = i
            mine = []
            while j < len(holes) and doc[j] == d:
                s, e = int(holes[j][0]), int(holes[j][1])
                mine.append((s, min(e, b)))
                if e > b:
                    holes[j][0], doc[j] = b, d + 1
                    break
                j += 1
            i = j
            if p.copies[d] > 1:
                mine = [(a, b)]
            digest, at = hashlib.sha256(), a
            for s, e in mine:
                digest.update(p.data[at:s])
                at = e
            digest.update(p.data[at:b])
            rows.append((k, sum(e - s for s, e in mine), len(mine), digest.hexdigest()))
        return _rows(rows, [("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def asked(rows: DataFrame, solve) -> DataFrame:
        """The buckets' answers, back by part."""
        return rows.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(solve, _NAME_SQL).groupBy("part")

    by_part = parts.groupBy("part")
    samples = asked(by_part.applyInArrow(named, _NAME_SQL), _sorted_bucket)
    suffixes = asked(by_part.cogroup(samples).applyInArrow(candidates, _NAME_SQL), _sorted_bucket)
    verified = asked(by_part.cogroup(suffixes).applyInArrow(verify, _NAME_SQL), _verified_bucket)
    result = by_part.cogroup(verified).applyInArrow(cut, "key binary, n_removed long, n_spans long, kept_sha256 string")

    size, zero = F.length("raw").cast("long"), F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"))
    # short texts stay as they are, and out of the join
    short = rows.filter(size < length).select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"))
    met = rows.filter(size >= length).select("doc_id", size.alias("n_bytes"), F.unhex(F.substring(F.sha2("raw", 256), 1, 32)).alias("key")).join(small(materialize(result), 400), "key")
    return met.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(short)
