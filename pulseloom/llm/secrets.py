"""Secrets and who owns them.

Candidates of four kinds are found in whole texts: assignments to a telling name, access keys, long hexadecimal
runs, and (added by the method) other long tokens that mix letters and digits. The corpus then says what
each value is: the fingerprints of the values are counted by distinct owners and repositories. A value that ``example_owners`` owners or
``example_repositories`` repositories hold, or more, is a widely copied example; one that stays with its few owners looks live.
Added tokens count only where they look live; the three base kinds are always reported.

A table with one column for both (``source``) is read as ``owner/repository``: the owner is what stands before the first slash,
or all of it, and the repository is all of it. Columns of their own may be named instead.

A candidate carries a 64-bit fingerprint, never its value. Each (value, owner, repository) is counted once,
combined before the shuffle; the counts are written out, so that the join back can split a
value which a third of all documents hold.

Defined cases: null and empty texts have no candidate; a null owner or repository is one owner or repository; repeated rows
come out once each and count once; very long texts are scanned whole; spans that start together stand in the order of their kinds; bytes that are no
UTF-8 count as U+FFFD; an empty table gives no rows; other columns are kept (``redact``) or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small, text_of, unused

# The base patterns and their least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "opaque")
_STEMS = ("passw", "secret", "token", "api")
#: Whole tokens, from one end to the other; what they hold is judged afterwards.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
MIN_ENTROPY = 3.5
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
MASK = "<secret>"


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in map(s.count, set(s)))


def _meets(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    """Whether a span overlaps one of those that begin at ``starts`` (sorted) and of which the first i + 1 end by ``ends[i]``."""
    i = bisect_left(starts, end)
    return i > 0 and ends[i - 1] > start


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in code points, by start and kind; opaque tokens do not overlap the base kinds."""
    found = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    starts, ends = [c[0] for c in base], list(accumulate((c[2] for c in base), max))
    for m in OPAQUE.finditer(text):
        v = m[0]
        if any(c.isupper() for c in v) and any(c.islower() for c in v) and any(c.isdigit() for c in v) and _entropy(v) >= MIN_ENTROPY and not _meets(starts, ends, m.start(), m.end()):
            found.append((m.start(), 3, m.end(), v))
    return sorted(found)


def _print(value: str) -> int:
    return int.from_bytes(hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


_FOUND_SQL = "n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,print:bigint>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("print", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        counts, digests, all_found = [], [], []
        for t in b.column(b.schema.get_field_index("text")).to_pylist():
            c = candidates(t or "")
            base = [x for x in c if x[1] < 3]
            counts.append([sum(x[1] == k for x in base) for k in range(3)])
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
            all_found.append([{"start": s, "kind": k, "end": e, "print": _print(v)} for s, k, e, v in c])
        keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
        cols = [b.column(i) for i in keep] + [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        cols += [pa.array(digests, pa.string()), pa.array(all_found, _FOUND)]
        yield pa.RecordBatch.from_arrays(cols, names=[*[b.schema.names[i] for i in keep], "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", owner: str | None = None, repository: str | None = None, source: str = "source") -> DataFrame:
    """Candidates of every document, with a row number; written out once, so that texts are read once."""
    whole = F.col(source).cast("string") if owner is None or repository is None else None
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_of(text)).alias("text_hash"),
        (F.substring_index(whole, "/", 1) if owner is None else F.col(owner).cast("string")).alias("owner"),
        (whole if repository is None else F.col(repository).cast("string")).alias("repository"),
        text_of(text).alias("text"),
    )
    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(_scan, f"doc_id {kind}, text_hash long, owner string, repository string, {_FOUND_SQL}")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()))


def ownership(found: DataFrame) -> DataFrame:
    """(print, owners, repositories): in how many hands each value is."""
    held = found.select(F.explode("found").alias("f"), "owner", "repository").select(F.col("f.print").alias("print"), "owner", "repository").distinct()
    # null counts as a holder of its own
    named = {c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(c, F.lit(""))) for c in ("owner", "repository")}
    owners = held.select("print", named["owner"].alias("x")).distinct().groupBy("print").agg(F.count(F.lit(1)).alias("owners"))
    repositories = held.select("print", named["repository"].alias("x")).distinct().groupBy("print").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.join(repositories, "print")


def _judged(found: DataFrame, example_owners: int, example_repositories: int) -> DataFrame:
    """A row for each candidate of each document: in how many hands its value is, and whether it looks live."""
    counts = materialize(ownership(found))
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    return each.join(counts, "print").withColumn("live", (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories))


def secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, **columns: str) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans, live-looking spans, examples, and the most owners and repositories that hold one of its values."""
    found = scan(docs, **columns)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    name = F.concat_ws(":", kind, F.col("start").cast("string"), F.col("end").cast("string"))
    shown = _judged(found, example_owners, example_repositories).filter("kind < 3 or live")
    by_doc = shown.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", name.alias("name")))).alias("all"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    some = found.filter(F.size("found") > 0).drop("found").join(by_doc, "row", "left")
    none = found.filter(F.size("found") == 0).drop("found")
    zero = F.lit(0).cast("long")
    base = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    counted = ("n_live", "n_example", "most_owners", "most_repositories")
    some = some.select(*base, F.coalesce(F.array_join("all.name", ","), F.lit("")).alias("spans"), *[F.coalesce(c, zero).alias(c) for c in counted])
    return some.unionByName(none.select(*base, F.lit("").alias("spans"), *[zero.alias(c) for c in counted]))


def _mask(batches: Iterator[pa.RecordBatch], at: int, sized: int, out: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows and, last, their cuts: the cuts go, and with them what they cover."""
    for b in slices(batches, out[at]):
        texts, sizes = b.column(at).to_pylist(), b.column(sized).to_pylist() if sized >= 0 else []
        for i, cuts in enumerate(b.column(b.num_columns - 1).to_pylist()):
            if cuts:
                t, end, parts = texts[i], 0, []
                for c in sorted(cuts, key=lambda c: (c["start"], c["end"])):
                    if c["start"] >= end:
                        parts += [t[end : c["start"]], MASK]
                    end = max(end, c["end"])
                texts[i] = "".join([*parts, t[end:]])
                if sized >= 0:
                    sizes[i] = len(texts[i])
        cols = [b.column(i) for i in range(len(out))]
        cols[at] = pa.array(texts, pa.string())
        if sized >= 0:
            cols[sized] = pa.array(sizes, cols[sized].type)
        yield pa.RecordBatch.from_arrays(cols, names=out)


def redact(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, owner: str | None = None, repository: str | None = None) -> DataFrame:
    """The documents with every live-looking secret masked; ``n_chars``, however spelled, follows. Widely copied examples stay.

    Only the cuts meet the texts: they are broadcast if their counted rows are few, so that texts stay where they are.
    """
    found = scan(docs, owner=owner, repository=repository)
    live = _judged(found, example_owners, example_repositories).filter("live").join(found.select("row", "doc_id", "text_hash"), "row")
    key, hashed, cut = (unused(docs, x) for x in ("id", "hash", "cuts"))
    # repeated rows have the same cuts: those of one of them
    one = live.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("cuts"))
    cuts = small(materialize(one.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed), F.col("cuts").alias(cut))), 128)
    names = docs.columns
    at = next(i for i, c in enumerate(names) if c.lower() == "text")
    sized = next((i for i, c in enumerate(names) if c.lower() == "n_chars"), -1)
    here = docs.withColumn(names[at], text_of(names[at]))
    met = here.join(cuts, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(names[at])) == F.col(hashed)), "left").select(*[F.col(f"`{c}`") for c in names], cut)
    return met.mapInArrow(lambda batches: _mask(batches, at, sized, names), here.schema)
