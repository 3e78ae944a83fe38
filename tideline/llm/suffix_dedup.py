"""Operator 7: exact substring dedup over distributed suffix sorting.

A byte goes when a string of ``length`` bytes that covers it also starts
earlier in the corpus.  Sorting every suffix of the corpus would move each
byte a hundred times, so suffixes are first thinned without loss:

1. Every window of ``length`` bytes picks its anchor, the k-gram in it with the
   least hash.  Equal windows pick the same one, so only windows whose anchor
   k-gram occurs elsewhere can repeat.  Consecutive windows with one anchor
   form a segment.  Tasks collapse their own equal segments before the
   shuffle, so a k-gram of a third of the corpus sends a row per task.
2. Segments that equal an earlier one are repeats as a whole.  The first of
   each kind stays as its representative when its k-gram has several kinds.
3. Representatives are dealt by k-gram to shards of bounded size.  Each shard
   sorts its windows as suffixes, deep-shallow: a multikey sort on eight bytes
   at a time down to ``SHALLOW`` bytes, then blind tries order the groups that
   still agree, comparing only at branching bytes.  A suffix that shares
   ``length`` bytes with an earlier-starting one is a repeat.
4. A k-gram with very many kinds is split over shards; the first suffix of
   each shard's equal run meets those of the other shards by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import ids_are_unique, save, table, text_batches

LENGTH = 100
KGRAM = 32
SHALLOW = 64
SHARD_SEGMENTS = 24_000   # about 3 MB of text and half a million suffixes
SPLIT_KINDS = 4_000       # kinds of one k-gram in one shard
_COMBINE = 400_000        # segments a task holds to collapse equal ones
_CHUNK = 1 << 20          # windows of one text looked at together
_POS = 21                 # bits that hold a position inside a chunk
_NO_ID = -(1 << 63)       # stands for a null id: before all others


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    n = _CHUNK + LENGTH + 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Hasher:
    """Hashes of substrings from prefix sums, modulo 2^64."""

    def __init__(self, base: int):
        self.up, self.down = _powers(base)

    def sums(self, b: np.ndarray) -> np.ndarray:
        s = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], out=s[1:])
        return s

    def between(self, sums: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        h = (sums[stop] - sums[start]) * self.down[at]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


_hashers: list[Hasher] = []


def hashers() -> list[Hasher]:
    if not _hashers:
        _hashers.extend([Hasher(0x9E3779B97F4A7C15), Hasher(0xD6E8FEB86659FD93)])
    return _hashers


def segments(data: np.ndarray, length: int = LENGTH, kgram: int = KGRAM) -> list[np.ndarray]:
    """k-gram hash, segment hash, first and last window start of every segment of one text."""
    out: list[list[np.ndarray]] = []
    one, two = hashers()
    for begin in range(0, len(data) - length + 1, _CHUNK):
        part = data[begin:begin + _CHUNK + length - 1]
        sums, n = one.sums(part), len(part) - kgram + 1
        grams = one.between(sums, slice(0, n), slice(kgram, None), slice(0, n))
        low = np.uint64((1 << _POS) - 1)
        least = (grams & ~low) | np.arange(n, dtype=np.uint64)
        span, width = length - kgram + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: width - span], least[span - width:])
        anchor = (least & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.append(first[1:], len(anchor)) - 1
        stop = last + length
        kind = two.between(two.sums(part), first, stop, first) + (stop - first).astype(np.uint64)
        out.append([grams[anchor[first]].view(np.int64), kind.view(np.int64), first + begin, last + begin])
    if not out:
        return [np.zeros(0, dtype=np.int64)] * 4
    return [np.concatenate(c) for c in zip(*out, strict=True)]


_SEGMENT = "gram long, kind long, doc long, version long, a long, b long, leads boolean"


def _collapse(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The first of equal segments leads; the others are repeats, spread by a key of their own."""
    rows = pd.concat(parts, ignore_index=True)
    order = np.lexsort([rows[c].to_numpy() for c in ("a", "version", "doc", "kind", "gram")])
    rows = rows.iloc[order]
    rows = rows[~(rows.shift() == rows).all(axis=1)].reset_index(drop=True)  # a repeated row is the same document
    g, k = rows["gram"].to_numpy(), rows["kind"].to_numpy()
    leads = np.ones(len(rows), dtype=bool)
    leads[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    own = (rows["doc"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
           + rows["a"].to_numpy().view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    rows["gram"] = np.where(leads, g, own)
    return rows.assign(leads=leads)


def _segment_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts, held = [], 0
    for b in batches:
        for doc, version, text in zip(b["doc"], b["version"], b["text"], strict=True):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            gram, kind, first, last = segments(data)
            if len(gram):
                parts.append(pd.DataFrame({"gram": gram, "kind": kind, "doc": doc, "version": version, "a": first, "b": last}))
                held += len(gram)
            if held >= _COMBINE:
                yield _collapse(parts)
                parts, held = [], 0
    if parts:
        yield _collapse(parts)


def _words(data: np.ndarray) -> np.ndarray:
    """Big-endian eight-byte word at every position (zeros past the end)."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(data)]
    return out


def multikey_sort(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of suffixes by their first ``depth`` bytes, and the group number of each place.

    Every round sorts only inside the groups that still agree.
    """
    order = np.argsort(words[starts], kind="stable")
    key = words[starts[order]]
    cut = np.ones(len(order), dtype=bool)
    cut[1:] = key[1:] != key[:-1]
    for d in range(8, depth, 8):
        group = np.cumsum(cut)
        open_ = np.bincount(group)[group] > 1
        at = np.flatnonzero(open_)
        if not len(at):
            break
        word, own = words[starts[order[at]] + d], group[at]
        sub = np.lexsort((word, own))
        order[at], word = order[at][sub], word[sub]
        cut[at[1:]] |= (word[1:] != word[:-1]) | (own[1:] != own[:-1])
    return order, np.cumsum(cut)


def blind_tries(data: np.ndarray, starts: np.ndarray, order: np.ndarray, group: np.ndarray,
                shallow: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order the groups that agree on ``shallow`` bytes up to ``depth`` bytes.

    One blind trie per group, all grown a level at a time: a node looks for the
    first byte at which its suffixes branch, and deals them by that byte alone.
    """
    cut = np.ones(len(order), dtype=bool)
    cut[1:] = group[1:] != group[:-1]
    size = np.bincount(group)
    at = np.flatnonzero(size[group] > 1)
    while len(at):
        node = np.cumsum(cut)[at]
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        tails = data[starts[order[at]][:, None] + np.arange(shallow, depth)]
        number = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
        differs = np.logical_or.reduceat(tails != tails[head][number], head, axis=0)
        branches = differs.any(axis=1)
        live = np.flatnonzero(branches[number])
        if not len(live):
            break
        byte = tails[live, differs.argmax(axis=1)[number[live]]].astype(np.int64)
        sub = np.argsort(number[live] * 256 + byte, kind="stable")
        at, byte, own = at[live], byte[sub], number[live][sub]
        order[at] = order[at][sub]
        cut[at[1:]] |= (byte[1:] != byte[:-1]) | (own[1:] != own[:-1])
        node = np.cumsum(cut)[at]
        at = at[np.bincount(node)[node] > 1]
    return order, np.cumsum(cut)


def deep_shallow(data: np.ndarray, starts: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``starts`` by their first ``depth`` bytes, and groups that agree on all of them.

    Equal suffixes keep the order of ``starts``.
    """
    shallow = min(shallow, depth // 8 * 8)
    order, group = multikey_sort(_words(data), starts, shallow)
    return blind_tries(data, starts, order, group, shallow, depth)


_SORTED = "doc long, version long, a long, b long, digest binary"


def _sort_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats of one shard as runs of window starts; for split k-grams also its first suffixes."""
    rows = rows.sort_values(["doc", "version", "a"], ignore_index=True)
    data = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8)
    first, last = rows["a"].to_numpy(), rows["b"].to_numpy()
    n = last - first + 1
    base = np.concatenate([[0], np.cumsum([len(x) for x in rows["bytes"]])[:-1]]).astype(np.int64)
    seg = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    starts = base[seg] + offset
    order, group = deep_shallow(data, starts)
    leads = np.append(True, group[1:] != group[:-1])
    repeat = np.zeros(len(starts), dtype=bool)
    repeat[order[~leads]] = True
    hit = np.flatnonzero(repeat)
    own = seg[hit]
    # All windows of a segment hold its anchor, so what its repeats cover is one run.
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
    tail = np.append(head[1:], len(own)) - 1 if len(own) else head
    which = own[head]
    out = pd.DataFrame({"doc": rows["doc"].to_numpy()[which], "version": rows["version"].to_numpy()[which],
                        "a": first[which] + offset[hit[head]], "b": first[which] + offset[hit[tail]], "digest": None})
    split = np.flatnonzero(~repeat & (rows["parts"].to_numpy() > 1)[seg])
    if len(split):
        raw = data.tobytes()
        s = first[seg[split]] + offset[split]
        out = pd.concat([out, pd.DataFrame({
            "doc": rows["doc"].to_numpy()[seg[split]], "version": rows["version"].to_numpy()[seg[split]], "a": s, "b": s,
            "digest": [hashlib.blake2b(raw[i:i + LENGTH], digest_size=16).digest() for i in starts[split].tolist()]})])
    return out.astype({"doc": "int64", "version": "int64", "a": "int64", "b": "int64"})


def document_rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc, version, doc_id and text ('' for null), and whether ids are unique.

    Version tells rows apart that share an id: their texts' hash, or 0 when
    every id is there once.  Rows that share id and text are one document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    unique = ids_are_unique(rows)
    version = F.lit(0).cast("long") if unique else F.xxhash64("text")
    return rows.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), version.alias("version"), "doc_id", "text"), unique


def repeated_runs(rows: DataFrame, unique: bool) -> DataFrame:
    """doc, version, a, b: windows starting at a..b, all of whose bytes are repeats."""
    text_batches(rows.sparkSession)
    texts = rows.select("doc", "version", "text").where(F.octet_length("text") >= LENGTH)
    found = texts.mapInPandas(_segment_batches, _SEGMENT)
    by_gram = Window.partitionBy("gram")
    kinds = Window.partitionBy("gram", "kind").orderBy("doc", "version", "a")
    found = found.withColumn("met", F.count("*").over(by_gram)).where("met > 1 or not leads")
    # A row that lost inside its task has a key of its own, so only leads compete here.
    # Rows that share id, version and place are one document: none is earlier than the other.
    found = found.withColumn("place", F.rank().over(kinds))
    found = found.withColumn("fresh", (F.col("place") == 1) & F.col("leads"))
    found = found.withColumn("kinds", F.sum(F.col("fresh").cast("long")).over(by_gram))
    found = found.where("not fresh or kinds > 1")
    found = save(found.select("gram", "doc", "version", "a", "b", "fresh", "kinds"), "segments")

    reps = found.where("fresh").dropDuplicates(["doc", "version", "a"])
    shards = max(1, -(-found.where("fresh").count() // SHARD_SEGMENTS))
    wanted = reps.groupBy("doc", "version").agg(F.collect_list(F.struct("a", "b", "gram", "kinds")).alias("own"))
    cut = wanted.join(texts if unique else texts.dropDuplicates(["doc", "version"]), ["doc", "version"]).select("doc", "version", F.encode("text", "UTF-8").alias("raw"), F.explode("own").alias("x"))
    piece = cut.select("doc", "version", "x.a", "x.b", "x.gram", "x.kinds",
                       F.substring("raw", (F.col("x.a") + 1).cast("int"), (F.col("x.b") - F.col("x.a") + LENGTH).cast("int")).alias("bytes"))
    piece = piece.withColumn("parts", F.ceil(F.col("kinds") / SPLIT_KINDS).cast("int"))
    part = F.pmod(F.xxhash64("doc", "version", "a"), F.col("parts").cast("long"))
    piece = piece.withColumn("shard", F.pmod(F.xxhash64("gram", part), F.lit(shards)).cast("int"))
    piece = piece.select("shard", "doc", "version", "a", "b", "bytes", "parts")
    done = save(piece.groupBy("shard").applyInPandas(_sort_shard, _SORTED), "sorted")

    meet = Window.partitionBy("digest").orderBy("doc", "version", "a")
    across = done.where("digest is not null").withColumn("place", F.row_number().over(meet)).where("place > 1")
    runs = found.where("not fresh").select("doc", "version", "a", "b")
    return runs.union(done.where("digest is null").select("doc", "version", "a", "b")).union(
        across.select("doc", "version", "a", "b"))


def merge_runs(runs: list | np.ndarray | None, n: int) -> list[tuple[int, int]]:
    """Maximal byte spans [begin, end) covered by windows starting in the given runs."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted((int(r["a"]), int(r["b"])) for r in (runs if runs is not None else ())):
        end = min(b + LENGTH, n)
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((a, end))
    return spans


def cut_text(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for begin, end in spans:
        kept.append(data[at:begin])
        at = end
    kept.append(data[at:])
    return b"".join(kept)


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the characters that lie inside a span with all their bytes."""
    inner = []
    for begin, end in spans:
        while begin < end and data[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        inner.append((begin, end))
    return cut_text(data, inner).decode("utf-8", "surrogatepass")


def _with_runs(docs: DataFrame) -> DataFrame:
    """``docs`` as struct ``row`` with its text and the runs of its document (null for none)."""
    rows, unique = document_rows(docs)
    runs = repeated_runs(rows, unique)
    per = runs.groupBy("doc", "version").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc")
    version = (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("version")
    return docs.select(whole, key, version).join(per, ["doc", "version"], "left").select("row", "runs")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    "Earlier" is a smaller doc_id, or the same document and an earlier start; a
    null id comes before all others; rows that share an id but not the text are
    documents in the order of their texts' hashes; rows that share both are one
    document and get the same result.  Strings are judged on the input.  A null
    text is empty; texts under ``LENGTH`` bytes never lose a byte.
    """

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def digest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, runs in parts:
            out = []
            for text, own in zip(texts, runs, strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = merge_runs(own, len(data))
                kept = cut_text(data, spans)
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _with_runs(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    out = found.select(F.col("row.doc_id").cast("long").alias("doc_id"),
                       digest.asNondeterministic()(F.col("row.text"), F.col("runs")).alias("r"))
    return out.select("doc_id", "r.*")


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed strings in ``text``; a character goes when all its bytes do.

    Null texts stay null, other columns are unchanged.
    """

    @F.pandas_udf("string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, runs in parts:
            yield pd.Series([_kept_text(t, r) for t, r in zip(texts, runs, strict=True)], dtype=object)

    found = _with_runs(docs).withColumn("kept", cut.asNondeterministic()(F.col("row.text").cast("string"), F.col("runs")))
    return found.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _kept_text(text: str | None, runs: list | None) -> str | None:
    if text is None or runs is None:
        return text
    data = text.encode("utf-8", "surrogatepass")
    return whole_characters(data, merge_runs(runs, len(data)))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_documents(table(spark, sf_dir, "documents"))
