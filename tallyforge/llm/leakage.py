"""Problem 7: evaluation texts leaking into training text.

Method: every window of the smallest passage that counts as a leak gets a SimHash over its weighted
words. The fingerprints of the items' windows are indexed by ``RADIUS + 1`` blocks of bits: two
fingerprints within the radius agree in at least one block, so looking up all blocks finds every
window within the radius. Exact weighted-shingle similarity then verifies the candidates, and equality
word by word tells exact passages from near ones.

Fingerprints of short windows miss most near passages, so near ones are also searched by the shingles themselves:
a passage similar enough shares a known number of shingles with the window of the item, which an inverted
index of the items' shingles counts. This path misses none, in windows of a passage and of a whole item.

Documents are scanned once, in Arrow batches, without any shuffle; the items are a stated query set
that is broadcast in blocks of a bounded number of windows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12  # words of a passage, and of a window
CHARS = 24  # letters and digits of a passage in scripts without spaces
RADIUS = 3  # Hamming radius of the candidate search
SHINGLE = 5
SIMILARITY = 0.8
BLOCK_WINDOWS = 500_000  # windows of items that are broadcast at once (24 bytes each)
_STEP = 20_000  # windows that are fingerprinted at once

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
# fixed values: tags that end a line or a cell and so part words
_BLOCK_TAGS = frozenset("br p div li ul ol td th tr table h1 h2 h3 h4 h5 h6 hr pre blockquote".split())
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_RUN = re.compile(r"[^\W_]+")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
# fixed values: language codes whose passages are counted in characters
_CHAR_LANGS = ("zh", "ja", "cn", "jp")


def plain(text: str) -> str:
    """Text without markup and invisible characters, in compatibility form and folded case."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " if (m.group(1) or "br").lower() in _BLOCK_TAGS else "", text)
    if "&" in text:
        text = html.unescape(text)
    text = _INVISIBLE.sub("", text)
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def words(text: str) -> list[str]:
    return _RUN.findall(text)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64) over an array."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MAX_WEIGHT = 2


def word_weight(word: str) -> int:
    """Rare-looking words count double: long ones and those with digits."""
    return 2 if len(word) > 6 or any(c.isdigit() for c in word) else 1


def _window_sums(rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of every ``n`` consecutive rows, by doubling: sums of 1, 2, 4, ... rows are combined as the bits of ``n`` say."""
    count = len(rows) - n + 1
    out, at, width, part = None, 0, 1, rows
    while True:
        if n & width:
            piece = part[at:at + count]
            out = piece if out is None else out + piece
            at += width
        width *= 2
        if width > n:
            return out
        part = part[:-(width // 2)] + part[width // 2:]


def _fingerprints(vectors: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every window of ``n`` tokens; ``vectors`` holds the weighted bit signs per distinct token."""
    count = len(code) - n + 1
    out = np.empty(max(count, 0), np.uint64)
    vectors = vectors if n * MAX_WEIGHT < 128 else vectors.astype(np.int16 if n * MAX_WEIGHT < 2**15 else np.int64)
    for a in range(0, count, _STEP):
        sums = _window_sums(vectors[code[a:a + _STEP + n - 1]], n)
        out[a:a + len(sums)] = np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _ordered(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every window of ``n`` tokens."""
    count = max(len(h) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x100000001B3) + h[j:j + count]
    return _mix(out)


def _tokens(texts: list, by_char: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token code, token hash, bit signs per code, document bounds) of the texts laid end to end."""
    if by_char:
        flat = [np.frombuffer("".join(words(t)).encode("utf-32-le"), np.uint32) for t in texts]
        bounds = np.cumsum([0, *map(len, flat)])
        uniq, code = np.unique(np.concatenate(flat) if flat else np.zeros(0, np.uint32), return_inverse=True)
        hashes, weight = _mix(uniq), np.ones(len(uniq), np.int8)
    else:
        seen: dict[str, int] = {}
        lists = [[seen.setdefault(w, len(seen)) for w in words(t)] for t in texts]
        bounds = np.cumsum([0, *map(len, lists)])
        code = np.fromiter((c for row in lists for c in row), np.int64, bounds[-1])
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
        weight = np.fromiter((word_weight(w) for w in seen), np.int8, len(seen))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
    return code, hashes[code] if len(code) else np.zeros(0, np.uint64), (bits * 2 - 1) * weight[:, None], bounds


def _windows(texts: list, by_char: bool, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, ordered hash, text number, position) of every window that lies within one text."""
    code, h, vectors, bounds = _tokens(texts, by_char)
    if len(code) < n:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    inside = doc[: len(code) - n + 1] == doc[n - 1:]
    return _fingerprints(vectors, code, n)[inside], _ordered(h, n)[inside], doc[: len(inside)][inside], (np.arange(len(inside)) - bounds[doc[: len(inside)]])[inside]


def _grams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every shingle that lies within one text."""
    if len(h) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(doc[: len(h) - SHINGLE + 1] == doc[SHINGLE - 1:])
    return _ordered(h, SHINGLE)[at], at


def _shared(least: float) -> float:
    """Share of an item window's shingles that a window as similar as ``least`` has, too."""
    return 1 / (1 + MAX_WEIGHT * (1 / max(least, 1e-9) - 1))


def _spread(keys: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every key with each of ``start, start + 1, ...``, ``count`` of them."""
    count = np.maximum(count, 0)
    ends = np.cumsum(count)
    return np.repeat(keys, count), np.repeat(start - np.concatenate([[0], ends[:-1]])[: len(start)], count) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """Windows of one block of items, with a table of starts per block of fingerprint bits."""

    by_char: bool
    n: int
    radius: int
    prints: np.ndarray
    exact: np.ndarray
    item: np.ndarray  # item number per window
    at: np.ndarray
    ids: list
    texts: list
    cjk_only: bool
    tables: list
    grams: np.ndarray  # sorted hashes of the items' shingles
    gram_at: np.ndarray  # position of each, in the items laid end to end
    bounds: np.ndarray  # of the items in it
    free: float  # greatest share of shingles without CJK in any window

    @staticmethod
    def build(ids: list, texts: list, by_char: bool, n: int, radius: int) -> Index:
        prints, exact, item, at = _windows(texts, by_char, n)
        tables = []
        for k, (shift, bits) in enumerate(_blocks(radius)):
            key = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            tables.append((shift, bits, order, np.searchsorted(key[order], np.arange((1 << bits) + 1))))
        runs = ["".join(words(t)) for t in texts]
        cjk = by_char and all(_CJK.search(runs[i], p, p + n) for i, p in zip(item.tolist(), at.tolist()))
        _, h, _, bounds = _tokens(texts, by_char)
        grams, gram_at = _grams(h, bounds)
        order = np.argsort(grams, kind="stable")
        free = 0.0 if cjk else 1.0
        for run in runs if cjk else ():
            bare = np.cumsum([0, *(not _CJK.search(run, p, p + SHINGLE) for p in range(len(run) - SHINGLE + 1))])
            for m in {n - SHINGLE + 1, len(run) - SHINGLE + 1} if len(run) >= n else ():
                free = max(free, float((bare[m:] - bare[:-m]).max()) / m)
        return Index(by_char, n, radius, prints, exact, item, at, ids, texts, cjk, tables, grams[order], gram_at[order], bounds, free)

    def near(self, h: np.ndarray, bounds: np.ndarray, whole: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of windows that may be as similar as ``least``: (document, position, item, position, length).

        Windows are of ``n`` tokens, or with ``whole`` of all tokens of a longer item; a window of a document that
        is shorter ends with it. A weight is at most ``MAX_WEIGHT`` times another, so of ``m`` shingles of an item's window
        at least ``m * _shared(least)`` are shared.
        """
        none = (np.zeros(0, np.int64),) * 5
        grams, gram_at = _grams(h, bounds)
        first, last = np.searchsorted(self.grams, grams), np.searchsorted(self.grams, grams, "right")
        p, q = _spread(gram_at, first, last - first)
        q = self.gram_at[q] if len(q) else q
        doc, item = np.searchsorted(bounds, p, "right") - 1, np.searchsorted(self.bounds, q, "right") - 1
        size = np.diff(self.bounds)[item] if len(item) else item
        length = size if whole else np.full(len(item), self.n)
        ok = size >= self.n
        need = np.ceil((length - SHINGLE + 1) * _shared(least) - 1e-9)
        # a pair of texts with too few hits in all has no window with enough
        _, at, hits = np.unique(doc * len(self.ids) + item, return_inverse=True, return_counts=True)
        ok &= hits[at] >= need
        p, q, doc, item, length, need = (x[ok] for x in (p, q, doc, item, length, need))
        if not len(p):
            return none
        m = length - SHINGLE + 1
        a0, a1 = np.maximum(bounds[doc], p - m + 1), np.maximum(bounds[doc], np.minimum(p, bounds[doc + 1] - length))
        if whole:  # parts of windows at the end of a document count, too
            a1 = p
        i, a = _spread(np.arange(len(p)), a0, a1 - a0 + 1)
        b0 = np.maximum(self.bounds[item], q - m + 1)
        b1 = self.bounds[item] if whole else np.minimum(q, self.bounds[item + 1] - length)
        j, b = _spread(np.arange(len(i)), (self.bounds[item] if whole else b0)[i], (b1 - (self.bounds[item] if whole else b0) + 1)[i])
        i, a = i[j], a[j]
        pair, one, hits = np.unique(a * (int(self.bounds[-1]) + 1) + b, return_index=True, return_counts=True)
        one = one[hits >= need[i[one]]]
        i, a, b = i[one], a[one], b[one]
        return doc[i], a - bounds[doc[i]], item[i], b - self.bounds[item[i]], length[i]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (document window, item window) within the radius, without repeats."""
        left, right = [], []
        for shift, bits, order, starts in self.tables:
            key = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            n = starts[key + 1] - starts[key]
            hit = np.flatnonzero(n)
            for a in range(0, len(hit), 200_000):
                part = hit[a:a + 200_000]
                m = n[part]
                d = np.repeat(part, m)
                w = order[np.repeat(starts[key[part]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
                near = np.bitwise_count(prints[d] ^ self.prints[w]) <= self.radius
                left.append(d[near])
                right.append(w[near])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(left) * max(len(self.prints), 1) + np.concatenate(right))
        return pair // max(len(self.prints), 1), pair % max(len(self.prints), 1)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``radius + 1`` blocks that cover 64 bits; wide ones are cut to 16 bits, which only adds candidates."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, min(b - a, 16)) for a, b in zip(edges, edges[1:])]


def similarity(a: list, b: list, size: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the shingles of two windows; a shingle weighs as much as its words."""
    def bag(t: list) -> Counter:
        out: Counter = Counter()
        for i in range(max(len(t) - size + 1, 1)):
            out[tuple(t[i:i + size])] += sum(map(word_weight, t[i:i + size]))
        return out

    x, y = bag(a), bag(b)
    over = sum(max(x[k], y[k]) for k in x | y)
    return sum(min(x[k], y[k]) for k in x & y) / over if over else 0.0


def _scan(keys: list, texts: list, index: Index, min_similarity: float, near: bool = True) -> Iterator[tuple]:
    """(key, item id, exact windows, best similarity) of the documents of one batch."""
    clean = [plain(t) if t else "" for t in texts]
    skip = index.cjk_only and not (near and index.free >= _shared(min_similarity))
    rows = [i for i, t in enumerate(clean) if t and (not skip or _CJK.search(t))]
    clean = [clean[i] for i in rows]
    prints, exact, doc, at = _windows(clean, index.by_char, index.n)
    d, w = index.candidates(prints)
    same = exact[d] == index.exact[w]
    found: dict[tuple[int, int], list] = {}
    cut: dict[tuple[bool, int], list] = {}

    def tokens(of_item: bool, i: int) -> list:
        if (of_item, i) not in cut:
            ts = words(index.texts[i] if of_item else clean[i])
            cut[(of_item, i)] = list("".join(ts)) if index.by_char else ts
        return cut[(of_item, i)]

    for k in np.flatnonzero(same).tolist() + np.flatnonzero(~same).tolist():
        pair = (int(doc[d[k]]), int(index.item[w[k]]))
        have = found.get(pair)
        if not same[k] and have and have[1] == 1.0:
            continue
        x = tokens(False, pair[0])[at[d[k]]:at[d[k]] + index.n]
        y = tokens(True, pair[1])[index.at[w[k]]:index.at[w[k]] + index.n]
        score = 1.0 if x == y else similarity(x, y)
        if score >= min_similarity:
            have = found.setdefault(pair, [0, 0.0])
            have[0] += x == y
            have[1] = max(have[1], score)
    if near:
        _, h, _, bounds = _tokens(clean, index.by_char)
        for whole in (False, True):
            for i, a, j, b, size in zip(*(x.tolist() for x in index.near(h, bounds, whole, min_similarity))):
                have = found.get((i, j))
                if have and have[1] == 1.0:
                    continue
                score = similarity(tokens(False, i)[a:a + size], tokens(True, j)[b:b + size])
                if score >= min_similarity:
                    found[i, j] = [have[0] if have else 0, max(have[1] if have else 0.0, score)]
    for (i, j), (n, score) in sorted(found.items()):
        yield keys[rows[i]], index.ids[j], n, score


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", lang: str = "lang",
          n_words: int = WORDS, n_chars: int = CHARS, radius: int = RADIUS, min_similarity: float = SIMILARITY, block_windows: int = BLOCK_WINDOWS, near: bool = True) -> DataFrame:
    """Documents that hold passages of items: ``(key, item, windows, similarity)``, one row per pair.

    A passage is ``n_words`` consecutive words of the item or, for zh and ja items, ``n_chars`` consecutive letters
    and digits. ``windows`` counts the pairs of equal windows, ``similarity`` is the best weighted-shingle
    similarity (1 if a window is equal): pairs with no equal window are near passages, windows of a passage or of the
    whole item that reach ``min_similarity`` (``near=False`` leaves out those not within ``radius`` bits). Null or empty texts and items shorter than a passage match nothing; repeated
    rows give one row per pair.
    """
    item_type, key_type = dict(items.dtypes)[item], dict(documents.dtypes)[key]
    known = items.select(F.col(item).alias("i"), F.col(text).alias("t"), F.lower(F.trim(F.coalesce(lang, F.lit("")))).alias("l")).where("i is not null and t is not null")
    size = known.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_windows))  # a text has at most as many windows as characters
    schema = f"`{key}` {key_type}, `{item}` {item_type}, windows bigint, similarity double"
    parts = []
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        indexes = []
        for by_char in (False, True):
            mine = [r for r in rows if r["l"].startswith(_CHAR_LANGS) == by_char]
            one = Index.build([r["i"] for r in mine], [plain(r["t"]) for r in mine], by_char, n_chars if by_char else n_words, radius)
            if len(one.prints):
                indexes.append(one)
        shared = documents.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 1_000):
                    part = batch.slice(a, 1_000)
                    keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    rows = [r for index in shared.value for r in _scan(keys, texts, index, min_similarity, near)]
                    k, i, n, s = zip(*rows) if rows else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, part.schema.field(0).type), pa.array(i, _arrow_type(item_type)), pa.array(n, pa.int64()), pa.array(s, pa.float64())],
                        names=[key, item, "windows", "similarity"])

        parts.append(documents.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, item).agg(F.max("windows").alias("windows"), F.max("similarity").alias("similarity"))


_EVERY = 40  # words (letters of zh and ja items) of which one is edited


def _edited(tokens: list, kind: str, every: int) -> list:
    """Tokens with one in ``every`` replaced, dropped or swapped with the one after it."""
    out = list(tokens)
    for k in range(every // 2, len(tokens), every)[::-1]:
        if kind == "replace":
            out[k] = "qzx" if len(out[k]) > 1 else "々"
        elif kind == "drop":
            del out[k]
        elif k + 1 < len(out):
            out[k], out[k + 1] = out[k + 1], out[k]
    return out


def edit_recall(items: DataFrame, item: str = "item_id", text: str = "text", lang: str = "lang", every: int = _EVERY, min_similarity: float = SIMILARITY) -> DataFrame:
    """``(kind, planted, similar, found)``: edited copies of all items, how many are as similar to their item as ``min_similarity``
    by a comparison of the whole texts, and how many of those ``leaks`` finds, by kind of edit. Copies that still hold an equal
    passage count, too."""
    by_char = F.lower(F.trim(F.coalesce(lang, F.lit("")))).rlike("^(" + "|".join(_CHAR_LANGS) + ")")
    kinds = F.explode(F.array(*[F.lit(k) for k in ("replace", "drop", "swap")])).alias("kind")
    known = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t"), by_char.alias("c"), kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, close = [], []
            for t, c, kind in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                ts = words(plain(t))
                ts = list("".join(ts)) if c else ts
                other = _edited(ts, kind, every)
                made.append(("" if c else " ").join(other))
                close.append(len(ts) >= (CHARS if c else WORDS) and similarity(ts, other) >= min_similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(made, pa.string()), pa.array(close, pa.bool_())], names=["i", "kind", "text", "similar"])

    planted = known.mapInArrow(run, f"i {dict(items.dtypes)[item]}, kind string, text string, similar boolean").withColumn("doc", F.xxhash64("i", "kind"))
    hits = leaks(planted, items, "doc", item, "text", lang).select("doc", F.col(item).alias("i"), F.lit(True).alias("hit"))
    return planted.join(hits, ["doc", "i"], "left").groupBy("kind").agg(
        F.count(F.lit(1)).alias("planted"), F.count_if("similar").alias("similar"), F.count_if(F.col("similar") & F.coalesce("hit", F.lit(False))).alias("found"))


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
