"""Problem 9: sentence boundaries across languages and scripts.

Method: characters are tagged boundary (B) or inside (I) by a linear-chain model with Viterbi decoding.
Layout comes first: blank lines, headings, fenced code and list items cut a text into units, and
quote or comment prefixes are taken away. Within a unit only characters that close a run of
terminal marks (with its closing quotes and brackets), and in scripts without marks the last character
before a blank, can be B; all others have the single state I, also marks in a quotation that is part
of a sentence. The lattice is walked from one such character to the next. The last character of a unit is always B.

Nothing is labelled by hand, and there are no lists of words. What the model knows comes from the layout of the corpus:
where a unit ends a sentence ends, and where it begins one begins. Counted over all documents (``Stats``), that tells for the word
before a mark how often it ends units against how often the text goes on behind it, and for the word after it how
often it opens units. An abbreviation is seen behind marks but hardly ever at the end of a unit, and most words of
the middle of a sentence never open one.

The model is an averaged structured perceptron over these two statistics, the shapes around the mark, the quotation, and
the label of the previous candidate. It is trained on a bounded sample (``TRAIN_DOCS``) whose units are run together:
the joints are known boundaries. The labels of the other candidates are hidden; they start from the statistics and are
decoded anew with the model after every epoch but the last. For scripts without terminal marks the text is stripped of its
punctuation first, so that blanks have to carry the decision.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import cut

TRAIN_DOCS = 2_000  # documents in the training sample, at most
EPOCHS = 6
#: words that hold less than this share of all marks are known by their class only, so fewer than its inverse are kept
LEAST_SHARE = 1 / 200_000

# fixed values: marks that may end a sentence
_MARKS = ".!?…。！？｡．؟।॥۔"
# fixed values: quotation marks and brackets with their closers
_PAIRS = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "‘": "’", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "‹": "›", "‚": "‘"}
_BRACKETS = "(（[【"
_CLOSERS = set(_PAIRS.values()) | {'"'}

_LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|\Z)")
_PREFIX = re.compile(r"[^\S\r\n]*(?:(?:>|//+|--(?=\s|$))[^\S\r\n]?[^\S\r\n]*)+")
_FENCE = re.compile(r"\s*(```+|~~~+)")
_HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_ITEM = re.compile(r"\s*(?:([-*+•])|(\d{1,9})[.)])\s+(?=\S)")
_CLUSTER = re.compile(rf"[{re.escape(_MARKS)}]+")
_MARKUP = re.compile(r"(?:[*_`~']+|</?[A-Za-z][^<>]*>)+(?=\w)")
_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_/=%@-")
_THAI = "฀-๿຀-໿က-႟ក-៿"  # scripts that end sentences with a blank
_BLANK_END = re.compile(rf"(?<=[{_THAI}])\s+(?=[{_THAI}])")
_UNMARKED = re.compile(rf"[{_THAI}]")
_WORD_AFTER = re.compile(r"[^\s.!?,;:。！？，]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯豈-﫿ｦ-ﾟ]")


@dataclass
class Unit:
    """A paragraph, item, heading or code block; ``starts`` are (offset in ``text``, offset in the document)."""

    text: str
    starts: list[tuple[int, int]]
    whole: bool = False  # one sentence by layout
    opens: bool = True  # what it begins with is a sentence begin, not a code block or heading
    _at: list[int] = field(default_factory=list)

    def end(self, i: int) -> int:
        """Document offset after the character before ``i``."""
        if not self._at:
            self._at = [a for a, _ in self.starts]
        a, d = self.starts[bisect_right(self._at, i - 1) - 1]
        return d + i - a


def units(text: str) -> Iterator[Unit]:
    """Units of a text in order; white space at their ends is not part of them."""
    lines: list[tuple[str, int]] = []
    kind: tuple | None = None
    fence: tuple[str, int] | None = None
    last_full = 0

    def flush() -> Iterator[Unit]:
        nonlocal kind
        if lines:
            out, starts, n = [], [], 0
            for s, at in lines:
                starts.append((n, at))
                out.append(s)
                n += len(s) + 1
            joined = "\n".join(out).rstrip()
            if joined.strip():
                yield Unit(joined, starts)
            lines.clear()
        kind = None

    for m in _LINE.finditer(text):
        line, at = m.group(1), m.start()
        if fence:
            pre = _PREFIX.match(line)
            body = line[pre.end():] if pre else line
            if body.strip().startswith(fence[0]) and not body.strip().strip(fence[0][0]):
                yield Unit(text[fence[1]:at + len(line.rstrip())], [(0, fence[1])], True, False)
                fence = None
            if m.end() == len(text) and not m.group(2):
                break
            last_full = at + len(line.rstrip()) if line.strip() else last_full
            continue
        bare = line.lstrip()
        if bare[:1].isalpha():  # no prefix, fence, heading or item begins so
            lines.append((bare, at + len(line) - len(bare)))
            if m.end() == len(text) and not m.group(2):
                break
            continue
        pre = _PREFIX.match(line)
        skip = pre.end() if pre else 0
        body = line[skip:]
        if not body.strip():
            yield from flush()
        elif f := _FENCE.match(body):
            yield from flush()
            fence = (f.group(1), at + skip + f.start(1))
            last_full = at + len(line.rstrip())
        elif _HEADING.match(body):
            yield from flush()
            lead = len(body) - len(body.lstrip())
            yield Unit(body.strip(), [(0, at + skip + lead)], True, False)
        else:
            item = _ITEM.match(body)
            if item and (not lines or (kind and ((item.group(1) and kind == ("-", item.group(1))) or (item.group(2) and kind == ("n", int(item.group(2)) - 1))))):
                yield from flush()
                kind = ("-", item.group(1)) if item.group(1) else ("n", int(item.group(2)))
                lines.append((body[item.end():], at + skip + item.end()))
            else:
                lead = len(body) - len(body.lstrip())
                lines.append((body[lead:], at + skip + lead))
        if m.end() == len(text) and not m.group(2):
            break
    if fence:
        yield Unit(text[fence[1]:last_full], [(0, fence[1])], True, False)
    yield from flush()


_QUOTE = re.compile(r"[“”«»„「」『』‘’()（）\[\]【】《》〈〉‹›‚\"]")


def _pairs(s: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets; what does not match is ordinary text."""
    out, stack = [], []
    for m in _QUOTE.finditer(s):
        c, i = m.group(), m.start()
        if stack and ((want := _PAIRS.get(s[stack[-1]])) == c or (c == '"' and s[stack[-1]] == '"')):
            if c == "’" and i + 1 < len(s) and s[i + 1].isalpha() and s[i - 1].isalpha():
                continue
            out.append((stack.pop(), i))
        elif c == '"':
            deep = next((k for k in range(len(stack) - 1, -1, -1) if s[stack[k]] == '"'), None)
            if deep is not None and (i + 1 == len(s) or not s[i + 1].isalnum()):
                del stack[deep + 1:]
                out.append((stack.pop(), i))
            elif i + 1 < len(s) and not s[i + 1].isspace():
                stack.append(i)
        elif c in _PAIRS:
            stack.append(i)
        else:
            deep = next((k for k in range(len(stack) - 1, -1, -1) if _PAIRS.get(s[stack[k]]) == c), None)
            if deep is not None:
                del stack[deep + 1:]
                out.append((stack.pop(), i))
    return sorted(out)


@dataclass(slots=True)
class Candidate:
    end: int  # offset in the unit after its last character
    mark: str
    before: str  # shape of the word before the mark
    gap: str
    after: str  # shape of what follows
    quote: str
    left: str  # what the statistics of ends know it by
    right: str  # what the statistics of beginnings know the following by


_KINDS = {"。": "full", "｡": "full", "।": "danda", "॥": "danda", "۔": "full", "！": "wide", "？": "wide"}
_TRAILING = re.compile(r"[*_`~'’]+\Z|[*_`~'’]*<")
_EDGE = "\"'“„«‘(（[「『¿¡*_`~<"
_LONG = 100  # a longer word before a mark is known by its shape only


def _mark_class(run: str, cjk: bool) -> str:
    last = run[-1]
    if last == "…" or run.endswith("..."):
        return "cjk ellipsis" if len(run) > 1 and last == "…" or cjk else "ellipsis" if last == "…" else "dots"
    return "dot" if last in ".．" else _KINDS.get(last, "bang")


@lru_cache(100_000)
def _left(word: str) -> tuple[str, str]:
    """(shape, key) of the word before a full stop."""
    w = word.lstrip(_EDGE)
    if "'" in w or "’" in w:
        w = re.split(r"['’]", w)[-1]
    if not w:
        return "none", "<none>"
    if len(w) > _LONG:
        return "long", "<long>"
    if w.isdigit():
        return ("digits" if len(w) < 3 else "number"), f"<{min(len(w), 3)} digits>"
    if w[0].isdigit() and not any(c.isalpha() for c in w):
        return "number", "<number>"
    if any(c in "/@=:" for c in w):
        return "path", "<path>"
    if any(c.isdigit() for c in w):
        return "name", "<name>"
    if len(w) == 1:
        return ("initial" if w.isupper() else "letter"), w
    if w[-1].isalpha() and w[-1].lower() == w[-1].upper():
        return "caseless", w
    return ("dotted" if "." in w else "word"), w.lower()


@lru_cache(100_000)
def _opening(word: str) -> tuple[str, str]:
    """(shape, key) of a word behind a mark."""
    c = word[0]
    word = (_TRAILING.split(word, 1)[0] if word[-1] in "*_`~'’>" else word) or c
    named = any(x.isdigit() for x in word)
    if c.isupper() or c.istitle():
        return ("capital" if word[1].islower() else "upper") if len(word) > 1 else "single", "<Named>" if named else word
    return "caseless" if c.lower() == c.upper() else "lower", "<named>" if named else word


def _right(s: str, i: int, stats: Stats) -> tuple[str, str, str]:
    """(gap, shape, key) of what follows position ``i``."""
    j, n = i, len(s)
    while j < n and (s[j].isspace() or s[j] == "&" and s.startswith("&nbsp;", j)):
        j += 1 if s[j] != "&" else 6
    if j == n:
        return "end", "none", ""
    gap = "space" if j > i or not i else "glue"
    if gap == "space" and s[j] in "*_`~'<" and (m := _MARKUP.match(s, j)) and m.end() < n:
        j = m.end()  # marks of emphasis, code and tags say nothing about the word in them
    c = s[j]
    if c.isalpha():
        if _CJK.match(c):
            return gap, "cjk", s[j:j + 2]
        kind, key = _opening(_WORD_AFTER.match(s, j).group())
        if kind == "single":
            kind = "capital" if gap == "space" else "upper"
        return gap, "starter" if kind == "lower" and stats.opens(key) else kind, key
    if c.isdigit():
        return gap, "digit", "<digit>"
    kind = "open" if c in "“«„「『‘\"(（[‹《" else "inverted" if c in "¿¡" else "comma" if c in ",;:，、；：،؛" else "dash" if c in "—–-" else "other"
    return gap, kind, f"<{kind}>"


def candidates(u: Unit, stats: Stats) -> list[Candidate]:
    """Characters of a unit that may be boundaries, with their contexts; the last one has the gap ``end``."""
    s = u.text
    pairs = _pairs(s) if _QUOTE.search(s) else []
    close_at = {b: (a, b) for a, b in pairs}
    begun: dict[int, str] = {}  # opener -> how it was opened
    alone: dict[int, bool] = {}  # opener -> the quotation is no part of another sentence
    for a, b in pairs:
        j = a - 1
        while j >= 0 and (s[j].isspace() or s[j] in "“«„「『‘\"(（[¿¡" and any(x == j for x, y in pairs if y >= b)):
            j -= 1
        begun[a] = "start" if j < 0 or s[j] in _MARKS or (s[j] in _CLOSERS and j > 0 and s[j - 1] in _MARKS) else "colon" if s[j] in ":：" else "middle"
        inner = s[a + 1:b].rstrip()
        gap, kind, _ = _right(s, b + 1, stats)
        closed = bool(inner) and inner[-1] in _MARKS
        alone[a] = begun[a] == "start" and closed and (gap == "end" or gap == "space" and kind in ("upper", "capital", "starter", "digit", "open", "inverted", "caseless", "cjk"))
    out: list[Candidate] = []
    n = len(s)
    for m in _CLUSTER.finditer(s):
        at, i, run = m.start(), m.end(), m.group()
        if i < n and s[i] in _INNER and run.isascii():
            continue  # inside a number, name or address: such a mark has the single state I
        closed: list[tuple[int, int]] = []
        while pairs and i < n or i < n and s[i] in "”」』）】》":
            k = i
            if s[k].isspace():
                while k < n and s[k].isspace():
                    k += 1
                if not (k < n and s[k] in "»›" and k in close_at):
                    break
            if k in close_at and close_at[k][0] < at:
                closed.append(close_at[k])
                i = k + 1
            elif s[k] in "”」』）】》" and k not in close_at:
                i = k + 1
            else:
                break
        if pairs and any(a < at and b >= i and not alone[a] for a, b in pairs):
            continue  # a sentence within a sentence ends nothing
        gap, kind, right = _right(s, i, stats)
        quote = "out"
        if closed:
            a = closed[-1][0]
            quote = "alone" if alone[a] else ("bracket " if s[a] in _BRACKETS else "") + begun[a]
        mark = _mark_class(run, gap == "glue" and at > 0 and bool(_CJK.match(s[at - 1])))
        if mark == "dot" and quote == "out":
            k = at
            while k > 0 and not s[k - 1].isspace() and at - k <= _LONG and not _CJK.match(s[k - 1]):
                k -= 1
            shape, left = _left(s[k:at])
        else:
            shape, left = "-", f"<{mark} {quote}>"
        out.append(Candidate(i, mark, shape, gap, kind, quote, left, right))
    if not s.isascii() and _UNMARKED.search(s):
        for m in _BLANK_END.finditer(s):
            if not any(a < m.start() < b for a, b in pairs):
                out.append(Candidate(m.start(), "blank", "-", "space", "unmarked", "out", "<blank>", "<unmarked>"))
        last = len(s)
        if _UNMARKED.match(s[-1]) and not (out and out[-1].end == last):
            out.append(Candidate(last, "blank", "-", "end", "none", "out", "<blank>", ""))
        out.sort(key=lambda c: c.end)
    return out


_LENGTHS = 10  # longer words are of one class
_SURE = 0.8  # share of boundaries of a class whose words are taken for ordinary whatever the single word shows
_PRIOR = 0.8  # share of boundaries among marks of which nothing is known
_SMOOTH = 3.0  # occurrences that a word's class counts for
_BOUNDS = (0.03, 0.1, 0.3, 0.6)  # of the classes that shares are put into
_MOST = 0.9  # of the words that tell the ratio, by occurrence at edges
_OPEN_SHAPES = {"ends": ("word", "caseless"), "begins": ("capital", "cjk", "caseless")}  # of words that tell it


@dataclass
class Stats:
    """What the layout of all documents tells about words at marks.

    ``ends[key, shape]`` is (units that end with the word and its mark, marks behind it within units), ``begins[key, shape]`` (units that begin with
    it, marks within units that it follows). For a word that only ever stands at boundaries the second is up to ``ratio``
    times the first (most words, by side), so ``ratio`` times the first tells how many of the second can be boundaries.
    """

    ends: dict = field(default_factory=dict)
    begins: dict = field(default_factory=dict)
    classes: dict = field(default_factory=dict)  # shares of classes of words, by side and class
    ratio: dict = field(default_factory=lambda: {"ends": 1.0, "begins": 1.0})
    known: dict = field(default_factory=dict)

    def share(self, side: str, key: str, shape: str) -> tuple[float, float]:
        """Estimated share of boundaries among the marks behind (``ends``) or before (``begins``) a word, and that of its class."""
        have = self.known.get((side, key, shape))
        if have is None:
            edge, inside, cls = getattr(self, side).get((key, shape), (0, 0, shape))
            prior = self.classes.get((side, cls), self.classes.get((side, shape), _PRIOR))
            have = self.known[side, key, shape] = (min(1.0, (self.ratio[side] * edge + _SMOOTH * prior) / (inside + _SMOOTH)), prior)
        return have

    def shares(self, c: Candidate) -> tuple[float, float, bool]:
        """Shares of the words on both sides, and whether both are of classes that nearly always stand at boundaries."""
        end, ends = self.share("ends", c.left, c.before)
        begin, begins = self.share("begins", c.right, "lower" if c.after == "starter" else c.after)
        return end, begin, ends >= _SURE and begins >= _SURE

    def opens(self, key: str) -> bool:
        """Whether a lower-case word opens units as often as it follows marks within them, or nearly so."""
        edge, inside, _ = self.begins.get((key, "lower"), (0, 0, ""))
        return edge > 1 and self.ratio["begins"] * edge > 0.3 * inside


def _word_class(side: str, key: str, shape: str, dotted: int, plain: int) -> str:
    """Class of a word: its shape, how often it stands at a mark among all its uses, and for ends its length."""
    if key.startswith("<") or side == "begins" and shape != "capital":
        return shape
    often = dotted / (dotted + plain) if dotted + plain else 0.0
    return f"{shape} {min(len(key), _LENGTHS) if side == 'ends' else ''} {'always' if often >= 0.9 else 'often' if often >= 0.5 else 'seldom'}"


_WORDS = re.compile(r"[^\s!?,;:。！？，।؟()\[\]“”„«»\"]+")


class _Counts:
    """Occurrences of words at edges of units, at marks within them, and anywhere."""

    def __init__(self) -> None:
        self.edge, self.inside, self.words = Counter(), Counter(), Counter()

    def add(self, texts: Iterable[str]) -> None:
        blank = Stats()
        edge, inside, tokens = [], [], []
        for t in texts:
            for u in units(t):
                if u.whole:
                    continue
                for c in candidates(u, blank):
                    if c.gap == "end":
                        edge.append(("ends", c.left, c.before))
                    else:
                        inside.append(("ends", c.left, c.before))
                        inside.append(("begins", c.right, c.after))
                _, kind, key = ("", "unmarked", "<unmarked>") if _UNMARKED.match(u.text) else _right(u.text, 0, blank)
                if key:
                    edge.append(("begins", key, kind))
                tokens += _WORDS.findall(u.text)
        self.edge.update(edge)
        self.inside.update(inside)
        self.words.update(tokens)

    def rows(self) -> Iterator[tuple]:
        """(side, key, shape, occurrences at edges, at marks within units, and without a mark)"""
        plain = Counter()
        for w, n in self.words.items():
            if not w.endswith(".") and len(w) <= _LONG:
                shape, key = _left(w)
                if not key.startswith("<"):
                    plain["ends", key, shape] += n
            if w[0].isupper() and w[1:2].islower() and (w := w.rstrip(".")).isalpha():
                plain["begins", w, "capital"] += n  # all uses; those at marks are taken off later
        for k in self.edge.keys() | self.inside.keys() | plain.keys():
            yield *k, self.edge[k], self.inside[k], plain[k]


def _stats(rows: Iterable[tuple]) -> Stats:
    """``Stats`` of rows (side, key, shape, edge, inside, class); rows with an empty key are sums of classes."""
    out = Stats()
    sums, loose = {}, {"ends": [], "begins": []}
    for side, key, shape, edge, inside, cls in rows:
        if key:
            getattr(out, side)[key, shape] = (edge, inside, cls)
            if edge >= 5 and shape in _OPEN_SHAPES[side]:
                loose[side].append((inside / edge, edge))
        else:
            sums[side, cls] = (edge, inside)
    for side, found in loose.items():
        found.sort()
        most, seen = _MOST * sum(n for _, n in found), 0
        for r, n in found:
            seen += n
            out.ratio[side] = max(r, 1.0)
            if seen >= most:
                break
    out.classes = {(side, cls): min(1.0, (out.ratio[side] * e + 0.5) / (i + 1.0)) for (side, cls), (e, i) in sums.items()}
    return out


def text_stats(texts: Iterable[str]) -> Stats:
    """``Stats`` of texts in memory."""
    counts = _Counts()
    counts.add(texts)
    rows, sums = [], defaultdict(lambda: [0, 0])
    for side, key, shape, edge, inside, plain in counts.rows():
        plain = max(plain - edge - inside, 0) if side == "begins" else plain
        cls = _word_class(side, key, shape, edge + inside, plain)
        if edge + inside:
            rows.append((side, key, shape, edge, inside, cls))
            for c in {cls, shape}:
                sums[side, c][0] += edge
                sums[side, c][1] += inside
    return _stats([*rows, *((side, "", "", e, i, c) for (side, c), (e, i) in sums.items())])


def table_stats(documents: DataFrame, text: str = "text") -> Stats:
    """``Stats`` of all rows of a table, by one aggregation; only words with ``LEAST_SHARE`` of all marks come to the driver."""
    names = ["side", "key", "shape", "edge", "inside", "plain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()

        def done() -> pa.RecordBatch:
            cols = list(zip(*counts.rows())) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(cols)], names=names)

        for batch in batches:
            counts.add(t for t in batch.column(0).to_pylist() if t)
            if len(counts.words) + len(counts.inside) > 200_000:
                yield done()
                counts = _Counts()
        yield done()

    parts = documents.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "side string, key string, shape string, edge bigint, inside bigint, plain bigint")
    at_marks = F.col("edge") + F.col("inside")
    often = at_marks / F.when(F.col("side") == "begins", F.greatest(at_marks, "plain")).otherwise(at_marks + F.col("plain"))
    sums = parts.groupBy("side", "key", "shape").agg(*[F.sum(c).alias(c) for c in names[3:]]).where("edge + inside > 0").withColumn(
        "cls", F.when(F.col("key").startswith("<") | ((F.col("side") == "begins") & (F.col("shape") != "capital")), F.col("shape")).otherwise(F.concat_ws(
            " ", "shape", F.when(F.col("side") == "ends", F.least(F.length("key"), F.lit(_LENGTHS)).cast("string")).otherwise(""),
            F.when(often >= 0.9, "always").when(often >= 0.5, "often").otherwise("seldom"))))
    sums = cut(sums)
    total = sums.agg(F.sum(F.col("edge") + F.col("inside"))).first()[0] or 0
    words = sums.where((F.col("edge") + F.col("inside")) >= F.lit(total * LEAST_SHARE)).select("side", "key", "shape", "edge", "inside", "cls")
    classes = sums.select("side", F.explode(F.array_distinct(F.array("cls", "shape"))).alias("cls"), "edge", "inside").groupBy("side", "cls").agg(
        F.sum("edge").alias("edge"), F.sum("inside").alias("inside")).select("side", F.lit("").alias("key"), F.lit("").alias("shape"), "edge", "inside", "cls")
    return _stats([tuple(r) for r in words.unionByName(classes).collect()])


def _joint(c: Candidate, stats: Stats) -> tuple:
    """All that the model sees of a candidate."""
    end, begin, sure = stats.shares(c)
    return c.mark, c.before, c.gap, c.after, c.quote, bisect_right(_BOUNDS, end), bisect_right(_BOUNDS, begin), sure


def _features(joint: tuple) -> tuple:
    mark, before, gap, after, quote, end, begin, sure = joint
    return (("e", end), ("b", begin), ("eb", end, begin), ("ea", end, after), ("bm", begin, mark), ("ebm", end, begin, mark), ("s", before, after), ("se", before, end, begin),
            ("g", mark, gap, after), ("q", quote, begin), ("qe", quote, mark, end), ("m", mark), ("o", sure, after), ("oe", sure, end, begin))


def _likely(c: Candidate, stats: Stats) -> bool:
    """Label by the statistics alone: the odds of both sides."""
    end, begin, sure = stats.shares(c)
    if sure:
        end, begin = max(end, _SURE), max(begin, _SURE)
    end, begin = min(max(end, 0.01), 0.995), min(max(begin, 0.1 if c.after not in _NO_BEGIN else 0.01), 0.95)
    return log(end / (1 - end)) + log(begin / (1 - begin)) > log(_PRIOR / (1 - _PRIOR))  # which both sides count


_NO_BEGIN = ("lower", "comma", "dash", "other")  # shapes that as such begin no sentence


@dataclass
class Model:
    """Weights of the features for B against I, of label pairs, and the statistics."""

    weights: dict
    pairs: dict
    stats: Stats
    fitted: bool = True
    known: dict = field(default_factory=dict)  # emission of every combination met so far, once the weights are fixed

    def emission(self, joint: tuple) -> float:
        w, known = self.weights, self.known if self.fitted else {}
        emit = known.get(joint)
        if emit is None:
            emit = known[joint] = sum(w.get(f, 0.0) for f in _features(joint))
        return emit

    def decode(self, joints: list[tuple], fixed: dict[int, bool] | None = None) -> list[bool]:
        """Viterbi over the candidates of a unit; ``fixed`` are labels that are known."""
        pairs = self.pairs
        no_no, no_yes, yes_no, yes_yes = (pairs.get(k, 0.0) for k in ((False, False), (False, True), (True, False), (True, True)))
        ways = []
        no = yes = 0.0
        for k, joint in enumerate(joints):
            emit = self.emission(joint)
            if not k:
                no, yes, back = 0.0, pairs.get((None, True), 0.0) + emit, (False, False)
            else:
                a, b, c, d = no + no_no, yes + yes_no, no + no_yes, yes + yes_yes
                no, yes, back = max(a, b), max(c, d) + emit, (b > a, d > c)
            if fixed and k in fixed:
                no, yes = (-1e18, yes) if fixed[k] else (no, -1e18)
            ways.append(back)
        y, labels = yes > no, []
        for back in reversed(ways):
            labels.append(y)
            y = back[y]
        return labels[::-1]


def _joined(text: str) -> Iterator[tuple[Unit, set[int]]]:
    """Units of a text run together, with the offsets of the joints."""
    parts, joints, size = [], set(), 0
    for u in [u for u in units(text) if not u.whole]:
        if parts:
            sep = "" if _CJK.match(u.text[0]) and parts[-1][-1] in _KINDS else " "
            parts.append(sep)
            joints.add(size)
            size += len(sep)
        parts.append(u.text)
        size += len(u.text)
    if parts:
        yield Unit("".join(parts), [(0, 0)]), joints


def train(texts: list[str], epochs: int = EPOCHS, stats: Stats | None = None) -> Model:
    """Averaged structured perceptron (Collins 2002) with hidden labels; ``stats`` are the texts' own if not given."""
    stats = text_stats(texts) if stats is None else stats
    seqs = []
    for t in texts:
        for u, joints in _joined(t):
            bare = Unit(_CLUSTER.sub("", u.text), [(0, 0)]) if _UNMARKED.search(u.text) else None
            for one, ends in ((u, joints), (bare, set())) if bare else ((u, joints),):
                cands = [c for c in candidates(one, stats) if c.gap != "end"]
                if cands:
                    fixed = {k: True for k, c in enumerate(cands) if c.end in ends}
                    seqs.append(([_joint(c, stats) for c in cands], fixed, [k in fixed or _likely(c, stats) for k, c in enumerate(cands)]))
    model = Model(defaultdict(float), defaultdict(float), stats, fitted=False)
    total_w, total_p, step = defaultdict(float), defaultdict(float), 1
    for epoch in range(epochs):
        for joints, _, gold in seqs:
            got = model.decode(joints)
            if got != gold:
                for j, g, h in zip(joints, gold, got):
                    if g != h:
                        d = 1.0 if g else -1.0
                        for f in _features(j):
                            model.weights[f] += d
                            total_w[f] += step * d
                for a, b in ((gold, 1.0), (got, -1.0)):
                    for x, y in zip([None, *a], a):
                        model.pairs[(x, y)] += b
                        total_p[(x, y)] += step * b
            step += 1
        if epoch < epochs - 1:
            mean = Model({f: v - total_w[f] / step for f, v in model.weights.items()}, {f: v - total_p[f] / step for f, v in model.pairs.items()}, stats)
            seqs = [(joints, fixed, mean.decode(joints, fixed)) for joints, fixed, _ in seqs]
    weights = {f: v - total_w[f] / step for f, v in model.weights.items()}
    pairs = {f: v - total_p[f] / step for f, v in model.pairs.items()}
    return Model(weights, pairs, stats)


def sentence_ends(text: str, model: Model) -> list[int]:
    """Offsets after the last character of every sentence."""
    out = []
    for u in units(text):
        if not u.whole:
            cands = [c for c in candidates(u, model.stats) if c.gap != "end"]
            if cands:
                out += [u.end(c.end) for c, b in zip(cands, model.decode([_joint(c, model.stats) for c in cands])) if b]
        out.append(u.end(len(u.text)))
    return out


def fit(documents: DataFrame, text: str = "text", key: str = "doc_id", docs: int = TRAIN_DOCS) -> Model:
    """Model trained on at most ``docs`` documents, those with the smallest hash of their key; the statistics are
    those of all documents.

    Only a share of the rows that is expected to hold a few times as many is ordered, so the sample costs
    one scan and a small sort at any size.
    """
    rows = documents.where(F.col(text).isNotNull() & (F.trim(text) != ""))
    share = min(1.0, 4.0 * docs / max(1, documents.count()))
    unit = F.xxhash64(key).cast("double") / 2.0**64 + 0.5
    return train([r[0] for r in rows.where(unit < share + 1e-9).orderBy(F.xxhash64(key), key).limit(docs).select(text).collect()], stats=table_stats(rows, text))


def split_sentences(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: ``(key, sentence_no, end_char, sentence)``.

    ``end_char`` counts the code points of the text up to the sentence's last character; ``sentence`` is the text from
    the end before, without surrounding white space. Null, empty and blank texts have no sentences. Repeated
    rows give repeated results; a text of any length is handled unit by unit.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was trained on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nos, ends, texts = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for no, e in enumerate(sentence_ends(t, shared.value) if t else (), 1):
                    keys.append(k)
                    nos.append(no)
                    ends.append(e)
                    texts.append(t[at:e].strip())
                    at = e
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(0).type), pa.array(nos, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())],
                names=[key, "sentence_no", "end_char", "sentence"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, sentence_no int, end_char int, sentence string")
