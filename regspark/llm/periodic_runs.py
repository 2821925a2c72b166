"""Periodic run detection over grammar-compressed word ids.

A run is a stretch of words with smallest period q (words q apart are equal), at least
``min_length`` words and three periods long, that no neighbouring word extends.

1. Re-Pair: the most frequent pair of adjacent symbols of a text becomes a nonterminal, until
   no pair occurs twice.  A nonterminal is known by its first place in the text.
2. Every nonterminal's boundary (between its two halves) is looked at once, for the runs that
   cross it inside its expansion; the boundaries between the symbols that are left are those
   of the start symbol, inside the whole text.  A run that crosses a boundary repeats, at
   distance q, a stretch of max(4, q/2) words that starts or ends at the boundary; so the
   candidate periods q in [2w, 4w) are the places where the w words at the boundary occur
   again, found in a sorted list of windows for w = 4, 8, 16, ...  Each candidate is then
   extended word by word on both sides, which decides it exactly.
3. The runs of a nonterminal are moved to all its places in the derivation, and what belongs
   to one run is merged.  A run is whole at the lowest node that holds it, so none is missed.

Texts are independent of each other; a task works on groups of texts of about
``GROUP_WORDS`` words, and a longer text is a group of its own, with memory linear in it.

Defined cases: null and empty texts have no words and no runs; a text of any length is read
whole; among equal exponents the run with the smallest start, then period, is the greatest;
repeated rows are treated alike; an empty table gives an empty result.  Input columns named
like an output column are replaced by it, all others are kept.  A null id has no rotation
in the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.tables import documents, with_fields
from regspark.llm.words import _ship_by_value, binary_list, mix, window_hashes

MIN_LENGTH = 24
MIN_PERIODS = 3
SEED = 4
GROUP_WORDS = 100_000

RUN = "struct<start:long,length:long,period:long>"
FIELDS = f"n_runs long, top {RUN}, runs array<{RUN}>, collapsed string"
NAMES = ["n_runs", "top", "runs", "collapsed"]


class WordIds(dict):
    """word (bytes) -> a number of its own."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def repeated_pairs(x, doc, n_ids: int) -> dict:
    """{document: {(a, b): [places]}} of adjacent ids found twice or more in one document."""
    import numpy as np
    out: dict = {}
    if len(x) < 3:
        return out
    inside = np.flatnonzero(doc[:-1] == doc[1:])
    key = (doc[inside] * n_ids + x[inside]) * n_ids + x[inside + 1]
    order = np.argsort(key, kind="stable")
    key, inside = key[order], inside[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(key)].astype(np.int64)
    for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        places = inside[s:e]
        i = int(places[0])
        out.setdefault(int(doc[i]), {})[int(x[i]), int(x[i + 1])] = places.tolist()
    return out


class Grammar:
    """Re-Pair grammar of one text, whose words are ``ids``.

    ``rules[k]`` is the pair of nonterminal ``base + k``, ``first[k]`` its first place,
    ``length[k]`` its number of words; ``sym`` holds the symbol that starts at a place
    and -1 where none does.
    """

    def __init__(self, ids: list, pairs: dict, base: int):
        import heapq
        n = len(ids)
        sym, nxt, prv = ids, list(range(1, n + 1)), list(range(-1, n - 1))
        self.base, self.sym, self.rules, self.first, self.length = base, sym, [], [], []
        heap = [(-len(places), pair) for pair, places in pairs.items()]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            a, b = pair
            good, taken = [], -1
            for i in sorted(pairs.pop(pair)):
                if sym[i] == a and i > taken:
                    j = nxt[i]
                    if j < n and sym[j] == b:
                        good.append(i)
                        taken = j if a == b else i
            if len(good) < 2:
                continue
            if len(good) < -count and heap and len(good) < -heap[0][0]:
                pairs[pair] = good
                heapq.heappush(heap, (-len(good), pair))
                continue
            new = base + len(self.rules)
            self.rules.append(pair)
            self.first.append(good[0])
            self.length.append(self.words(a) + self.words(b))
            fresh: dict = {}
            for i in good:
                j = nxt[i]
                k, p = nxt[j], prv[i]
                sym[i], sym[j], nxt[i] = new, -1, k
                if k < n:
                    prv[k] = i
                    fresh.setdefault((new, sym[k]), []).append(i)
                if p >= 0:
                    fresh.setdefault((sym[p], new), []).append(p)
            for made, places in fresh.items():
                if len(places) > 1:
                    pairs[made] = places
                    heapq.heappush(heap, (-len(places), made))

    def words(self, symbol: int) -> int:
        return 1 if symbol < self.base else self.length[symbol - self.base]

    def places(self) -> list:
        """Every nonterminal's places in the derivation of the whole text."""
        at = [[] for _ in self.rules]
        for i, s in enumerate(self.sym):
            if s >= self.base:
                at[s - self.base].append(i)
        for k in range(len(self.rules) - 1, -1, -1):
            a, b = self.rules[k]
            if a >= self.base:
                at[a - self.base] += at[k]
            if b >= self.base:
                shift = self.words(a)
                at[b - self.base] += [i + shift for i in at[k]]
        return at


def same_ahead(x, i: int, q: int, stop: int) -> int:
    """How many words from ``i`` on equal the word ``q`` later, which lies before ``stop``."""
    done, step = 0, 64
    while i + done + q < stop:
        a = i + done
        m = min(step, stop - a - q)
        differ = x[a:a + m] != x[a + q:a + q + m]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + m, step * 2
    return done


def same_behind(x, i: int, q: int, start: int) -> int:
    """How many words before ``i``, down to ``start``, equal the word ``q`` later."""
    done, step = 0, 64
    while i - done > start:
        b = i - done
        m = min(step, b - start)
        differ = (x[b - m:b] != x[b - m + q:b + q])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + m, step * 2
    return done


def candidates(x, doc, b, lo, hi):
    """(boundary number, pair place, period) of every candidate: the words ``pair place`` and
    ``pair place + period`` start two equal windows, the first or second at the boundary."""
    import numpy as np
    n = len(x)
    h = mix(x.astype(np.uint64) + (doc.astype(np.uint64) << np.uint64(32)) + np.uint64(1))
    alive = np.arange(n)
    found = [np.empty((3, 0), np.int64)]
    w = SEED
    while len(alive) and w < n:
        hashes = window_hashes(h, w)
        alive = alive[alive < len(hashes)]
        order = alive[np.argsort(hashes[alive], kind="stable")]
        value = hashes[order]
        new = np.r_[True, value[1:] != value[:-1]] if len(order) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        many = size[group] > 1 if len(order) else np.empty(0, bool)
        order, group = order[many], group[many]
        if not len(order):
            break
        group_at = np.full(n, -1, np.int64)
        group_at[order] = group
        key = group * n + order                                   # ascending
        low, high = (1, 4 * w) if w == SEED else (2 * w, 4 * w)
        for side in (0, 1):                                       # window starting, ending at the boundary
            seed = b - side * w
            fit = np.flatnonzero((seed >= lo) & (seed + w <= hi))
            fit = fit[group_at[seed[fit]] >= 0]
            s, g = seed[fit], group_at[seed[fit]] * n
            if side == 0:
                left = np.searchsorted(key, g + np.minimum(s + low, n), "left")
                right = np.searchsorted(key, g + np.minimum(s + high, hi[fit] - w + 1), "left")
            else:
                left = np.searchsorted(key, g + np.maximum(s - high + 1, lo[fit]), "left")
                right = np.searchsorted(key, g + np.maximum(s - low + 1, 0), "left")
            count = np.maximum(right - left, 0)
            which = np.repeat(np.arange(len(fit)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + left[which]
            other = order[at]
            q = np.abs(other - s[which])
            found.append(np.stack([fit[which], np.minimum(other, s[which]), q]))
        # a window twice as long occurs again only if both its halves do
        ahead = order + w
        alive = np.sort(order[(ahead < n) & (group_at[np.minimum(ahead, n - 1)] >= 0)])
        w *= 2
    return np.concatenate(found, axis=1)


def crossing_runs(x, doc, b, lo, hi, min_length: int, min_periods: int) -> dict:
    """{boundary number: {(start, end, period)}}, cut to the boundary's interval."""
    import numpy as np
    which, place, period = candidates(x, doc, b, lo, hi)
    fits = np.flatnonzero(hi[which] - lo[which] >= np.maximum(min_length, min_periods * period))
    out: dict = {}
    for k in fits.tolist():
        i, at, q = int(which[k]), int(place[k]), int(period[k])
        known = out.get(i)
        if known and any(s <= at and at + q < e and q % p == 0 for s, e, p in known):
            continue                        # inside a run whose period divides this one
        s = at - same_behind(x, at, q, int(lo[i]))
        e = at + same_ahead(x, at, q, int(hi[i])) + q
        if e - s >= max(min_length, min_periods * q):
            out.setdefault(i, set()).add((s, e, q))
    return out


def merged(runs) -> list:
    """Whole runs (start, length, period) out of parts (start, end, period)."""
    whole: dict = {}
    last = None
    for q, s, e in sorted((q, s, e) for s, e, q in runs):
        if last and last[0] == q and s <= last[2] - q:
            last[2] = max(last[2], e)
        else:
            if last:
                whole.setdefault((last[1], last[2]), last[0])
            last = [q, s, e]
    if last:
        whole.setdefault((last[1], last[2]), last[0])
    return sorted((s, e - s, q) for (s, e), q in whole.items())


def runs_of(texts: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list:
    """The runs (start, length, period), by start and period, of every list of words."""
    import numpy as np
    if not texts:
        return []
    ids = WordIds()
    lengths = [len(t) for t in texts]
    n = sum(lengths)
    x = np.fromiter((ids[w] for t in texts for w in t), np.int64, n)
    doc = np.repeat(np.arange(len(texts)), lengths)
    begin = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    pairs = repeated_pairs(x, doc, len(ids))
    grammars, bs, los, his, tags = {}, [], [], [], []
    for d, found in pairs.items():
        start, stop = int(begin[d]), int(begin[d + 1])
        if stop - start < min_length:
            continue
        found = {p: [i - start for i in at] for p, at in found.items()}
        g = grammars[d] = Grammar(x[start:stop].tolist(), found, len(ids))
        for k, size in enumerate(g.length):
            if size >= min_length:
                first = start + g.first[k]
                bs.append([first + g.words(g.rules[k][0])])
                los.append([first]), his.append([first + size]), tags.append([(d, k)])
        top = np.flatnonzero(np.array(g.sym[1:]) >= 0) + 1 + start
        bs.append(top), los.append([start] * len(top)), his.append([stop] * len(top)), tags.append([(d, -1)] * len(top))
    out: list = [[] for _ in texts]
    if not bs:
        return out
    b, lo, hi = (np.concatenate([np.asarray(v, np.int64) for v in vs]) for vs in (bs, los, his))
    tags = [t for ts in tags for t in ts]
    by_node: dict = {}
    for i, runs in crossing_runs(x, doc, b, lo, hi, min_length, min_periods).items():
        by_node.setdefault(tags[i], set()).update(runs)
    by_doc: dict = {}
    for (d, k), runs in by_node.items():
        by_doc.setdefault(d, {})[k] = runs
    for d, nodes in by_doc.items():
        start, g = int(begin[d]), grammars[d]
        moved = {(s - start, e - start, q) for s, e, q in nodes.pop(-1, ())}
        at = g.places() if nodes else []
        for k, runs in nodes.items():
            first = start + g.first[k]
            moved.update((s - first + i, e - first + i, q) for s, e, q in runs for i in at[k])
        out[d] = merged(moved)
    return out


def collapsed(words: list, runs: list) -> list:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    import numpy as np
    keep = np.ones(len(words), bool)
    for s, m, q in runs:
        keep[s + q:s + m] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def greatest(runs: list):
    """The run with the greatest exponent; ties: the smallest start, then period."""
    best = None
    for r in runs:                              # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _finder(min_length: int, min_periods: int, group_words: int):
    def run(column):
        import pyarrow as pa
        out = {n: [] for n in NAMES}

        def flush(texts):
            for words, runs in zip(texts, runs_of(texts, min_length, min_periods)):
                as_rows = [dict(zip(("start", "length", "period"), r)) for r in runs]
                top = greatest(runs)
                out["n_runs"].append(len(runs))
                out["top"].append(dict(zip(("start", "length", "period"), top)) if top else None)
                out["runs"].append(as_rows)
                out["collapsed"].append(b" ".join(collapsed(words, runs)))

        group, held = [], 0
        for data in binary_list(column):
            words = data.split()
            if group and held + len(words) > group_words:
                flush(group)
                group, held = [], 0
            group.append(words)
            held += len(words)
        flush(group)
        kind = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])
        arrays = [pa.array(out["n_runs"], pa.int64()), pa.array(out["top"], kind),
                  pa.array(out["runs"], pa.list_(kind)), pa.array(out["collapsed"], pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(arrays, NAMES)
    return run


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS,
                  group_words: int = GROUP_WORDS) -> DataFrame:
    """Every row of ``docs`` with ``n_runs``, its ``runs`` (start, length, period; by start, then
    period), the ``top`` one of them (null: none) and the ``collapsed`` text."""
    # an l-word stretch is only sure to reach a seed on one side of a boundary if half a run does
    if min_length < 6 * SEED or min_periods < 3:
        raise ValueError(f"runs have at least {6 * SEED} words and 3 periods")
    run = F.arrow_udf(_finder(min_length, min_periods, group_words), FIELDS)
    return with_fields(docs, run(F.col(text).cast("string")), NAMES)


def _rotate(h, column):
    import pyarrow as pa
    out = []
    for key, data in zip(h.to_pylist(), binary_list(column)):
        if key is not None and key % 10 == 0:
            words = data.split()
            n, g = len(words), key // 10
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                data = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
        out.append(data)
    return pa.array(out, pa.binary()).cast(pa.string())


def rotated(doc_id: Column, text: Column) -> Column:
    """``text``; where crc32 of the decimal id ends in 0, its tail repeats the words of a period."""
    return F.arrow_udf(_rotate, "string")(F.crc32(doc_id.cast("string").cast("binary")), text.cast("string"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, after the contract's rotation of every tenth one."""
    docs = documents(spark, sf_dir).select("doc_id", rotated(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = F.col("top")
    milli = F.expr("(1000 * top.length) div top.period")
    return found.select(
        "doc_id", "n_runs", top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        milli.alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


_ship_by_value(__name__)
