"""LM scoring with a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

Tokens are the words (A-Z lower-cased) and one end.  Restaurants, from the leaves up:

* one for each preceding word within each class, for every word of the training texts;
* their parents, one for each class: the class of the last short word (up to ``SHORT`` bytes) before the
  token.  Short words are mostly function words and so tell language and syntax.  Customers
  are the tables of the word restaurants, and the tokens at a text's start;
* all classes share one parent, the unigram restaurant, whose customers are their tables;
* the unigram restaurant's parent is a diffuse base: a draw from it is a word not seen yet, so each
  word has one table there, and the mass left to the base is the probability of "an unseen
  word".  This is the event space of the base score too: the training words and one more type.

Training counts come from all training documents: a count for each (restaurant, word), which grow with
the corpus.  The at most ``HEAD`` most frequent words are "listed"; totals of their restaurants are arrays of a
bounded size, so what words are customers of there is one row for each word and a sweep needs no shuffle of these.
The restaurants of other words ("far") lie by restaurant; words and far restaurants exchange tables and
probabilities in each sweep, by word for words that are not listed.  A word that is a customer once
has one table, so only the others are seated; words of which nothing changes stay out of the sweeps.  A row's lists
are stored as bytes, which Spark hands to the tasks whole.  A Gibbs sweep takes every word out of all restaurants and seats its customers anew,
given the other words' tables of the sweep before (its own are taken out of the restaurant's
total).  Customers beyond the fourth of a
word are seated in blocks of a quarter of those seated.  After the burn-in, the predictive
probabilities of ``SAMPLES`` sweeps are averaged, restaurant by restaurant.

Scoring: a token's log probability is that in its class, plus what the word restaurant leaves to
its parent, plus - if training has the pair - what the pair adds.  The listed
words, the at most ``PAIRS`` most frequent pairs and the listed words' restaurants are sent to the
tasks (fixed bounds); rarer words, pairs and far restaurants are dealt by key in parts together with the documents' own
(as bytes, many values a row), and the sums come back by document.  A pair's key is a hash of 48 bits and its part: of pairs
that training has not, about one in 100 million is taken for another.

Defined cases: a null text counts as empty: its only token is the end; rows that repeat an id
and text are scored each; a null id takes part by the checksum of ''; without training rows
every token is an unseen word, of probability 1; an empty table gives an empty result; very long texts
are coded whole, text by text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.tables import documents, in_fold, let_go, written
from regspark.llm.words import _ship_by_value, binary_list, mix
from regspark.session import staging_path

HELD_OUT = 1
CONTEXTS = 16
SHORT = 3
HEAD = 100_000
PAIRS = 1_000_000
PART = 2_000_000                                # training tokens whose pairs are one part
KEY = (1 << 48) - 1                             # of a pair's key, beside its part
BURN_IN, SAMPLES = 1, 2
STRENGTH = 1.0
NO_ID = -1 << 62
C = [f"c{u}" for u in range(CONTEXTS)]
T = [f"t{u}" for u in range(CONTEXTS)]


class Vocabulary(dict):
    """word -> number; knows each word's context class."""

    def __init__(self):
        super().__init__()
        self.words: list = []
        self.classes: list = []

    def __missing__(self, word: bytes) -> int:
        from zlib import crc32
        self.words.append(word)
        self.classes.append(1 + crc32(word) % (CONTEXTS - 1) if 0 < len(word) <= SHORT else 0)
        n = self[word] = len(self)
        return n


def coded(texts: list, vocabulary: Vocabulary):
    """(word numbers, contexts, first token of each text) of texts laid end to end."""
    import numpy as np
    parts, starts, n = [], [], 0
    for t in texts:
        words = t.lower().split()
        words.append(b"")                                   # the end; no word is empty
        starts.append(n)
        n += len(words)
        parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate(parts)
    classes = np.array(vocabulary.classes, np.int8)[ids]
    at = np.arange(n)
    first = np.zeros(n, np.int64)
    first[starts] = starts
    first = np.maximum.accumulate(first)
    last = np.maximum.accumulate(np.where(classes > 0, at, -1))
    last = np.concatenate([[-1], last[:-1]])
    return ids, np.where(last >= first, classes[np.maximum(last, 0)], 0).astype(np.int64), np.array(starts, np.int64)


def text_parts(texts: list, most: int = 4 << 20):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _count(batches):
    """Words of a task with their tokens."""
    from collections import Counter
    import pyarrow as pa
    limit = 250_000
    counts = Counter()

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for text in binary_list(batch["text"]):
            counts.update(text.lower().split())
            counts[b""] += 1
            if len(counts) > limit:
                yield batch_of()
                counts = Counter()
    if counts:
        yield batch_of()


class Lexicon:
    """The listed words, most frequent first: their place is their number.  Other words are numbered by their
    hash, below zero.  A restaurant's number is the class itself or, after a listed word, counts on from there;
    after another word ("far") it is a hash below zero.  Its last four bits are the class."""

    def __init__(self, words: list):
        self.words = words
        self.rooms = (len(words) + 1) * CONTEXTS            # those that are not far

    def numbers(self, words: list):
        import numpy as np
        from xxhash import xxh64_intdigest
        listed = {w: i for i, w in enumerate(self.words)} if not hasattr(self, "listed") else self.listed
        self.listed = listed
        return np.fromiter((listed[w] if w in listed else -1 - (xxh64_intdigest(w) >> 1) for w in words), np.int64, len(words))

    def restaurants(self, places, numbers):
        """Restaurants at ``places`` (see ``places_of``)."""
        import numpy as np
        after = np.where(numbers >= 0, (numbers + 1) * CONTEXTS, numbers * CONTEXTS | np.int64(-1 << 63))
        return np.concatenate([[0], after])[places // CONTEXTS] + places % CONTEXTS

    def __getstate__(self):
        return {"words": self.words, "rooms": self.rooms}


def places_of(ids, contexts, starts):
    """Restaurant of every token by the part's own word numbers: preceding word (0: none, at a text's start) and class."""
    import numpy as np
    before = np.concatenate([[0], ids[:-1] + 1])
    before[starts] = 0
    return before * CONTEXTS + contexts


def pair_keys(rooms, numbers):
    """A hash for each (restaurant, word)."""
    import numpy as np
    return mix(mix(numbers.astype(np.int64).view(np.uint64)) ^ rooms.astype(np.int64).view(np.uint64))


def room_keys(rooms):
    import numpy as np
    return mix(mix(rooms.view(np.uint64)) + np.uint64(1))


def share(keys, parts: int):
    """Part, of ``parts``, that each key falls to."""
    import numpy as np
    hashed = mix(np.ascontiguousarray(keys).view(np.uint64)) >> np.uint64(32)
    return (hashed * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def squeezed(values) -> bytes:
    """``values``, their first bytes before their second ones and so on, compressed."""
    import numpy as np
    import pyarrow as pa
    values = np.ascontiguousarray(values)
    raw = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def loosened(data: bytes, kind="int64"):
    import numpy as np
    import pyarrow as pa
    size = np.dtype(kind).itemsize
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


class Sent:
    """An array that goes to the tasks squeezed."""

    def __init__(self, values):
        self.values = values

    def __getstate__(self):
        return self.values.shape, self.values.dtype.str, squeezed(self.values.reshape(-1))

    def __setstate__(self, state):
        shape, kind, data = state
        self.values = loosened(data, kind).reshape(shape)


def _lists(part, columns: list, gaps: bool = False):
    """(part numbers that occur, for each column a list with the squeezed values of each); ``gaps``: those of the first
    column, which is sorted, as differences."""
    import numpy as np
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    found = part[np.concatenate([[0], cuts]).astype(int)] if len(part) else part
    split = [np.split(c[order], cuts) if len(part) else [] for c in columns]
    if gaps:
        split[0] = [np.diff(x, prepend=x.dtype.type(0)) for x in split[0]]
    return found, [[squeezed(x) for x in c] for c in split]


def _grouped(batches, names: list):
    """(first column, rows of it) of rows that are sorted by their first column."""
    from itertools import groupby
    rows = (tuple(b[x][i].as_py() for x in names) for b in batches for i in range(b.num_rows))    # long values: one by one
    return groupby(rows, lambda r: r[0])


DEALT = "part int, wid binary, room binary, n binary"
DEALT_NAMES = ["part", "of_wid", "of_room", "of_n"]


def _pairs(lexicon: Lexicon, parts: int):
    """Customers of a task by (restaurant, word), dealt by word to ``parts`` parts; those in far restaurants also by
    restaurant, to as many parts more."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for part in text_parts(binary_list(batch["text"]), 16 << 20):
                vocabulary = Vocabulary()
                ids, contexts, starts = coded(part, vocabulary)
                numbers = lexicon.numbers(vocabulary.words)
                code, n = np.unique(places_of(ids, contexts, starts) * len(vocabulary) + ids, return_counts=True)
                rooms, wid = lexicon.restaurants(code // len(vocabulary), numbers), numbers[code % len(vocabulary)]
                order = np.lexsort((rooms, wid))
                rooms, wid, n = rooms[order], wid[order], n[order].astype(np.int64)
                far = rooms < 0
                for dealt, c in ((share(wid, parts), (wid, rooms, n)), (parts + share(rooms[far], parts), (wid[far], rooms[far], n[far]))):
                    found, lists = _lists(dealt, list(c))
                    for at in range(0, len(found), 200):
                        yield pa.RecordBatch.from_arrays([pa.array(found[at:at + 200], pa.int32()), *[pa.array(x[at:at + 200], pa.binary()) for x in lists]],
                                                         ["part", "wid", "room", "n"])
    return run


def _summed(parts: int):
    """Rows of ``SEATED``: words with their customers, and far restaurants' customers part by part, sorted by
    (restaurant, word)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for part, rows in _grouped(batches, ["part", "wid", "room", "n"]):
            columns = [[loosened(x) for x in c] for c in list(zip(*rows))[1:]]
            wid, room, n = (np.concatenate(c) for c in columns)
            order = np.lexsort((room, wid) if part < parts else (wid, room))
            wid, room, n = wid[order], room[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], (wid[1:] != wid[:-1]) | (room[1:] != room[:-1])]))
            wid, room, n = wid[starts], room[starts], np.add.reduceat(n, starts)
            if part < parts:
                yield from _word_rows(wid, room, n)
            else:
                yield pa.RecordBatch.from_arrays([
                    pa.array([0]), *[pa.array([b""], pa.binary())] * (len(NAMES) - 1), pa.array([FAR_PART], pa.int32()),
                    pa.array([part], pa.int32()), *[pa.array([squeezed(x)], pa.binary()) for x in (wid, room, n)]], [*NAMES, "kind", *DEALT_NAMES])
    return run


def _dealt(df: DataFrame, parts: int, *then: str) -> DataFrame:
    return df.repartition(parts, "part").sortWithinPartitions("part", *then)


def _parts(batches):
    """Words, restaurants and customers of every part."""
    for _, rows in _grouped(batches, ["part", "wid", "room", "n"]):
        for r in rows:
            yield [loosened(x) for x in r[1:]]


def _counts(batches):
    """How many pairs of a word and a listed word's restaurant have so many customers."""
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        if batch.num_rows:
            _, room, n, _ = _row(batch, ("n",))
            once = len(_unpacked(batch["once"], "int32")[0])
            kinds, m = np.unique(n[room >= CONTEXTS], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([1, *kinds.tolist()], pa.int64()), pa.array([once, *m.tolist()], pa.int64())], ["n", "m"])


def _far_counts(batches):
    import numpy as np
    import pyarrow as pa
    for _, _, n in _parts(batches):
        kinds, m = np.unique(n, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(m)], ["n", "m"])


#: values of a long array by place, squeezed
CHUNK, CHUNKS = 1 << 15, "chunk int, held binary"


def _chunks(every):
    import numpy as np
    import pyarrow as pa
    for at in range(0, len(every), CHUNK):
        if every[at:at + CHUNK].any():
            yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int32()), pa.array([squeezed(every[at:at + CHUNK].astype(np.int64))], pa.binary())],
                                             ["chunk", "held"])


def _added(batches):
    import pyarrow as pa
    for chunk, rows in _grouped(batches, ["chunk", "held"]):
        total = 0
        for r in rows:
            total = total + loosened(r[1])
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([squeezed(total)], pa.binary())], ["chunk", "held"])


def _array(parts: DataFrame, size: int):
    """The sum of all tasks' arrays."""
    import numpy as np
    found = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_added, CHUNKS).toArrow()
    every = np.zeros(size, np.int64)
    for chunk, held in zip(found["chunk"].to_pylist(), found["held"].to_pylist()):
        piece = loosened(held)
        every[chunk * CHUNK:chunk * CHUNK + len(piece)] = piece
    return every


def _by_room(rooms: int):
    """Customers, and words that are customers once, of the listed words' restaurants."""
    def run(batches):
        import numpy as np
        every = np.zeros((2, rooms), np.int64)
        for batch in batches:
            if batch.num_rows:
                _, room, n, _ = _row(batch, ("n",))
                own, once = room >= CONTEXTS, _unpacked(batch["once"], "int32")[0]
                np.add.at(every[0], room[own], n[own])
                np.add.at(every[1], once, 1)
        every[0] += every[1]
        yield from _chunks(every.reshape(-1))
    return run


def seat(customers, others, weight, discount: float, rng):
    """Tables after seating the customers of each dish; ``others``: tables of the other dishes of
    the restaurant; ``weight``: probability of the dish in the parent."""
    import numpy as np
    tables = (customers > 0).astype(np.int64)
    seated = 1
    on = np.flatnonzero(customers > 1)
    while len(on):
        block = max(1, seated // 4)
        take = np.minimum(customers[on] - seated, block)
        w = (STRENGTH + discount * (others[on] + tables[on])) * weight[on]
        tables[on] += rng.binomial(take, w / (w + seated - discount * tables[on]))
        seated += block
        on = on[customers[on] > seated]
    return tables


class Model:
    """Totals of one sweep: enough to turn a word's customers and tables into probabilities."""

    def __init__(self, customers: list, tables: list, discount: float, kinds: int, top_discount: float):
        import numpy as np
        self.customers, self.tables = np.array(customers, np.float64), np.array(tables, np.float64)
        self.discount, self.top_discount = discount, top_discount
        self.top_customers, self.kinds = float(self.tables.sum()), float(kinds)

    def unigram(self, customers):
        """Probability of known words in the unigram restaurant (one table each)."""
        return (customers - self.top_discount) / (STRENGTH + self.top_customers)

    def back_off(self):
        """Share that each context leaves to its parent."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def unseen(self):
        """Probability, in each context, of a word that training did not hold."""
        return self.back_off() * (STRENGTH + self.top_discount * self.kinds) / (STRENGTH + self.top_customers)

    def contextual(self, customers, tables, unigram):
        """[word, context] probability."""
        return ((customers - self.discount * tables) / (STRENGTH + self.customers)[None, :]
                + self.back_off()[None, :] * unigram[:, None])


#: rooms, once: int32 values; the others: int64 values.  ``once``: restaurants where the word is a customer once, which
#: count as customers of the class in ``n``; ``far``: its tables in far restaurants where it is a customer more than once,
#: by class, and its customers there, if there are any; ``away``: all its far restaurants, of words that are not listed
STATE = "wid long, rooms binary, n binary, t binary, ts binary, tops binary, drawn binary, once binary, far binary, away binary"
NAMES = [f.split()[0] for f in STATE.split(", ")]


def _packed(values, ends):
    """Binary column with the bytes of ``values`` laid end to end, cut at the places ``ends``."""
    import numpy as np
    import pyarrow as pa
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(ends) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unpacked(column, kind="int64"):
    """(values laid end to end, places where rows end, from 0) of a binary column."""
    import numpy as np
    import pyarrow as pa
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _row(batch, names=("n", "t", "ts")):
    """(row of each pair, rooms, the columns ``names``: customers, tables, tables of all samples) laid end to end,
    and the row offsets."""
    import numpy as np
    rooms, ends = _unpacked(batch["rooms"], "int32")
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends)), rooms, *(_unpacked(batch[x])[0] for x in names), ends


def _first_seats(batches):
    """Rows of ``STATE`` from customers (wid, room, n) sorted by word: one table for each kind of customer."""
    import numpy as np
    import pyarrow as pa

    def rows_of(*columns):
        order = np.lexsort((columns[1], columns[0]))
        wid, rooms, n = (x[order] for x in columns)
        starts = np.flatnonzero(np.concatenate([[True], wid[1:] != wid[:-1]]))
        ends, k = np.append(starts, len(wid)), len(starts)
        tops = np.zeros((k, CONTEXTS), np.int64)
        tops[np.repeat(np.arange(k), np.diff(ends)), rooms % CONTEXTS] = 1
        t = np.where(rooms < CONTEXTS, n, 1)
        return pa.RecordBatch.from_arrays([
            pa.array(wid[starts]), _packed(rooms.astype(np.int32), ends), _packed(n, ends), _packed(t, ends), _packed(np.zeros_like(n), ends),
            _by_class(tops, tops > 0), *[_packed(np.zeros(0, np.int64), np.zeros(k + 1, np.int64))] * 4], NAMES)
    held = []                                               # rows of a word that the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch[x].to_numpy() for x in ("wid", "room", "n")])
        wid = held[-1][0]
        if wid[-1] == held[0][0][0]:
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        at = int(np.searchsorted(columns[0], wid[-1]))
        yield rows_of(*(x[:at] for x in columns))
        held = [[x[at:] for x in columns]]
    if held:
        yield rows_of(*(np.concatenate(x) for x in zip(*held)))


#: words that sweeps seat anew; those whose tables in far restaurants come by a join; those that have a seat only,
#: whose ``drawn`` is known; parts of the far restaurants' customers
MOVING, MET, STILL, FAR_PART = range(4)
SEATED = STATE + ", kind int, part int, of_wid binary, of_room binary, of_n binary"


def _word_rows(wid, room, n):
    """Rows of ``SEATED`` from the customers of words, sorted."""
    import numpy as np
    import pyarrow as pa
    once = (n == 1) & (room >= CONTEXTS)
    far, more = room < 0, (room < 0) & (n > 1)
    # those who are customers once are customers of the class; a word of far restaurants is held in their classes
    fixed = np.where(once | far, room % CONTEXTS, room)
    order = np.lexsort((fixed, wid))
    w, r = wid[order], fixed[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])]))
    w, r, sums = w[first], r[first], np.add.reduceat(np.where(more, 0, n)[order], first)
    words, row = np.unique(wid, return_inverse=True)
    k, away = len(words), far & (wid < 0)
    tables = np.bincount(row[more] * CONTEXTS + room[more] % CONTEXTS, minlength=k * CONTEXTS).reshape(k, CONTEXTS)
    has, customers = tables.any(1), np.rint(np.bincount(row[more], n[more], k)).astype(np.int64)
    moves = has.copy()
    moves[np.searchsorted(words, w[(sums > 1) | (r >= CONTEXTS)])] = True
    kind = np.where(has & (words < 0), MET, np.where(moves, MOVING, STILL)).astype(np.int32)
    seats = np.bincount(np.searchsorted(words, w), minlength=k) * ~moves                # one customer, one table in each class
    drawn = _packed(np.ones(int(seats.sum()) * 2 * SAMPLES, np.int64), np.concatenate([[0], np.cumsum(seats)]) * 2 * SAMPLES)
    ends = lambda of: np.concatenate([[0], np.cumsum(np.bincount(row[of], minlength=k))])
    more_columns = [drawn, _packed(room[once].astype(np.int32), ends(once)), _packed_far(tables, customers, has), _packed(room[away], ends(away)), pa.array(kind)]
    at = 0
    for rows in _first_seats([pa.RecordBatch.from_arrays([pa.array(x) for x in (w, r, sums)], ["wid", "room", "n"])]):
        m = rows.num_rows
        none = [pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.binary())] * 3]
        held = pa.RecordBatch.from_arrays([*rows.columns[:-4], *[c.slice(at, m) for c in more_columns], *none], [*NAMES, "kind", *DEALT_NAMES])
        at += m
        for i in range(0, m, 5_000):
            yield held.slice(i, 5_000)


def _packed_far(tables, customers, has):
    import numpy as np
    return _packed(np.concatenate([tables, customers[:, None]], 1)[has], np.concatenate([[0], np.cumsum(has)]) * (CONTEXTS + 1))


def _far(batch):
    """([word, class] tables in far restaurants where a word is a customer more than once, [word] customers in these)."""
    import numpy as np
    values, ends = _unpacked(batch["far"])
    every = np.zeros((batch.num_rows, CONTEXTS + 1), np.int64)
    every[np.diff(ends) > 0] = values.reshape(-1, CONTEXTS + 1)
    return every[:, :CONTEXTS].copy(), every[:, CONTEXTS]


def _class_customers(row, rooms, t, far):
    """[word, class] customers in the classes: the tables of the word restaurants."""
    import numpy as np
    sums = np.bincount(row * CONTEXTS + rooms % CONTEXTS, t, far.size)
    return np.rint(sums).astype(np.int64).reshape(far.shape) + far


def _by_class(values, held):
    """Binary column of ``values`` ([word, class] or [word, class, ...]) where a word is ``held`` in a class."""
    import numpy as np
    each = int(np.prod(values.shape[2:]))
    return _packed(values[held], np.concatenate([[0], np.cumsum(held.sum(1))]) * each)


def _held(row, rooms, rows: int):
    """[word, class]: whether a word has customers in a class, which no sweep changes."""
    import numpy as np
    held = np.zeros((rows, CONTEXTS), bool)
    held[row, rooms % CONTEXTS] = True
    return held


def _tops(batch, held):
    import numpy as np
    tops = np.zeros(held.shape, np.int64)
    tops[held] = _unpacked(batch["tops"])[0]
    return tops


def _drawn(batch, held):
    """[sample][customers, tables][word, class] of the averaged sweeps."""
    import numpy as np
    values = _unpacked(batch["drawn"])[0].reshape(int(held.sum()), -1)
    drawn = np.zeros((*held.shape, values.shape[1]), np.int64)
    drawn[held] = values
    return np.moveaxis(drawn, 2, 0).reshape(-1, 2, *held.shape)


FAR_SUMS = [f"s{u}" for u in range(CONTEXTS)]


def _sweep(model: Model, tables, discount: float, sweep: int, far_tables):
    """Seat every word's customers anew, in the word restaurants and then in the classes; ``tables``,
    ``discount``: of the word restaurants; ``far_tables``: [listed word, class] new tables in far restaurants (those of
    other words come with their rows)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            wid = batch["wid"].to_numpy()
            rng = np.random.default_rng([sweep, int(wid[0]) & 0xFFFFFFFF, k])
            row, rooms, n, t, ts, offsets = _row(batch)
            held, (far, far_customers) = _held(row, rooms, k), _far(batch)
            c, old = _class_customers(row, rooms, t, far), _tops(batch, held)
            p = model.contextual(c, old, model.unigram(old.sum(1)))
            new, on = n.copy(), np.flatnonzero(rooms >= CONTEXTS)
            new[on] = seat(n[on], np.maximum(tables.values[rooms[on]] - t[on], 0), p[row[on], rooms[on] % CONTEXTS], discount, rng)
            has = far.any(1)
            if FAR_SUMS[0] in batch.schema.names:
                far = np.stack([batch[s].to_numpy() for s in FAR_SUMS], 1)
            else:
                far[has] = far_tables.values[wid[has]]
            c = _class_customers(row, rooms, new, far)
            old = np.minimum(old, c)
            weight = np.repeat(np.maximum(model.unigram(old.sum(1)), 0), CONTEXTS)
            top = seat(c.reshape(-1), np.maximum(model.tables[None, :] - old, 0).reshape(-1), weight, model.discount, rng).reshape(c.shape)
            late = sweep > BURN_IN
            drawn = _drawn(batch, held).reshape(-1, k, CONTEXTS)
            if late:
                drawn = np.concatenate([drawn, [c, top]])
            yield pa.RecordBatch.from_arrays([
                batch["wid"], batch["rooms"], batch["n"], _packed(new, offsets), _packed(ts + new if late else ts, offsets),
                _by_class(top, held), _by_class(np.moveaxis(drawn, 0, 2), held), batch["once"],
                _packed_far(far, far_customers, has), batch["away"]], NAMES)
    return run


def _word_chances(model: Model):
    """Probability, by class, of the words with customers in far restaurants to be seated."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            row, rooms, t, _ = _row(batch, ("t",))
            far, top = _far(batch)[0], _tops(batch, _held(row, rooms, k))
            p = model.contextual(_class_customers(row, rooms, t, far), top, model.unigram(top.sum(1)))
            has = far.any(1)
            yield pa.RecordBatch.from_arrays([batch["wid"].filter(pa.array(has)), _packed(p[has].astype(np.float32), np.arange(has.sum() + 1) * CONTEXTS)], ["wid", "p"])
    return run


#: customers (more than one of a word) of far restaurants; ``once``: words that are customers there once
FAR = "room long, wid long, n long, t long, ts long, once long"


def _far_rows(batches):
    """Rows of ``FAR`` from parts dealt by restaurant."""
    import numpy as np
    import pyarrow as pa
    for wid, room, n in _parts(batches):
        starts = np.flatnonzero(np.concatenate([[True], room[1:] != room[:-1]]))
        once = np.repeat(np.add.reduceat((n == 1).astype(np.int64), starts), np.diff(np.append(starts, len(room))))
        more = n > 1
        k = int(more.sum())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (room[more], wid[more], n[more], np.ones(k, np.int64), np.zeros(k, np.int64), once[more])],
                                         [f.split()[0] for f in FAR.split(", ")])


def _seat_far(chances, discount: float, sweep: int):
    """Seat the customers of far restaurants, whose rows lie together, anew.  ``chances``: [listed word, class]; those of
    other words come with their rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        names = [f.split()[0] for f in FAR.split(", ")]

        def seated(room, wid, n, t, ts, once, p):
            starts = np.flatnonzero(np.concatenate([[True], room[1:] != room[:-1]]))
            others = once + np.repeat(np.add.reduceat(t, starts), np.diff(np.append(starts, len(room)))) - t
            rng = np.random.default_rng([sweep, int(room[0]) & 0xFFFFFFFF, len(room)])
            new = seat(n, others, p, discount, rng)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (room, wid, n, new, ts + new if sweep > BURN_IN else ts, once)], names)
        held = None                                          # rows of a restaurant that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch[x].to_numpy() for x in names]
            room, wid = columns[:2]
            listed, p = wid >= 0, np.zeros(len(wid))
            p[listed] = chances.values[wid[listed], room[listed] % CONTEXTS]
            given, ends = _unpacked(batch["p"].filter(pa.array(~listed)), "float32")
            p[~listed] = given.reshape(-1, CONTEXTS)[np.arange(len(ends) - 1), room[~listed] % CONTEXTS]
            columns.append(p)
            if held:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            at = int(np.searchsorted(columns[0], columns[0][-1]))
            if at:
                yield seated(*(x[:at] for x in columns))
            held = [x[at:] for x in columns]
        if held:
            yield seated(*held)
    return run


SUMS = [*C, *T, "kinds", "n1", "n2", "m1", "m2"]


def _sums(rooms: int):
    """What ``_totals`` needs of a task: the sums of ``SUMS``, then tables by restaurant."""
    def run(batches):
        import numpy as np
        sums, by_room = np.zeros(len(SUMS), np.int64), np.zeros(rooms, np.int64)
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            row, room, t, _ = _row(batch, ("t",))
            c, top = _class_customers(row, room, t, _far(batch)[0]), _tops(batch, _held(row, room, k))
            kinds, own = top.sum(1), room >= CONTEXTS
            sums += [*c.sum(0), *top.sum(0), len(c), (c == 1).sum(), (c == 2).sum(), (kinds == 1).sum(), (kinds == 2).sum()]
            np.add.at(by_room, room[own], t[own])
        yield from _chunks(np.concatenate([sums, by_room]))
    return run


def _summed_state(state: DataFrame, rooms: int):
    """Sums over all words, an array of a bounded size."""
    return _array(state.select("rooms", "t", "tops", "far").mapInArrow(_sums(rooms), CHUNKS), len(SUMS) + rooms)


def _totals(every):
    """(class totals, tables by word restaurant but for those of words that are customers once).  Discounts by how many
    customers of a dish are one or two (n1 / (n1 + 2 n2))."""
    import numpy as np
    got = dict(zip(SUMS, every.tolist()))
    model = Model([got[c] for c in C], [got[t] for t in T], _discount(got["n1"], got["n2"]), got["kinds"],
                  _discount(got["m1"], got["m2"]))
    return model, every[len(SUMS):]


def _discount(ones, twos) -> float:
    return min(0.95, max(0.1, (ones or 0) / max(1, (ones or 0) + 2 * (twos or 0))))


class Rooms:
    """Totals of the listed words' restaurants; ``tables``: those of each averaged sweep."""

    def __init__(self, customers, tables: list, discount: float):
        self.customers, self.tables, self.samples, self.discount = Sent(customers), Sent(sum(tables)), len(tables), discount

    def back_off(self):
        return (STRENGTH + self.discount / self.samples * self.tables.values) / (STRENGTH + self.customers.values)


class Learned:
    """``state``: a row for each word with its restaurants, customers and sampled tables; ``models``: the
    class totals of each averaged sweep; ``rooms``: the listed words' restaurants; ``pairs``: customers of the far restaurants,
    in parts; ``far``: rows of ``FAR``; ``tally``: [(n, pairs with n customers in listed words' restaurants)]; ``parts``: the number of parts."""

    def __init__(self, lexicon, state, models, rooms, pairs, far, tally, parts):
        self.lexicon, self.state, self.models, self.rooms = lexicon, state, models, rooms
        self.pairs, self.far, self.tally, self.parts = pairs, far, tally, parts


def _least(by_count: list, most: int) -> int:
    """Least count of the at most ``most`` most frequent of the rows counted in ``by_count`` (count, rows)."""
    least, kinds = 1 << 62, 0
    for n, m in sorted(by_count, reverse=True):
        if kinds + m > most:
            break
        least, kinds = n, kinds + m
    return least


def _listed(counts: DataFrame, most: int):
    """(least count of the at most ``most`` most frequent rows, sum of all counts, rows)."""
    by_count = [(r[0], r[1]) for r in counts.groupBy("n").agg(F.count("*").alias("m")).collect()]
    return _least(by_count, most), sum(n * m for n, m in by_count), sum(m for _, m in by_count)


def learn(training: DataFrame) -> Learned:
    """The seated model; ``training``: column ``text``."""
    import numpy as np
    spark, words, seats = training.sparkSession, *(staging_path(training.sparkSession, x) for x in ("words", "seats"))
    training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(words)
    counts = spark.read.schema("word binary, n long").parquet(words)
    least, n_train, _ = _listed(counts, HEAD)
    head = counts.where(F.col("n") >= least).toArrow()                      # <= HEAD rows
    listed = sorted(zip((-n for n in head["n"].to_pylist()), head["word"].to_pylist()))
    lexicon, parts = Lexicon([w for _, w in listed]), 1 + n_train // PART
    dealt = _dealt(training.select("text").mapInArrow(_pairs(lexicon, parts), DEALT), parts)
    let_go(spark, words)
    dealt.mapInArrow(_summed(parts), SEATED).write.partitionBy("kind").parquet(seats, compression="zstd")
    whole = spark.read.schema(SEATED).parquet(seats)
    let_go(spark)
    state, others, still = (whole.where(F.col("kind") == k).select(*NAMES) for k in (MOVING, MET, STILL))
    seated = whole.where(F.col("kind") != FAR_PART)
    pairs = whole.where(F.col("kind") == FAR_PART).select("part", *[F.col(f"of_{x}").alias(x) for x in ("wid", "room", "n")])
    tally, far_tally = ([tuple(r) for r in x.groupBy("n").agg(F.sum("m")).collect()] for x in (
        seated.select("rooms", "n", "once").mapInArrow(_counts, "n long, m long"), pairs.mapInArrow(_far_counts, "n long, m long")))
    discount = _discount(*(sum(m for n, m in tally + far_tally if n == k) for k in (1, 2)))
    customers, once = _array(seated.select("rooms", "n", "once").mapInArrow(_by_room(lexicon.rooms), CHUNKS), 2 * lexicon.rooms).reshape(2, -1)
    paths = [staging_path(spark, "far")]
    pairs.mapInArrow(_far_rows, FAR).write.parquet(*paths)
    far = spark.read.schema(FAR).parquet(*paths)
    fixed = _summed_state(still, lexicon.rooms)
    model, tables = _totals(fixed + _summed_state(state.unionByName(others), lexicon.rooms))
    old = [*paths, f"{seats}/kind={MOVING}", f"{seats}/kind={MET}"]
    models, sampled = [], []
    for sweep in range(1, BURN_IN + SAMPLES + 1):
        chances = [x.select("wid", "rooms", "t", "tops", "far").mapInArrow(_word_chances(model), "wid long, p binary")
                   for x in (state.where((F.col("wid") >= 0) & (F.length("far") > 0)), others)]
        found = chances[0].toArrow().combine_chunks()                       # <= HEAD rows
        by_word = np.zeros((len(lexicon.words), CONTEXTS), np.float32)
        if len(found):
            by_word[found["wid"].to_numpy()] = np.frombuffer(b"".join(found["p"].to_pylist()), np.float32).reshape(-1, CONTEXTS)
        rows = far.where("wid >= 0").withColumn("p", F.lit(None).cast("binary")).unionByName(far.where("wid < 0").join(chances[1], "wid"))
        paths = [staging_path(spark, x) for x in ("far", "seats", "met")]
        rows.repartition("room").sortWithinPartitions("room").mapInArrow(_seat_far(Sent(by_word), discount, sweep), FAR).write.parquet(paths[0])
        far = spark.read.schema(FAR).parquet(paths[0])
        of_class = F.col("room").bitwiseAND(F.lit(CONTEXTS - 1))
        found = far.where("wid >= 0").groupBy("wid", of_class.alias("class")).agg(F.sum("t").alias("t")).toArrow()
        far_tables = np.zeros((len(lexicon.words), CONTEXTS), np.int64)
        far_tables[found["wid"].to_numpy(), found["class"].to_numpy()] = found["t"].to_numpy()
        sums = far.where("wid < 0").groupBy("wid").agg(*[F.sum(F.when(of_class == u, F.col("t")).otherwise(0)).alias(s) for u, s in enumerate(FAR_SUMS)])
        step = _sweep(model, Sent(tables + once), discount, sweep, Sent(far_tables))
        for x, path in zip((state, others.join(sums, "wid")), paths[1:]):
            x.mapInArrow(step, STATE).write.parquet(path, compression="zstd")
        state, others = (spark.read.schema(STATE).parquet(path) for path in paths[1:])
        let_go(spark, *old)
        old = paths
        model, tables = _totals(fixed + _summed_state(state.unionByName(others), lexicon.rooms))
        if sweep > BURN_IN:
            models.append(model)
            sampled.append(tables + once)
    rooms = Rooms(customers, sampled, discount)
    return Learned(lexicon, state.unionByName(others).unionByName(still), models, rooms, pairs, far, tally, parts)


def train(training: DataFrame) -> list:
    """[(customers and tables of every word in the classes, class totals)] of the averaged sweeps."""
    learned = learn(training)
    schema = "wid long, " + ", ".join(f"{x} long" for x in (*C, *T))

    def sample(i):
        def run(batches):
            import numpy as np
            import pyarrow as pa
            for batch in batches:
                if batch.num_rows:
                    row, rooms, _ = _row(batch, ())
                    both = np.concatenate(list(_drawn(batch, _held(row, rooms, batch.num_rows))[i]), 1)
                    yield pa.RecordBatch.from_arrays([batch["wid"], *[pa.array(x) for x in both.T]], ["wid", *C, *T])
        return run
    return [(learned.state.mapInArrow(sample(i), schema), m) for i, m in enumerate(learned.models)]


def _averaged(batch, held, models: list):
    """([word, class] probability, [sample] unigram probabilities), averaged over the samples."""
    parts, unigrams = 0, []
    for (c, t), model in zip(_drawn(batch, held), models):
        unigrams.append(model.unigram(t.sum(1)))
        parts = parts + model.contextual(c, t, unigrams[-1]) / len(models)
    return parts, unigrams


def _probabilities(models: list):
    """Per word: count, its unigram probabilities, and log10 of the averaged probability in each class where
    it has customers (``everywhere``: in all)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            row, rooms, n, _ = _row(batch, ("n",))
            held, customers = _held(row, rooms, k), _far(batch)[1]
            parts, unigrams = _averaged(batch, held, models)
            logs = np.log10(parts)
            rows, contexts = np.nonzero(held)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=k))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch["wid"], pa.array(np.rint(np.bincount(row, n, k)).astype(np.int64) + customers), *[pa.array(p) for p in unigrams],
                pa.ListArray.from_arrays(offsets, pa.array(contexts.astype(np.int8))),
                pa.ListArray.from_arrays(offsets, pa.array(logs[rows, contexts].astype(np.float32)))],
                ["key", "n", *[f"p{s}" for s in range(len(models))], "contexts", "logs"])
    return run


def model_table(learned: Learned) -> DataFrame:
    """key, n, p0.., contexts, logs: everything that scoring needs of a word in the classes."""
    schema = ("key long, n long, " + ", ".join(f"p{i} double" for i in range(len(learned.models)))
              + ", contexts array<tinyint>, logs array<float>")
    return learned.state.select("wid", "rooms", "n", "drawn", "far").mapInArrow(_probabilities(learned.models), schema)


def listed_logs(head, models: list, n: int):
    """[word, class] log10 probability of the listed words of ``head`` (rows of the model table), and their counts."""
    import numpy as np
    head = head.combine_chunks()
    at = head["key"].to_numpy()
    logs, counts = np.zeros((n, CONTEXTS), np.float32), np.zeros(n, np.int64)
    if len(at):
        counts[at] = head["n"].to_numpy()
        logs[at] = np.log10(sum(np.outer(head[f"p{s}"].to_numpy(), m.back_off()) for s, m in enumerate(models)) / len(models))
        classes, values = (np.concatenate([c.flatten().to_numpy() for c in head[x].chunks]) for x in ("contexts", "logs"))
        sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in head["contexts"].chunks])
        logs[np.repeat(at, sizes), classes] = values
    return logs, counts


def _near_pairs(batch, models: list, rooms: Rooms):
    """(word row, room, customers, gain) of the pairs in listed words' restaurants; a gain is what the pair adds to the
    log10 probability that its word has without it."""
    import numpy as np
    row, room, n, ts, _ = _row(batch, ("n", "ts"))
    p = _averaged(batch, _held(row, room, batch.num_rows), models)[0]
    once, ends = _unpacked(batch["once"], "int32")
    on = np.flatnonzero(room >= CONTEXTS)
    one = np.ones(len(once), np.int64)
    row = np.concatenate([row[on], np.repeat(np.arange(len(ends) - 1), np.diff(ends))])
    room, n, t = (np.concatenate(x) for x in ((room[on], once), (n[on], one), (ts[on] / SAMPLES, one)))
    room = room.astype(np.int64)
    own = (n - rooms.discount * t) / (STRENGTH + rooms.customers.values[room])
    return row, room, n, np.log10(1 + own / (rooms.back_off()[room] * p[row, room % CONTEXTS])).astype(np.float32)


def _top_pairs(rooms: Rooms, models: list, often: int):
    """key, gain of the pairs that training has ``often`` times or more."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                row, room, n, gain = _near_pairs(batch, models, rooms)
                on = n >= often
                yield pa.RecordBatch.from_arrays([pa.array(pair_keys(room[on], batch["wid"].to_numpy()[row[on]]).view(np.int64)), pa.array(gain[on])],
                                                 ["key", "gain"])
    return run


#: what scoring deals out, by part and kind: words (wid, n, sampled unigram probabilities, log10 probabilities in the
#: classes where a word has customers); keys and gains; a document's words that are not listed and its keys that are not
#: sent to all tasks (each with class, times, entries by document, documents); documents' sums over the others
SCORED = "part int, kind int, " + ", ".join(f"x{i} binary" for i in range(6))
SCORED_NAMES = [f.split()[0] for f in SCORED.split(", ")]
OF_WORD, OF_PAIR, HAS_WORD, HAS_PAIR, WHOLE = range(5)


def _scored_rows(kind: int, found, lists: list, most: int = 200):
    """Batches of ``SCORED`` rows: ``found``: parts; ``lists``: squeezed values by column."""
    import numpy as np
    import pyarrow as pa
    for at in range(0, len(found), most):
        k = len(found[at:at + most])
        columns = [pa.array(x[at:at + most], pa.binary()) for x in lists]
        yield pa.RecordBatch.from_arrays([pa.array(found[at:at + most], pa.int32()), pa.array(np.full(k, kind, np.int32)), *columns,
                                          *[pa.nulls(k, pa.binary())] * (6 - len(columns))], SCORED_NAMES)


def _keys_dealt(parts: int, found, most: int = 1 << 20):
    """Keys and gains, dealt: ``found``: pieces of them."""
    import numpy as np
    held, size = [], 0

    def dealt():
        key, gain = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key & np.uint64(KEY))
        return _scored_rows(OF_PAIR, *_lists(share(key[order], parts), [key[order] & np.uint64(KEY), gain[order]], gaps=True))
    for piece in found:
        held.append(piece)
        size += len(piece[0])
        if size >= most:
            yield from dealt()
            held, size = [], 0
    if size:
        yield from dealt()


def _near_gains(rooms: Rooms, models: list, often: int, parts: int):
    """Gains of the pairs that training has less ``often``."""
    def pieces(batches):
        for batch in batches:
            if batch.num_rows:
                row, room, n, gain = _near_pairs(batch, models, rooms)
                on = n < often
                yield pair_keys(room[on], batch["wid"].to_numpy()[row[on]]), gain[on]
    return lambda batches: _keys_dealt(parts, pieces(batches))


def _words_dealt(parts: int, samples: int):
    """Rows of the model table, dealt."""
    def run(batches):
        import numpy as np
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            wid, n = (batch[x].to_numpy() for x in ("key", "n"))
            p = np.stack([batch[f"p{s}"].to_numpy() for s in range(samples)], 1)
            logs, ends = np.zeros((k, CONTEXTS), np.float32), batch["contexts"].offsets.to_numpy()
            logs[np.repeat(np.arange(k), np.diff(ends)), batch["contexts"].flatten().to_numpy()] = batch["logs"].flatten().to_numpy()
            both = [np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").reshape(-1) for x in (p, logs)]
            yield from _scored_rows(OF_WORD, *_lists(share(wid, parts), [wid, n, *both]))
    return run


FAR_PARTS = "part int, kind int, room binary, wid binary, held binary"


def _far_chances(models: list, parts: int):
    """Probability that words which are not listed have in the classes of their far restaurants, dealt by restaurant."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            row, room, _ = _row(batch, ())
            p = _averaged(batch, _held(row, room, batch.num_rows), models)[0]
            room, ends = _unpacked(batch["away"])
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            found, lists = _lists(parts + share(room, parts), [room, batch["wid"].to_numpy()[row], p[row, room % CONTEXTS]])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), 1, np.int32)), *[pa.array(x, pa.binary()) for x in lists]],
                                             ["part", "kind", "room", "wid", "held"])
    return run


def _far_sampled(parts: int):
    """Sampled tables of rows of ``FAR``, dealt by restaurant."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            room, wid, ts = (batch[x].to_numpy() for x in ("room", "wid", "ts"))
            found, lists = _lists(parts + share(room, parts), [room, wid, ts / SAMPLES])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), 2, np.int32)), *[pa.array(x, pa.binary()) for x in lists]],
                                             ["part", "kind", "room", "wid", "held"])
    return run


def _far_gains(logs, discount: float, parts: int):
    """Gains of the pairs of far restaurants, and the log10 share that each of these leaves to its parent.  ``logs``:
    [listed word, class] log10 probabilities."""
    def pieces(batches):
        import numpy as np
        for _, rows in _grouped(batches, ["part", "kind", "room", "wid", "held"]):
            rows = list(rows)

            def values(kind, dtype="float64"):
                some = [[loosened(r[2]), loosened(r[3]), loosened(r[4], dtype)] for r in rows if r[1] == kind]
                return [np.concatenate(x) for x in zip(*some)] if some else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)]
            room, wid, n = values(0, "int64")
            if not len(room):
                continue
            keys, listed = pair_keys(room, wid), wid >= 0
            order = np.argsort(keys)

            def put(to, kind):
                r, w, x = values(kind)
                to[order[np.searchsorted(keys, pair_keys(r, w), sorter=order)]] = x
                return to
            t, p = put(np.ones(len(room)), 2), put(np.ones(len(room)), 1)
            p[listed] = 10.0 ** logs.values[wid[listed], room[listed] % CONTEXTS].astype(np.float64)
            starts = np.flatnonzero(np.concatenate([[True], room[1:] != room[:-1]]))
            size = np.diff(np.append(starts, len(room)))
            customers = STRENGTH + np.add.reduceat(n, starts)
            back = (STRENGTH + discount * np.add.reduceat(t, starts)) / customers
            gain = np.log10(1 + (n - discount * t) / np.repeat(customers, size) / (np.repeat(back, size) * p))
            yield keys, gain.astype(np.float32)
            yield room_keys(room[starts]), np.log10(back).astype(np.float32)
    return lambda batches: _keys_dealt(parts, pieces(batches))


def _has_rows(kind: int, part, owner, did, check, columns: list):
    """Rows of what documents have, dealt: ``owner``: the document (in order) of each entry."""
    import numpy as np
    order = np.argsort(part, kind="stable")
    part, owner = part[order], owner[order]
    if not len(part):
        return
    first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
    entries = np.diff(np.append(first, len(part))).astype(np.uint32)
    found, by_doc = _lists(part[first], [entries, did[owner[first]], check[owner[first]]])
    yield from _scored_rows(kind, found, [*_lists(part, [c[order] for c in columns])[1], *by_doc])


def _scorer(lexicon: Lexicon, logs, base, heads: int, rooms: Rooms, pair_key, pair_gain, parts: int):
    """Per document the sums over frequent words and pairs, and the rare words (with class) and rare pairs it has, dealt.
    ``logs``, ``base``: log10 probabilities of the listed words, of which the first ``heads`` count as
    frequent; ``pair_key`` (sorted), ``pair_gain``: the
    frequent pairs."""
    def run(batches):
        import numpy as np
        log_rows = np.concatenate([logs[:heads], np.zeros((1, CONTEXTS), np.float32)])
        base_rows = np.concatenate([base[:heads], [0.0]])
        log_back = np.log10(rooms.back_off())
        for batch in batches:
            at = 0
            for text in text_parts(binary_list(batch["text"]), 8 << 20):
                did, check = (batch[x].slice(at, len(text)).to_numpy(zero_copy_only=False) for x in ("did", "check"))
                at += len(text)
                docs, vocabulary = len(text), Vocabulary()
                ids, contexts, starts = coded(text, vocabulary)
                size, numbers = len(vocabulary), lexicon.numbers(vocabulary.words)
                known = np.where((numbers >= 0) & (numbers < heads), numbers, -1)[ids]
                rare = known < 0
                kinds, which = np.unique(places_of(ids, contexts, starts) * size + ids, return_inverse=True)
                room = lexicon.restaurants(kinds // size, numbers)
                keys = pair_keys(room, numbers[kinds % size])
                if len(pair_key):
                    place = np.minimum(np.searchsorted(pair_key, keys), len(pair_key) - 1)
                    sent = pair_key[place] == keys
                    gain = np.where(sent, pair_gain[place], 0.0)
                else:
                    sent, gain = np.zeros(len(keys), bool), np.zeros(len(keys))
                n = np.diff(np.concatenate([starts, [len(ids)]]))
                left = np.where(room >= 0, log_back[np.maximum(room, 0)], 0.0)
                score = np.where(rare, 0.0, log_rows[known, contexts].astype(np.float64)) + (left + gain)[which]
                sums = np.stack([n.astype(np.float64), *[np.add.reduceat(x, starts).astype(np.float64) for x in (~rare, np.where(rare, 0.0, base_rows[known]), score)]], 1)
                whole = share(np.asarray(did[:1]).astype(np.int64), parts)
                yield from _scored_rows(WHOLE, whole, [[squeezed(x)] for x in (did, check, sums.reshape(-1))])
                owner = np.repeat(np.arange(docs), n)
                code, times = np.unique((owner[rare] * size + ids[rare]) * CONTEXTS + contexts[rare], return_counts=True)
                wid = numbers[code // CONTEXTS % size]
                yield from _has_rows(HAS_WORD, share(wid, parts), code // CONTEXTS // size, did, check,
                                     [wid, (code % CONTEXTS).astype(np.uint8), times.astype(np.uint32)])
                # a document's keys: of rare pairs, and of far restaurants
                looked = (~sent & ((room < 0) | (room >= CONTEXTS)))[which]
                code, times = np.unique(owner[looked] * len(kinds) + which[looked], return_counts=True)
                of, key = code // len(kinds), keys[code % len(kinds)]
                away, (far, shared) = (room < 0)[which], np.unique(room, return_inverse=True)
                code, often = np.unique(owner[away] * len(far) + shared[which[away]], return_counts=True)
                of, key = np.concatenate([of, code // len(far)]), np.concatenate([key, room_keys(far[code % len(far)])])
                times, order = np.concatenate([times, often]), np.argsort(of, kind="stable")
                key = key[order]
                yield from _has_rows(HAS_PAIR, share(key, parts), of[order], did, check, [key & np.uint64(KEY), times[order].astype(np.uint32)])
    return run


SUMMED = "did long, check int, rows int, n_tokens long, n_known long, base double, score double"
SUMMED_KINDS = ["int64", "int32", "int32", "int64", "int64", "float64", "float64"]
BY_DOC = "part int, " + ", ".join(f"y{i} binary" for i in range(len(SUMMED_KINDS)))
BY_DOC_NAMES = [f.split()[0] for f in BY_DOC.split(", ")]


def _added_up(pieces: list):
    """Columns of ``SUMMED`` with one row for each document, of ``pieces`` with more."""
    import numpy as np
    columns = [np.concatenate(c) for c in zip(*pieces)]
    did, check = columns[:2]
    order = np.lexsort((check, did))
    did, check = did[order], check[order]
    first = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (check[1:] != check[:-1])]))
    return [did[first], check[first], *[np.add.reduceat(c[order], first).astype(c.dtype) for c in columns[2:]]]


def _summed_up(pieces, most: int = 1 << 21):
    """``_added_up`` of any number of ``pieces``, with about ``most`` rows held at once."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size > most:
            held = [_added_up(held)]
            size = 0                                         # ``most`` more rows before the next time
    return _added_up(held)


def _by_doc(batches):
    """Rows of ``SUMMED``, one for each document."""
    import pyarrow as pa
    for _, rows in _grouped(batches, BY_DOC_NAMES):
        columns = _summed_up([loosened(x, kind) for x, kind in zip(r[1:], SUMMED_KINDS)] for r in rows)
        for i in range(0, len(columns[0]), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 10_000]) for c in columns], [f.split()[0] for f in SUMMED.split(", ")])


def _looked_up(models: list, log_all: float, parts: int):
    """Each part's words and keys give the documents' entries their probabilities: sums by document, dealt by document.
    ``log_all``: log10 of what the base score divides by."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        backs, samples = np.stack([m.back_off() for m in models]) / max(1, len(models)) if models else np.zeros((0, CONTEXTS)), len(models)
        unseen = np.log10(sum(m.unseen() for m in models) / len(models))

        def place_in(values, looked):
            if not len(values):
                return np.zeros(len(looked), np.int64), np.zeros(len(looked), bool)
            at = np.minimum(np.searchsorted(values, looked), len(values) - 1)
            return at, values[at] == looked

        def sorted_by_first(rows, kinds, gaps=False):
            lists = [[loosened(r[i + 2], kind) for r in rows] or [np.zeros(0, kind)] for i, kind in enumerate(kinds)]
            columns = [np.concatenate([np.cumsum(x, dtype=x.dtype) if gaps and not i else x for x in c]) for i, c in enumerate(lists)]
            order = np.argsort(columns[0])
            return [c[order] for c in columns]

        def of_part(rows):
            held, model = {OF_WORD: [], OF_PAIR: []}, None
            for r in rows:
                kind = r[1]
                if kind in held:
                    held[kind].append(r)
                    continue
                if kind == WHOLE:
                    did, check, sums = loosened(r[2]), loosened(r[3], "int32"), loosened(r[4], "float64").reshape(-1, 4)
                    n, known, base, score = sums.T
                    columns = [did, check, np.ones(len(did), np.int32), n.astype(np.int64), known.astype(np.int64), base, score]
                else:
                    if model is None:
                        model = sorted_by_first(held[OF_WORD], ["int64", "int64", f"V{8 * samples}", f"V{4 * CONTEXTS}"]), sorted_by_first(held[OF_PAIR], ["uint64", "float32"], True)
                        held = {OF_WORD: [], OF_PAIR: []}
                    if kind == HAS_WORD:
                        wid, context, times = loosened(r[2]), loosened(r[3], "uint8").astype(np.int64), loosened(r[4], "uint32")
                        words, count, p, logs = model[0]
                        at, found = place_in(words, wid)
                        n, value, on = np.zeros(len(wid), np.int64), unseen[context], np.flatnonzero(found)
                        if len(on):
                            at, u = at[on], context[on]
                            n[on] = count[at]
                            own = logs[at].view("float32").reshape(-1, CONTEXTS)[np.arange(len(at)), u].astype(np.float64)
                            elsewhere = np.log10((p[at].view("float64").reshape(-1, samples) * backs[:, u].T).sum(1))
                            value[on] = np.where(own < 0, own, elsewhere)
                        each = [times * found, times * (np.log10(n + 0.5) - log_all), times * value]
                        entries, did, check = r[5:8]
                    else:
                        key, times = loosened(r[2], "uint64"), loosened(r[3], "uint32")
                        at, found = place_in(model[1][0], key)
                        value = np.zeros(len(key))
                        value[found] = model[1][1][at[found]]
                        each = [np.zeros(len(key)), np.zeros(len(key)), times * value]
                        entries, did, check = r[4:7]
                    starts = np.concatenate([[0], np.cumsum(loosened(entries, "uint32").astype(np.int64))[:-1]])
                    did, check, (known, base, score) = loosened(did), loosened(check, "int32"), (np.add.reduceat(x, starts) for x in each)
                    none = np.zeros(len(did), np.int64)
                    columns = [did, check, none.astype(np.int32), none, known.astype(np.int64), base.astype(np.float64), score]
                yield columns

        def dealt(pieces):
            columns = _added_up(pieces)
            found, lists = _lists(share(pair_keys(columns[1], columns[0]), parts), columns)
            for at in range(0, len(found), 200):
                yield pa.RecordBatch.from_arrays([pa.array(found[at:at + 200], pa.int32()), *[pa.array(x[at:at + 200], pa.binary()) for x in lists]], BY_DOC_NAMES)

        held, size = [], 0
        for _, rows in _grouped(batches, SCORED_NAMES):
            for piece in of_part(rows):
                held.append(piece)
                size += len(piece[0])
                if size > 1 << 20:
                    yield from dealt(held)
                    held, size = [], 0
        if size:
            yield from dealt(held)
    return run


def score_texts(docs: DataFrame, head_words: int = HEAD, head_pairs: int = PAIRS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    import numpy as np
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learned = learn(base.where(~in_fold(F.col("doc_id"), HELD_OUT)))
    lexicon, models, rooms, parts = learned.lexicon, learned.models, learned.rooms, learned.parts
    table = written(model_table(learned), "word-model")
    least, n_train, n_kinds = _listed(table, min(head_words, HEAD))
    logs, counts = listed_logs(table.where("key >= 0").toArrow(), models, len(lexicon.words))    # <= HEAD rows
    let_go(docs.sparkSession)
    log_all = math.log10(n_train + 0.5 * (n_kinds + 1))
    often = _least(learned.tally, head_pairs)
    seated = learned.state.select("wid", "rooms", "n", "ts", "drawn", "once")
    top = seated.mapInArrow(_top_pairs(rooms, models, often), "key long, gain float").toArrow()    # <= head_pairs rows
    top_key, top_gain = top["key"].to_numpy().view(np.uint64), top["gain"].to_numpy()
    order = np.argsort(top_key)
    away = learned.state.where("wid < 0 and length(away) > 0").select("wid", "rooms", "drawn", "away").mapInArrow(_far_chances(models, parts), FAR_PARTS)
    far = learned.pairs.select("part", F.lit(0).alias("kind"), "room", "wid", F.col("n").alias("held")).unionByName(away)
    far = _dealt(far.unionByName(learned.far.mapInArrow(_far_sampled(parts), FAR_PARTS)), parts)
    slim = base.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.hash("text").alias("check"), "text")
    halves = 1 + parts // 2
    found = [table.where(F.col("n") < least).mapInArrow(_words_dealt(halves, len(models)), SCORED),
             seated.mapInArrow(_near_gains(rooms, models, often, halves), SCORED), far.mapInArrow(_far_gains(Sent(logs), rooms.discount, halves), SCORED),
             slim.mapInArrow(_scorer(lexicon, logs, np.log10(counts + 0.5) - log_all, int((counts >= least).sum()), rooms,
                                     top_key[order], top_gain[order], halves), SCORED)]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    by_doc = _dealt(every, halves, "kind").mapInArrow(_looked_up(models, log_all, halves), BY_DOC)
    sums = _dealt(by_doc, halves).mapInArrow(_by_doc, SUMMED)
    each = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    doc_id = F.when(F.col("did") != NO_ID, F.col("did"))
    part = lambda c: (F.col(c) / F.col("rows"))
    return each.select(doc_id.alias("doc_id"), in_fold(doc_id, HELD_OUT).alias("held_out"),
                       part("n_tokens").cast("long").alias("n_tokens"), part("n_known").cast("long").alias("n_known"),
                       F.lit(n_train).cast("long").alias("train_tokens"), part("base").alias("base_score"), part("score").alias("score"))


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of the held-out and the training texts, by the model and the base."""
    return scored.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the model learned from the training folds."""
    return score_texts(documents(spark, sf_dir).select("doc_id", "text"))


_ship_by_value(__name__)
