"""Products of weighted postings, cell by cell: the heart of every list by common terms.

Queries and rows are (key, term, w).  Rows are put into cells of about equal numbers
of postings; every cell is one task, which reads its rows as flat columns, then takes
the queries one at a time and sends on what it found in pieces.  So a task holds one
cell, however many queries there are, and a term that most texts have costs no more
rows in the plan than a rare one.  Terms go as hashes of 64 bits.

For bounded lists a part of the cells is scored first.  The last place of a list over
that part is a floor: nothing below it can be in the list over all rows.  With the
floor the other cells leave out terms that cannot lift a row over it by themselves
(their rows are looked up only where another term hits), and send on only what
reaches it.  The lists are exact.

Scores of rows can be put together by what the rows belong to before anything is sent
on (``gathered``), the rows that lead a list be found (``leading``), and those be counted
that come before a given one (``places``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidar.tables import durable, stored

#: postings of a cell and of a group of queries
CELL, GROUP = 2_000_000, 1_000_000
#: parts of the cells that are scored one after the other, each with the floors of those before
FIRST, SECOND = 16, 4
#: rows that a task sends on at a time
PIECE = 50_000
#: rows from which a key is dealt out over several cells
HOT = 20_000
#: a term that this part of a cell's rows has gets a column
DENSE = 4
#: postings that are added up in the time it takes to look one row up
LOOKUP = 16
#: cells from which a floor is taken from some of them
FEW = 4
#: rows named with a query that travel together
SLICE = 100
#: scores have nine digits; what is less below a floor may still be rounded to it
SLACK = 1e-9


class Cell:
    """Rows of a cell by term."""

    def __init__(self, terms: pa.Array, keys: pa.Array, term: pa.Array, w: np.ndarray):
        at = pc.index_in(term, value_set=terms)
        here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        ids = at.take(pa.array(here)).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = keys.take(pa.array(here)).dictionary_encode()
        # numbers of rows in the order of their keys, so that ties go by key
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        row = place[coded.indices.to_numpy()]
        self.keys = coded.dictionary.take(pa.array(order))
        by = np.lexsort((row, ids))
        self.row, self.w, ids = row[by], w[here][by], ids[by]
        fresh = np.append(True, (ids[1:] != ids[:-1]) | (self.row[1:] != self.row[:-1])) if len(ids) else np.empty(0, bool)
        if not fresh.all():  # a row that has a term several times has it once, with the sum
            self.w = np.add.reduceat(self.w, np.flatnonzero(fresh))
            self.row, ids = self.row[fresh], ids[fresh]
        self.start = np.searchsorted(ids, np.arange(len(terms) + 1))
        self.plain = not len(self.w) or self.w.min() >= 0
        # the greatest weight of every term that has rows
        full = np.flatnonzero(np.diff(self.start))
        self.most = np.zeros(len(terms))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.w, self.start[full])
        # a term that many rows have is added to all of them, which is faster than one by one
        self.column = {}
        for t in np.flatnonzero(np.diff(self.start) * DENSE >= max(1, len(self.keys))):
            self.column[t] = own = np.zeros(len(self.keys))
            own[self.row[self.start[t] : self.start[t + 1]]] = self.w[self.start[t] : self.start[t + 1]]
        self.spare = np.empty(len(self.keys))
        self.whole = self.keys.to_numpy() if pa.types.is_integer(self.keys.type) else None

    def scores(self, terms: np.ndarray, weights: np.ndarray, floor: float, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows a query reaches with a positive score, and their scores; rows below the floor may be missing, but for those of ``also``.

        The products of a row are always added up in the same order.
        """
        start, end = self.start[terms], self.start[terms + 1]
        hit = end > start
        start, end, weights, terms = start[hit], end[hit], weights[hit], terms[hit]
        if not len(start):
            return np.empty(0, np.int64), np.empty(0)
        rare = np.ones(len(start), bool)
        if floor > 0 and self.plain and weights.min() >= 0:
            most = self.most[terms] * weights
            order = np.argsort(most)
            rare[order[np.cumsum(most[order]) < floor * (1 - 1e-9)]] = False
        wide = np.array([t in self.column for t in terms])

        def partly(some: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
            """Rows whose sum over some of the terms is greater than ``least``."""
            each = [i for i in np.flatnonzero(some & ~wide)]
            row = np.concatenate([self.row[start[i] : end[i]] for i in each]) if each else np.empty(0, np.int32)
            w = np.concatenate([self.w[start[i] : end[i]] * weights[i] for i in each]) if each else np.empty(0)
            if 8 * len(row) < len(self.keys) and not (some & wide).any():  # few rows: not the whole cell
                found, at = np.unique(row, return_inverse=True)
                total = np.bincount(at, w)
                return found[total > least], total[total > least]
            total = np.bincount(row, w, len(self.keys)) if each else np.zeros(len(self.keys))
            for i in np.flatnonzero(some & wide):
                total += np.multiply(self.column[terms[i]], weights[i], out=self.spare)
            found = np.flatnonzero(total > least)
            return found, total[found]

        held = np.where(wide, len(self.keys) // 4, end - start)
        reach = len(self.keys) if (rare & wide).any() else (end - start)[rare].sum()
        if LOOKUP * reach * np.count_nonzero(~wide) > held.sum():  # looking rows up term by term may take longer than adding up all
            rare[:] = True
        if rare.all():
            return partly(rare, 0.0)
        found = partly(rare, max(0.0, floor * (1 - 1e-9) - most[~rare].sum()))[0] if rare.any() else np.empty(0, np.int64)
        if also is not None:
            found = np.union1d(found, also)
        score = np.zeros(len(found))
        for i in [*np.flatnonzero(~wide), *np.flatnonzero(wide)]:
            if wide[i]:
                score += self.column[terms[i]][found] * weights[i]
            else:
                own = self.row[start[i] : end[i]]
                at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                score += np.where(own[at] == found, self.w[start[i] : end[i]][at] * weights[i], 0.0)
        return found[score > 0], score[score > 0]

    def numbers(self, keys: pa.Array) -> np.ndarray:
        """Numbers of rows, -1 where the cell has none of the key."""
        if self.whole is not None and pa.types.is_integer(keys.type) and len(self.whole):
            asked = keys.to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(self.whole, asked), len(self.whole) - 1)
            return np.where(self.whole[at] == asked, at, -1)
        return pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False)


def products(asked: DataFrame, rows: DataFrame, query_key: str, row_key: str, depth: int | None = None, count: int | None = None, cell: int = CELL, group: int = GROUP) -> DataFrame:
    """(query, row, score): sums of products over common terms, where positive; with ``depth`` the best of
    each query by scores rounded to nine digits, ties by row.  ``count`` says how many
    rows there are about, if that is known.

    Keys must not be null.  A repeated (key, term) adds up.  Empty inputs give an empty result.
    Where the rows have a column ``at`` and the queries ``until``, both without nulls, a
    pair counts only if the one is at most the other.  Inputs may be packed.
    """
    timed = "at" in rows.columns
    asked, rows = durable(packed(asked, query_key)), packed(rows, row_key)
    if count is None or depth is not None and count > FIRST * cell:
        rows = stored(rows)  # they are read more than once
        count = _size(rows)
    parts = _parts(asked, count, cell)
    groups = max(1, -(-_size(asked) // group))

    def listed(cell: Cell, query: Query) -> tuple[np.ndarray, np.ndarray]:
        row, s = cell.scores(query.terms, query.w, query.floor - SLACK)
        if timed:
            row, s = row[cell.at[row] <= query.until], s[cell.at[row] <= query.until]
        if depth is None:
            return row, s
        s = np.round(s, 9)
        keep = (s > 0) & (s >= query.floor)
        return _first(row[keep], s[keep], depth)

    def meet(q: DataFrame, cells: range) -> DataFrame:
        own = rows.withColumn("c", _cell_of(row_key, parts)).where(F.col("c").between(cells.start, cells.stop - 1))
        p = (F.col("c") - cells.start) * groups
        post = _post(own.withColumn("p", F.explode(F.sequence(p, p + groups - 1))), row_key, "at" if timed else None)
        return _solve([post, _spread(q, query_key, len(cells), groups)], len(cells) * groups, asked, rows, query_key, row_key, row_key, listed)

    return _staged(asked, meet, query_key, row_key, depth, parts)


def gathered(asked: DataFrame, rows: DataFrame, belongs: DataFrame, query_key: str, row_key: str, key: str, how: str, depth: int, other: bool = False, cell: int = CELL, hot: int = HOT) -> DataFrame:
    """(query, key, score): the ``depth`` best keys of each query by scores rounded to nine digits, ties by key, where positive.

    ``belongs`` has (row, key, size, plus), once each.  A key's score is, with ``how``
    "sum", the sum over its rows of the row's product, rounded to nine digits, divided by
    ``size``; with "max" the greatest product of its rows, plus ``plus``.  With
    ``other`` the row that has the query's own key doesn't count.

    A cell has whole keys with all their rows, so its list is final but for the other
    cells.  Keys of more than ``hot`` rows are dealt out over the cells by row
    instead, and their parts put together afterwards.
    """
    belongs = durable(belongs.select(row_key, key, F.col("size").cast("double").alias("size"), F.col("plus").cast("double").alias("plus")))
    asked = durable(packed(asked, query_key))
    rows = stored(packed(rows, row_key).join(belongs.select(row_key).distinct(), row_key, "left_semi"))
    held = belongs.agg(F.count("*").alias("n"), F.count_distinct(row_key).alias("rows")).first()
    parts = _parts(asked, int(_size(rows) * held.n / max(1, held.rows)), cell)
    much = durable(belongs.groupBy(key).agg(F.count("*").alias("held__")).where(F.col("held__") > hot).select(key, F.lit(True).alias("hot")))
    whole = much.isEmpty()
    edges = durable(belongs.join(much, key, "left").withColumn("c", F.when(F.col("hot"), _cell_of(row_key, parts)).otherwise(_cell_of(key, parts))))

    def listed(cell: Cell, query: Query, depth: int) -> tuple[np.ndarray, np.ndarray]:
        e, value = cell.edges, np.zeros(len(cell.keys))
        row, s = cell.scores(query.terms, query.w, query.floor - SLACK - e.lift if how == "max" else 0.0)
        value[row] = np.round(s, 9) if how == "sum" else s
        if other:
            me = cell.numbers(pa.array([query.name], cell.keys.type))[0]
            if me >= 0:
                value[me] = 0.0
        each = value[e.row]
        total = np.add.reduceat(each / e.size, e.start) if how == "sum" else np.maximum.reduceat(each, e.start)
        there = np.flatnonzero(total > 0)
        total = total[there] + (e.plus[there] if how == "max" else 0.0)
        part = e.hot[there]
        last = np.round(total, 9)
        keep = (last > 0) & (last >= query.floor) & ~part
        at, s = _first(there[keep], last[keep], depth)
        return np.append(at, there[part]), np.append(s, total[part])

    def meet(q: DataFrame, cells: int, groups: int, depth: int) -> DataFrame:
        own = edges.where(F.col("c") < cells).withColumn("p", F.explode(F.sequence(F.col("c") * groups, F.col("c") * groups + groups - 1)))
        post = _post(rows.join(own.select(row_key, "p").distinct(), row_key), row_key)
        told = own.select("p", F.lit(0).alias("kind"), F.col(row_key).alias("r"), F.col(key).alias("k"), F.col("size").alias("x"), F.col("plus").alias("y"), F.coalesce("hot", F.lit(False)).alias("hot"))
        return _solve([told, post, _spread(q, query_key, cells, groups)], cells * groups, asked, rows, query_key, row_key, key, lambda c, query: listed(c, query, depth), belongs.schema[key].dataType.simpleString())

    if whole:
        return _floored(asked, meet, query_key, key, depth, parts)
    # parts of a hot key are whole only over all cells
    found = durable(meet(asked, parts, 1, depth))
    parted = found.join(much, key, "left_semi").groupBy(query_key, key).agg(F.round((F.sum if how == "sum" else F.max)("score"), 9).alias("score")).where("score > 0")
    return _best(found.join(much, key, "left_anti").unionByName(parted), query_key, key, depth)


def _floored(asked: DataFrame, meet, query_key: str, key: str, depth: int, parts: int) -> DataFrame:
    """The ``depth`` best of all cells: some cells say what score is likely to be in every list, the others send on what reaches it.

    ``meet`` takes queries, the number of cells, the number of groups of queries, and a depth.
    A list that then holds fewer than ``depth`` is made again without a floor, so lists are exact.
    """
    if parts < FEW:
        return _best(meet(asked, parts, 1, depth), query_key, key, depth)
    told = _expecting(asked, meet, query_key, depth, parts)
    best = stored(_best(meet(told, parts, 1, depth), query_key, key, depth))
    held = best.groupBy(query_key).agg(F.count("*").alias("held__"))
    return _again(told, best, held, query_key, depth, lambda q: _best(meet(q, parts, 1, depth), query_key, key, depth))


def _expecting(asked: DataFrame, meet, query_key: str, depth: int, parts: int, spare: int = 1) -> DataFrame:
    """Queries with a floor: the score that, going by a part of the cells, more than ``spare * depth`` reach."""
    some = max(1, parts // FIRST)
    place = spare * depth * some / parts
    place = math.ceil(place + 4 * math.sqrt(place) + 4)
    groups = max(1, asked.sparkSession.sparkContext.defaultParallelism // some)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"))
    floor = meet(asked, some, groups, place).withColumn("place__", F.row_number().over(order)).where(F.col("place__") == place).select(query_key, F.col("score").alias("floor"))
    return durable(asked.join(floor, query_key, "left"))


def _again(told: DataFrame, best: DataFrame, held: DataFrame, query_key: str, depth: int, make) -> DataFrame:
    """``best`` with what had a floor and holds (``held__``) fewer than ``depth`` made again without one."""
    short = durable(told.where("floor > 0").join(held, query_key, "left").where(F.coalesce("held__", F.lit(0)) < depth).drop("floor", "held__"))
    if short.isEmpty():
        return best
    return best.join(short.select(query_key), query_key, "left_anti").unionByName(make(short))


def leading(asked: DataFrame, rows: DataFrame, wanted: DataFrame, query_key: str, row_key: str, depth: int | None, belongs: DataFrame | None = None, cell: int = CELL) -> DataFrame:
    """(query, row, score): positive products, rounded to nine digits, of the ``wanted`` (query, row) and of those that lead the list by score, then row.

    Leading are the first ``depth`` rows; with ``belongs`` (row, key) the rows that are
    the first of a key, until ``depth`` keys, or all, have one.  There may be others that
    lead a part of the list only.  Inputs are packed and kept; keys are whole numbers.
    """
    parts, keyed = _rounds(asked, _parts(asked, _size(rows), cell)), belongs is not None

    def positive(cell: Cell, query: Query, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        row, s = cell.scores(query.terms, query.w, query.floor - SLACK, also)
        s = np.round(s, 9)
        return row[s > 0], s[s > 0]

    def reached(cell: Cell, query: Query, place: int) -> tuple[np.ndarray, np.ndarray]:
        row, s = positive(cell, query)
        at = cell.edges.leaders(row, s, place, True) if keyed else _first(np.arange(len(row)), s, place)[0]
        return row[at], s[at]

    def listed(cell: Cell, query: Query) -> tuple[np.ndarray, np.ndarray]:
        named = cell.numbers(query.rows)
        row, s = positive(cell, query, named[named >= 0])
        taken, high = np.isin(row, named), np.flatnonzero(s >= query.floor)
        lead = cell.edges.leaders(row[high], s[high], depth) if keyed else _first(np.arange(len(high)), s[high], depth)[0]
        taken[high[lead]] = True
        return row[taken], s[taken]

    def meet(q: DataFrame, cells: int, groups: int, place: int | None = None) -> DataFrame:
        at = lambda c: F.explode(F.sequence(c * groups, c * groups + groups - 1))
        here = F.col("c") < cells
        frames = [_post(rows.withColumn("c", _cell_of(row_key, parts)).where(here).withColumn("p", at(F.col("c"))), row_key)]
        if keyed:
            own = belongs.withColumn("c", _cell_of(row_key, parts)).where(here).withColumn("p", at(F.col("c")))
            frames.append(own.select("p", F.lit(0).alias("kind"), F.col(row_key).alias("r"), F.col("key").alias("k"), F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(False).alias("hot")))
        if place is not None:
            frames.append(_spread(q, query_key, cells, groups))
            return _solve(frames, cells * groups, asked, rows, query_key, row_key, row_key, lambda c, query: reached(c, query, place), "bigint" if keyed else None)
        theirs = wanted.groupBy(F.col(query_key).alias("q"), _cell_of(row_key, parts).alias("p")).agg(F.collect_list(row_key).alias("er"))
        frames.append(_sliced(_spread(q, query_key, cells, 1).join(theirs, ["q", "p"], "left")))
        return _solve(frames, cells, asked, rows, query_key, row_key, row_key, listed, "bigint" if keyed else None)

    if depth is None or parts < FEW:
        return durable(meet(asked, parts, 1))
    # a row may belong to several keys that others have too
    told = _expecting(asked, meet, query_key, depth, parts, 2 if keyed else 1)
    found = durable(meet(told, parts, 1))
    high = found.join(told.where("floor > 0").select(query_key, "floor"), query_key).where(F.col("score") >= F.col("floor"))
    if keyed:
        high = high.join(belongs, row_key).select(query_key, "key").distinct()
    held = high.groupBy(query_key).agg(F.count("*").alias("held__"))
    return _again(told, found, held, query_key, depth, lambda q: durable(meet(q, parts, 1)))


def places(asked: DataFrame, rows: DataFrame, given: DataFrame, query_key: str, row_key: str, cell: int = CELL) -> DataFrame:
    """(query, row, rank): the place of each of the ``given`` (query, row, score) in the list of all positive products, best first, ties by row.

    Rows have whole numbers as keys.  Inputs are packed and kept.
    """
    parts = _rounds(asked, _parts(asked, _size(rows), cell))

    def counted(cell: Cell, query: Query) -> tuple[pa.Array, np.ndarray]:
        theirs, score = query.rows, query.scores
        if not len(theirs):
            return theirs, np.empty(0)
        row, s = cell.scores(query.terms, query.w, score.min() - SLACK)
        s = np.round(s, 9)
        high = (s > 0) & (s >= score.min())  # what comes after all of them counts for none
        row, s = row[high], s[high]
        ordered = np.sort(s)
        end = np.searchsorted(ordered, score, "right")
        before = len(s) - end
        # rows of the same score, other than itself, count if they come earlier
        alike = np.flatnonzero(end - np.searchsorted(ordered, score, "left") > (cell.numbers(theirs) >= 0))
        if len(alike):
            tied = np.isin(s, score[alike])
            by = np.lexsort((row[tied], s[tied]))
            tied_row, tied_score = row[tied][by], s[tied][by]
            bound = np.searchsorted(cell.keys.to_numpy(), theirs.to_numpy()[alike])
            a, b = np.searchsorted(tied_score, score[alike], "left"), np.searchsorted(tied_score, score[alike], "right")
            before[alike] += [int(np.searchsorted(tied_row[x:y], z)) for x, y, z in zip(a, b, bound)]
        some = np.flatnonzero(before)
        return theirs.take(pa.array(some)), before[some].astype(float)

    theirs = given.groupBy(F.col(query_key).alias("q")).agg(F.collect_list(F.struct(F.col(row_key).alias("r"), F.col("score").alias("s"))).alias("e")).select("q", F.col("e.r").alias("er"), F.col("e.s").alias("ew"))
    told = _spread(_sliced(asked.join(theirs.withColumnRenamed("q", query_key), query_key).withColumnsRenamed({"words__": "h", "weights__": "w"})), query_key, parts, 1)
    found = _solve([_post(rows.withColumn("p", _cell_of(row_key, parts)), row_key), told], parts, asked, rows, query_key, row_key, row_key, counted)
    before = found.groupBy(query_key, row_key).agg(F.sum("score").cast("bigint").alias("before"))
    return given.select(query_key, row_key).join(before, [query_key, row_key], "left").select(query_key, row_key, (F.coalesce("before", F.lit(0)) + 1).alias("rank"))


def ready(session: SparkSession) -> None:
    """Starts the Python of the executors: while a JVM starts it, what adds up the memory of processes counts the JVM twice, so this is for the beginning, when it is small."""
    cores = session.sparkContext.defaultParallelism
    session.range(0, cores, 1, cores).mapInArrow(lambda batches: batches, "id bigint").count()


def packed(df: DataFrame, key: str) -> DataFrame:
    """One row per key: its terms, hashed, and their weights as arrays, and what else counts; a packed input stays as it is."""
    if "words__" in df.columns:
        return df
    more = [F.max(F.col(c).cast("double")).alias(c) for c in ("at", "until") if c in df.columns]
    told = df.groupBy(key).agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("w"))).alias("x"), *more)
    return told.select(key, F.col("x.t").alias("words__"), F.col("x.w").alias("weights__"), *[c for c in ("at", "until") if c in df.columns])


def _size(df: DataFrame) -> int:
    """Postings of a packed input."""
    return df.agg(F.sum(F.size("words__"))).first()[0] or 0


def _parts(asked: DataFrame, count: int, cell: int) -> int:
    """Cells: as many as tasks, if these get enough to do."""
    return max(1, -(-count // cell), min(asked.sparkSession.sparkContext.defaultParallelism, count // 50_000))


def _rounds(asked: DataFrame, parts: int) -> int:
    """So many cells, and more, that the last round of tasks is full too."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    return parts if parts < cores else -(-parts // cores) * cores


def _cell_of(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _post(own: DataFrame, row_key: str, at: str | None = None) -> DataFrame:
    return own.select("p", F.lit(1).alias("kind"), F.col(row_key).alias("r"), F.col("words__").alias("h"), F.col("weights__").alias("w"), *[F.col(c).alias("x") for c in [at] if c])


def _spread(asked: DataFrame, query_key: str, cells: int, groups: int) -> DataFrame:
    """Every query for each of the cells, in its group."""
    g = F.pmod(F.xxhash64(query_key), F.lit(groups)).cast("int")
    more = {"words__": "h", "weights__": "w", "h": "h", "w": "w", "floor": "x", "until": "y", "er": "er", "ew": "ew", "i": "i"}
    own = asked.select(F.col(query_key).alias("q"), F.lit(2).alias("kind"), g.alias("g"), *[F.col(c).alias(n) for c, n in more.items() if c in asked.columns])
    return own.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: c * groups + F.col("g")))).drop("g")


def _sliced(asked: DataFrame) -> DataFrame:
    """Queries with the rows named with them in rows of no more than ``SLICE``, the terms in the first (``i``): a batch of them stays small."""
    last = F.greatest(F.lit(0), F.floor((F.size("er") - 1) / F.lit(SLICE))).cast("int")
    own = asked.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    first = {c: F.when(F.col("i") == 0, F.col(c)) for c in ("h", "w")}
    return own.withColumns(first | {c: F.slice(c, F.col("i") * SLICE + 1, SLICE) for c in ("er", "ew") if c in asked.columns})


def _staged(asked: DataFrame, meet, query_key: str, key: str, depth: int | None, parts: int) -> DataFrame:
    """Lists over all cells, found in stages."""
    if depth is None:
        return meet(asked, range(parts))
    if parts <= FIRST:
        return _best(meet(asked, range(parts)), query_key, key, depth)
    ends, best = [0, max(1, parts // FIRST), parts // SECOND, parts], None
    for start, end in zip(ends, ends[1:]):
        q = asked
        if best is not None:
            floor = best.groupBy(query_key).agg(F.count("*").alias("held__"), F.min("score").alias("floor")).where(F.col("held__") == depth).select(query_key, "floor")
            q = durable(asked.join(floor, query_key, "left"))
        found = meet(q, range(start, end))
        best = _best(found if best is None else best.unionByName(found), query_key, key, depth)
        if end < parts:
            best = stored(best)
    return best


def _best(found: DataFrame, query_key: str, row_key: str, depth: int) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(row_key))
    return found.withColumn("place__", F.row_number().over(order)).where(F.col("place__") <= depth).drop("place__")


def _first(row: np.ndarray, s: np.ndarray, depth: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The best ``depth``, ties by row."""
    if depth is not None and len(s) > depth:
        keep = s >= np.partition(s, len(s) - depth)[len(s) - depth]
        row, s = row[keep], s[keep]
        best = np.lexsort((row, -s))[:depth]
        row, s = row[best], s[best]
    return row, s


class Edges:
    """What the rows of a cell belong to: flat columns in the order of keys."""

    def __init__(self, cell: Cell, told: list[pa.Table]):
        table = pa.concat_tables(told).combine_chunks()
        row = cell.numbers(table.column("r").combine_chunks())
        table, row = table.filter(pa.array(row >= 0)).combine_chunks(), row[row >= 0]
        coded = table.column("k").combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key = place[coded.indices.to_numpy()]
        by = np.lexsort((row, key))
        self.keys, self.row, self.key, self.size = coded.dictionary.take(pa.array(order)), row[by], key[by], table.column("x").to_numpy()[by]
        self.start = np.searchsorted(self.key, np.arange(len(order)))
        self.plus, self.hot = table.column("y").to_numpy()[by][self.start], table.column("hot").to_numpy()[by][self.start].astype(bool)
        self.lift = float(self.plus.max(initial=0.0))
        # the same by row
        by = np.argsort(self.row, kind="stable")
        self.by_row, self.at = self.key[by], np.searchsorted(self.row[by], np.arange(len(cell.keys) + 1))

    def leaders(self, row: np.ndarray, s: np.ndarray, depth: int | None, each: bool = False) -> np.ndarray:
        """Positions of the rows that are the first of a key, in the order of scores, until ``depth`` keys have one; with ``each`` once for each key."""
        size = 2 * depth if depth is not None else len(row)
        while True:
            some, best = _first(np.arange(len(row)), s, size)
            some = some[np.lexsort((some, -best))]
            start, end = self.at[row[some]], self.at[row[some] + 1]
            owner = np.repeat(np.arange(len(some)), end - start)
            key = self.by_row[np.arange(len(owner)) + np.repeat(start - (np.cumsum(end - start) - (end - start)), end - start)]
            first = np.sort(np.unique(key, return_index=True)[1])  # the first of each key, since they are in order
            if size >= len(row) or len(first) >= depth:
                return some[owner[first[:depth]] if each else np.unique(owner[first[:depth]])]
            size *= 4


class Query:
    """A query as a cell sees it: its terms that the cell has, always in one order, so that equal sums are equal."""

    def __init__(self, cell: Cell, name, told: list[tuple[pa.RecordBatch, int]]):
        batch, i = told[0]
        h = batch.column("h")[i].values.to_numpy()
        at = np.minimum(np.searchsorted(cell.terms, h), len(cell.terms) - 1)
        by = np.argsort(at, kind="stable")
        by = by[cell.terms[at[by]] == h[by]]
        floor, until = batch.column("x")[i].as_py(), batch.column("y")[i].as_py()
        self.name, self.terms, self.w = name, at[by], batch.column("w")[i].values.to_numpy()[by]
        self.floor, self.until = floor or 0.0, np.inf if until is None else until
        flat = lambda c, kind: pa.concat_arrays([pa.array([], kind), *[x for b, i in told if (x := b.column(c)[i].values) is not None]])
        self.rows, self.scores = flat("er", cell.keys.type), flat("ew", pa.float64()).to_numpy()


def _solve(frames: list[DataFrame], n: int, asked: DataFrame, rows: DataFrame, query_key: str, row_key: str, out_key: str, score, edge_kind: str | None = None) -> DataFrame:
    """Every query on each of the ``n`` cells; frames have the cell as ``p``, and kind 0 for edges, 1 for rows, 2 for queries."""
    q, r = asked.schema[query_key].dataType.simpleString(), rows.schema[row_key].dataType.simpleString()
    kinds = {"q": q, "r": r, "k": edge_kind or "bigint", "h": "array<bigint>", "w": "array<double>", "x": "double", "y": "double", "hot": "boolean", "er": f"array<{r}>", "ew": "array<double>", "i": "int"}
    full = [f.select("p", "kind", *[(F.col(c) if c in f.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]) for f in frames]
    dealt = reduce(DataFrame.unionByName, full).repartitionById(n, F.col("p")).drop("p")
    # rows of a query follow one another
    dealt = dealt.sortWithinPartitions("kind", "q", "i") if "i" in frames[-1].columns else dealt.sortWithinPartitions("kind")
    by_edge = edge_kind is not None and out_key != row_key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, edges, post, names, keys, scores, size, told = None, [], [], [], [], [], 0, []

        def piece() -> pa.RecordBatch:
            own = pa.concat_arrays(keys) if isinstance(keys[0], pa.Array) else (cell.edges if by_edge else cell).keys.take(pa.array(np.concatenate(keys)))
            name = pa.array(names, kind).take(pa.array(np.repeat(np.arange(len(names)), [len(s) for s in scores])))
            return pa.RecordBatch.from_arrays([name, own, pa.array(np.concatenate(scores))], [query_key, out_key, "score"])

        def solve() -> None:
            nonlocal size
            name = told[0][0].column("q")[told[0][1]].as_py()
            found, s = score(cell, Query(cell, name, told))
            told.clear()
            if len(s):
                names.append(name)
                keys.append(found)
                scores.append(s)
                size += len(s)

        for batch in batches:
            a, b = np.searchsorted(batch.column("kind").to_numpy(), [1, 2])
            if a:
                edges.append(pa.table({c: pa.concat_arrays([batch.column(c).slice(0, a)]) for c in ("r", "k", "x", "y", "hot")}))
            if b > a:
                post.append(pa.table({c: pa.concat_arrays([batch.column(c).slice(a, b - a)]) for c in ("r", "h", "w", "x")}))
            if b == batch.num_rows or cell is None and not post:
                continue
            if cell is None:
                cell, kind = _cell(post), batch.schema.field("q").type
                cell.edges = Edges(cell, edges) if edges else None
                edges.clear()
            if not len(cell.terms) or edge_kind is not None and (cell.edges is None or not len(cell.edges.keys)):
                continue
            begins = batch.column("h").is_valid().to_numpy(zero_copy_only=False)
            for i in range(b, batch.num_rows):
                if begins[i] and told:
                    solve()
                if size >= PIECE:
                    yield piece()
                    names, keys, scores, size = [], [], [], 0
                told.append((batch, i))
        if told:
            solve()
        if size:
            yield piece()

    return dealt.mapInArrow(run, f"{query_key} {q}, {out_key} {edge_kind if by_edge else r}, score double")


def _cell(post: list[pa.Table]) -> Cell:
    """A cell of the rows that were read; the list is emptied."""
    table = pa.concat_tables(post).combine_chunks()
    post.clear()
    r, h, w = table.column("r").combine_chunks(), table.column("h").combine_chunks(), table.column("w").combine_chunks()
    held, at = pc.list_value_length(h).to_numpy(), table.column("x").to_numpy()
    h, w = h.flatten(), w.flatten().to_numpy()
    terms = np.unique(h.to_numpy())
    cell = Cell(pa.array(terms), pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(r), dtype=np.int32), held)), r), h, w)
    cell.terms, cell.at = terms, np.empty(len(cell.keys))
    cell.at[cell.numbers(r)] = at
    return cell
